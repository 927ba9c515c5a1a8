"""Exact top-k search by columnar branch-and-bound.

Vectors are quantised to integers. Candidates are stored in blocks in vertical layout: one contiguous row of values for each dimension.
A block of queries meets a block of candidates; inner products grow dimension block by dimension block, and by Cauchy-Schwarz no
product changes by more than the product of the remaining norms. Candidates whose bound falls below the k-th best lower bound go, the
rest is compacted. The best k of each pair of blocks are reduced to the best k of the query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleyspark.llm.base import bounded_batches, query, settle, table

GROUP_QUERIES, BLOCK_QUERIES, BLOCK_VECTORS, BLOCK_DIMENSIONS = 4096, 256, 4096, 16
LIMIT = float(1 << 62)  # of the squares of a vector's components, summed at their largest: no score leaves a long
EXACT = float(1 << 53)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, v (array of long): floor(256 * x). Rows without id, without vector, with null or non-finite components, or so long that
    a score might not fit a long, are left out, and of rows that repeat a vec_id the one of the smallest vector stays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.size("embedding") > 0
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    peak = F.array_max(F.transform(v, lambda x: F.abs(x * 256) + 1))
    sound = finite & (F.size("embedding") * peak * peak < LIMIT)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))


def best_of_block(q: np.ndarray, c: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, vec_id, score): for each query the k best candidates of the block, ties to smaller ids. ``c`` holds one row a dimension.

    Values are exact: floating point where all partial sums stay below 2**53, Python integers elsewhere.
    """
    peak = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) * c.shape[0]
    q, c = (x.astype(np.float64 if peak < EXACT else object) for x in (q, c))
    cuts = list(range(0, c.shape[0], BLOCK_DIMENSIONS)) + [c.shape[0]]
    square = lambda x, axis: np.array([(x.take(range(a, c.shape[0]), axis) ** 2).sum(axis) for a in cuts[1:]], dtype=float)
    rest_q, rest_c = np.sqrt(square(q, 1)) * (1 + 1e-9), np.sqrt(square(c, 0)) * (1 + 1e-9)
    start = q[:, : cuts[1]] @ c[: cuts[1]]  # the first dimension block has no bound yet: all pairs, one product
    out = []
    for i in range(len(q)):
        live, total = np.arange(c.shape[1]), start[i]
        if own[i] >= 0:
            live, total = np.delete(live, own[i]), np.delete(total, own[i])
        for b in range(1, len(cuts) - 1):
            if len(live) > k:
                slack = rest_q[b - 1, i] * rest_c[b - 1, live]
                low = total.astype(float) - slack
                floor = np.partition(low, len(low) - k)[len(low) - k]
                keep = total.astype(float) + slack >= floor - abs(floor) * 1e-9
                live, total = live[keep], total[keep]
            total = total + q[i, cuts[b] : cuts[b + 1]] @ c[cuts[b] : cuts[b + 1], live]
        if len(live) > k:
            edge = sorted(total.tolist(), reverse=True)[k - 1] if total.dtype == object else np.partition(total, len(total) - k)[len(total) - k]
            live, total = live[total >= edge], total[total >= edge]
        order = sorted(range(len(live)), key=lambda j: (-total[j], ids[live[j]]))[:k]
        out += [(i, int(ids[live[j]]), int(total[j])) for j in order]
    return out


def top_k(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product for each row that the predicate ``queries`` selects.

    Candidates are all other rows with as many dimensions; fewer than k give fewer rows, none gives none. Ties go to the smaller vec_id.
    Query blocks and candidate blocks of bounded size meet in pairs, keyed by both block numbers; the rows that reach a task are bounded.
    """
    spark = vectors.sparkSession
    data = settle(quantised(vectors).withColumn("is_query", queries))
    shape = {r.dims: (r.n, r.m) for r in data.groupBy("dims").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("m")).collect()}
    grid = [(d, max(1, math.ceil(n / BLOCK_VECTORS)), math.ceil(m / GROUP_QUERIES)) for d, (n, m) in shape.items() if m]  # one entry for each length
    blocks = spark.createDataFrame(grid, "dims int, n_blocks int, q_blocks int")
    placed = data.join(blocks, "dims")
    spot = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col(n)).cast("int")
    candidates = placed.select("dims", spot("n_blocks", "c").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "vec_id", "v", F.lit(False).alias("asks"))
    asking = placed.filter("is_query").select("dims", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("cb"), spot("q_blocks", "q").alias("qb"), "vec_id", "v", F.lit(True).alias("asks"))
    bounded_batches(spark, 4096)

    def meet(table_: pa.Table) -> pa.Table:
        asks = table_.column("asks").to_numpy()
        ids = table_.column("vec_id").to_numpy()
        values = np.concatenate([x.flatten().to_numpy() for x in table_.column("v").chunks]).reshape(len(ids), -1)
        by_id = np.argsort(ids[~asks], kind="stable")
        c_ids, c = ids[~asks][by_id], np.ascontiguousarray(values[~asks][by_id].T)
        q_ids, rows = ids[asks], []
        at = np.searchsorted(c_ids, q_ids)
        own = np.array([a if a < len(c_ids) and c_ids[a] == x else -1 for a, x in zip(at, q_ids, strict=True)], np.int64)
        for b in range(0, len(q_ids), BLOCK_QUERIES):
            rows += [(int(q_ids[b + i]), x, s) for i, x, s in best_of_block(values[asks][b : b + BLOCK_QUERIES], c, c_ids, own[b : b + BLOCK_QUERIES], k)] if len(c_ids) else []
        return pa.table({n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    # One task to a pair of blocks, as far as there are partitions: packed by bytes, all pairs of a small table would meet in one.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = candidates.unionByName(asking).repartition(n, "dims", "cb", "qb").groupBy("dims", "cb", "qb").applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op10_columnar_top_k", SQL)
def op10_columnar_top_k(spark, folder) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    return top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
