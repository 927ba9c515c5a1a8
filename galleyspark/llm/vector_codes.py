"""Vector codes: product codebooks of integer vectors, assigned through an integer Walsh-Hadamard transform.

Components become integers, vectors are cut into equal parts, each part is coded by the nearest entry of its position's codebook. Parts
and entries are zero-padded to a power of two L and transformed by the Walsh-Hadamard matrix in sequency order, whose first rows gather
most of what differs. As the matrix is L times an orthogonal one, squared differences of transformed values add up to L times the squared
distance: the sum grows coefficient by coefficient, entries over the distance of the best guess go at once, and all of it is integer work.

Codebooks start from the smallest ids; each round is one pass over the vectors that returns one sum and count per part and entry, which
bounds what reaches the driver by the size of the codebooks.

Vectors that are null, or hold null or non-finite components or components of which ``floor(scale * x)`` reaches 2**24, are left out. Vectors
shorter than the longest one, and lengths that are no multiple of ``parts``, are filled with zeros at the end. Rows that repeat a vec_id are
all coded; a codebook starts from the smallest vector of a repeated id, and null ids count as one id after all others. With fewer ids than
``entries`` the codebooks are smaller, and an empty table gives no rows. Ties go to the lower entry. Other columns are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import fresh, query, settle, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT, WIDEST = 1 << 24, 32  # integers of up to 25 bits in parts of up to 32 components: sums of squares stay below 2**63
ROWS = 4096


def quantised(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a sound vector, and ``q``: its components as integers, floor(scale * x), in place of the vector."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * scale))
    sound = F.forall(F.transform(embedding, lambda v: v.cast("double") * scale), lambda v: v.isNotNull() & ~F.isnan(v) & (v < LIMIT) & (v >= -LIMIT))
    q = fresh(vectors.columns, "q")
    kept = vectors.filter(F.col(embedding).isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.withColumn(q, x.cast("array<int>")).drop(embedding)


def walsh(size: int) -> np.ndarray:
    """Walsh-Hadamard matrix of a power of two, rows by sequency (their number of sign changes)."""
    h = reduce(lambda m, _: np.block([[m, m], [m, -m]]), range(size.bit_length() - 1), np.ones((1, 1), np.int64))
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def padded(rows: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, L): the parts of each row, filled with zeros up to a power of two."""
    width = rows.shape[1] // parts
    out = np.zeros((len(rows), parts, 1 << max(0, width - 1).bit_length()), np.int64)
    out[:, :, :width] = rows.reshape(len(rows), parts, width)
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed parts (n, L) the first nearest of transformed entries (m, L) and the sum of its squared differences.

    The guess is the entry nearest in the first coefficient; its whole sum bounds the others. (row, entry) pairs whose partial sum
    passes the bound go after each coefficient; the bound is never below the least sum, so no nearest entry goes.
    """
    kind = np.int64 if parts.shape[1] <= WIDEST else object
    parts, entries = parts.astype(kind), entries.astype(kind)
    first = (parts[:, :1] - entries[:, 0]) ** 2
    bound = ((parts - entries[first.argmin(1)]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(1, parts.shape[1]):
        total = total + (parts[row, k] - entries[entry, k]) ** 2
        live = total <= bound[row]
        row, entry, total = row[live], entry[live], total[live]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # pairs lie by row, then entry; each row kept one
    least = np.minimum.reduceat(total, begin) if len(begin) else total
    hit = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[begin, len(row)])))
    at = hit[np.unique(row[hit], return_index=True)[1]]
    return entry[at], total[at]


def assigned(q: np.ndarray, books: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each row's parts (row, part), and the squared distance of each. books: (part, entry, width)."""
    x = padded(q, parts)
    size = x.shape[2]
    turn = walsh(size).T
    book = padded(books.transpose(1, 0, 2).reshape(books.shape[1], -1), parts) @ turn
    x = x @ turn
    found = [nearest(x[:, p], book[:, p]) for p in range(parts)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] // size for f in found], 1)


def matrices(batches, column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of Arrow batches with their vectors as a matrix of ``width`` columns, filled with zeros."""
    for whole in batches:
        for begin in range(0, whole.num_rows, ROWS):
            batch = whole.slice(begin, ROWS)
            col = batch.column(column)
            sizes, values = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy()
            out = np.zeros((batch.num_rows, width), np.int64)
            out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.r_[0, sizes.cumsum()[:-1]], sizes)] = values
            yield batch, out


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of a table of vec_id and q (array of int). At most ``entries`` vectors reach the driver at once."""
    width = vectors.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(1, -(-width // parts)) * parts
    ids = vectors.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries)
    seeds = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "seed")), F.col("vec_id").eqNullSafe(F.col("seed"))).groupBy("vec_id").agg(F.min("q").alias("q"))
    start = [r.q + [0] * (width - len(r.q)) for r in seeds.orderBy(F.asc_nulls_last("vec_id")).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if start else 0):

        def sums(batches, books=books):
            total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for _, q in matrices(batches, "q", width):
                code, _ = assigned(q, books, parts)
                cut = q.reshape(len(q), parts, -1)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=books.shape[1])
                    for j in range(cut.shape[2]):  # ROWS values of 25 bits add up exactly in doubles
                        total[p, :, j] += np.bincount(code[:, p], cut[:, p, j], books.shape[1]).astype(np.int64)
            at = np.argwhere(count)
            names = ("part", "entry", "n", "sums")
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[tuple(at.T)]), pa.array(list(total[tuple(at.T)]), pa.list_(pa.int64()))], names)

        local = vectors.select("q").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        cells = local.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for c in cells.collect():  # parts * entries * width integers at most
            books[c.part, c.entry, c["at"]] = int(c.x) // c.n
    return books


def encode(vectors: DataFrame, books: np.ndarray, column: str = "q") -> DataFrame:
    """Adds ``code`` (two hex digits a part) and ``error`` (squared distances over the parts) in place of the integer vector."""
    parts, width = books.shape[0], books.shape[0] * books.shape[2]
    rest = [f for f in vectors.schema if f.name != column]
    code_name, error_name = fresh(vectors.columns, "code"), fresh(vectors.columns, "error")

    def run(batches):
        for batch, q in matrices(batches, column, width):
            code, error = assigned(q, books, parts)
            text = [bytes(r).hex() for r in code.astype(np.uint8)] if books.shape[1] <= 256 else ["".join(f"{v:04x}" for v in r) for r in code]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in rest] + [pa.array(text, pa.string()), pa.array([int(e) for e in error.sum(1)], pa.int64())], [f.name for f in rest] + [code_name, error_name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{code_name}` string", f"`{error_name}` long"])
    return vectors.mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _round(k: int) -> str:
    """Check SQL of one round: assignment a<k>, codebooks c<k + 1>."""
    return f"""
a{k} AS (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT t.rid, t.p, c.e, CAST(list_sum(list_transform(range(1, len(t.x) + 1), lambda i: (t.x[i] - c.x[i]) * (t.x[i] - c.x[i]))) AS BIGINT) AS d FROM parts t JOIN c{k} c USING (p)) GROUP BY rid, p),
s{k} AS (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT p, a.e, unnest(range(1, len(t.x) + 1)) AS i, unnest(t.x) AS v FROM a{k} a JOIN parts t USING (rid, p)) GROUP BY p, e, i),
n{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e),
c{k + 1} AS (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN n{k} n USING (p, e)),"""


SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) r(p)),
c0 AS (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}),{_round(0)}{_round(1)}
a2 AS (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT t.rid, t.p, c.e, CAST(list_sum(list_transform(range(1, len(t.x) + 1), lambda i: (t.x[i] - c.x[i]) * (t.x[i] - c.x[i]))) AS BIGINT) AS d FROM parts t JOIN c2 c USING (p)) GROUP BY rid, p),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), book"""


@query("op11_walsh_codes", SQL)
def op11_walsh_codes(spark, folder) -> DataFrame:
    """Codes of 16 parts from 64 entries after two rounds, with the errors of rows and labels."""
    data = settle(quantised(table(spark, folder, "embeddings").select("vec_id", "embedding", "label")))
    books = learn(data.select("vec_id", "q"))
    rows = settle(encode(data, books))
    by_label = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    found = rows.join(by_label.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
