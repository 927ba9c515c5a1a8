"""Mixing sources to target weights by Pfair scheduling; documents are touched by DataFrame functions only.

Sources are cut into blocks of ``block_docs`` documents, one block to a slot. With w the exact target share of a source, its j-th block is
released at slot floor(j / w) and due by slot ceil((j + 1) / w). Earliest-deadline-first gives each slot to a released block; as shares add up to
one, it meets all deadlines, so after any slot a source is less than one block from its share. When a source ends, a new phase begins at
that slot, in which the others share on in proportion.

The timetable is metadata of bounded size: at most ``most_slots`` blocks, and at least one for each source. It is made from the sources' counts alone, in integers,
and sent to tasks as one array of slots for each source. Beyond ``most_slots * block_docs`` documents blocks become larger.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleyspark.llm.base import fresh, query, table

DOCS_TO_BUCKET = 2048
UNITS = 1 << 40  # shares are whole numbers of this size


def edf_slots(blocks: list[int], weights: list[int]) -> list[list[int]]:
    """The slots of each source's blocks. A source of weight 0 comes when only such are left, and shares equally with them then.

    Of the released blocks the one with the earliest deadline goes, of equals that of the smaller source number.
    """
    slots: list[list[int]] = [[] for _ in blocks]
    live, t = [s for s, n in enumerate(blocks) if n], 0
    while live:
        share = {s: weights[s] for s in live if weights[s]} or dict.fromkeys(live, 1)
        total, start, had = sum(share.values()), t, dict.fromkeys(share, 0)
        waiting, ready = [], []  # (release, source), (deadline, source)
        for s in share:
            heappush(waiting, (0, s))
        while True:
            while waiting and waiting[0][0] <= t - start:
                s = heappop(waiting)[1]
                heappush(ready, (-(-(had[s] + 1) * total // share[s]), s))
            s = heappop(ready)[1]  # blocks released so far are more than slots given so far
            slots[s].append(t)
            had[s], t = had[s] + 1, t + 1
            if len(slots[s]) == blocks[s]:
                live.remove(s)
                break
            heappush(waiting, (had[s] * total // share[s], s))
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 16, temper: float = 0.5, most_slots: int = 1 << 20) -> DataFrame:
    """``docs`` with ``source_no``, ``block``, ``slot`` and ``position`` (names get ``_`` where taken); ascending ``position`` is the mix.

    ``weights``: target share by source; sources without one, and null, divide what is left of 1 in proportion to their documents, and come last
    where nothing is left. Without ``weights`` a source counts by its document number to the power ``temper``, the null source too.
    Within a source, documents go in the order of a hash of doc_id; repeated rows follow one another. All rows are kept: no source is cut or
    repeated. Texts are not read, of whatever length. An empty table stays empty. A source is ranked in hash ranges of about DOCS_TO_BUCKET rows, not as one group.
    """
    spark = docs.sparkSession
    number, block, slot, position = (fresh(docs.columns, n) for n in ("source_no", "block", "slot", "position"))
    bucket, rank, before, of = (fresh([*docs.columns, number, block, slot, position], n) for n in ("bucket", "rank", "before", "of_source"))
    sizes = sorted((tuple(r) for r in docs.groupBy(F.col("source").cast("string").alias("source")).count().collect()), key=lambda r: (r[0] is None, r[0] or ""))  # a row to a source
    total = sum(n for _, n in sizes)
    block_docs = max(block_docs, -(-total // most_slots))
    if weights is None:
        shares = [float(n) ** temper for _, n in sizes]
    else:
        rest, others = max(0.0, 1.0 - sum(weights.values())), sum(n for s, n in sizes if s not in weights)
        shares = [weights[s] if s in weights else rest * n / others for s, n in sizes]
    whole = sum(shares) or 1.0
    units = [max(1, round(w / whole * UNITS)) if w > 0 else 0 for w in shares]
    slots = edf_slots([-(-n // block_docs) for _, n in sizes], units)
    times = spark.createDataFrame([(s, i, x) for i, ((s, _), x) in enumerate(zip(sizes, slots, strict=True))], f"`{of}` string, `{number}` int, `{slot}` array<int>")
    bits = min(30, max(8, math.ceil(math.log2(max(total, 1) / DOCS_TO_BUCKET + 1))))

    hashed = F.xxhash64(F.col("doc_id").cast("long"))
    numbers = F.broadcast(times.select(of, number))
    own = F.col("source").cast("string").eqNullSafe(F.col(of))
    placed = docs.join(numbers, own).drop(of).withColumn(bucket, F.shiftrightunsigned(hashed, 64 - bits).cast("int"))
    counts = docs.select("source", F.shiftrightunsigned(hashed, 64 - bits).cast("int").alias(bucket)).join(numbers, own).groupBy(number, bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(number).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(number, bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(number, bucket).orderBy(hashed, "doc_id")
    ranked = placed.withColumn(rank, F.row_number().over(inside)).join(starts, [number, bucket])
    at = F.col(before) + F.col(rank) - 1
    dealt = ranked.withColumns({block: F.floor(at / block_docs), before: at % block_docs}).join(F.broadcast(times.select(number, slot)), number)
    dealt = dealt.withColumn(slot, F.get(slot, F.col(block).cast("int")).cast("long"))
    return dealt.withColumn(position, F.col(slot) * block_docs + F.col(before)).select(*docs.columns, number, block, slot, position)


def in_order(mixed: DataFrame, columns: list[str], position: str = "position") -> DataFrame:
    """The mix as the order of the written files: ranges of positions, each sorted."""
    return mixed.repartitionByRange(position).sortWithinPartitions(position).select(*columns)


@query("op6_pfair_mix")
def op6_pfair_mix(spark, folder) -> DataFrame:
    """Every document with its block, slot and position in the mix."""
    return mix(table(spark, folder, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "slot", "position")
