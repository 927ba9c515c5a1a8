"""Benchmark decontamination by greedy string tiling.

Words of five-word seeds that a text shares with a benchmark item place the item in the text. There the item is tiled: the longest
matches that overlap no earlier match are marked first, found by Karp-Rabin hashes of word windows whose length falls pass by pass.
The share of an item's words under tiles is its coverage, whatever the order of the tiles, so reordered passages count in full.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import bounded_batches, fresh, portions, query, table

WORD = re.compile(r"\w+")
BASE, MASK = 1_000_003, (1 << 61) - 1
HIT = "array<struct<item_id:long,matched:long,n_words:long,coverage:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(codes: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin: (hash, start) of each window of ``size`` unmarked words, rolled along."""
    lead, h, run = pow(BASE, size, MASK), 0, 0
    for i, c in enumerate(codes):
        if not free[i]:
            h = run = 0
            continue
        h, run = (h * BASE + c) % MASK, run + 1
        if run > size:
            h = (h - codes[i - size] * lead) % MASK
        if run >= size:
            yield h, i - size + 1


def tile(item: list[str], text: list[str], least: int) -> int:
    """Words of ``item`` under tiles of at least ``least`` words, each of which occurs in ``text`` and overlaps no other tile there."""
    code: dict[str, int] = {}
    a, b = ([code.setdefault(w, len(code) + 1) for w in side] for side in (item, text))
    free_a, free_b = [True] * len(a), [True] * len(b)
    size, covered = max(least, min(len(a), len(b))), 0
    while size >= least:
        places = defaultdict(list)
        for h, i in windows(a, free_a, size):
            places[h].append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for h, j in windows(b, free_b, size) if places else ():
            for i in places.get(h, ()):
                if i and j and a[i - 1] == b[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue  # part of the match that starts a word earlier
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, j))
                    longest = max(longest, n)
        if longest > 2 * size:  # look again with long windows first
            size = longest
            continue
        heapify(found)
        while found:  # longest first; of a match partly under an earlier tile, the free runs go back in the queue
            n, i, j = heappop(found)
            free = [x and y for x, y in zip(free_a[i : i - n], free_b[j : j - n])]
            if all(free):
                free_a[i : i - n] = [False] * -n
                free_b[j : j - n] = [False] * -n
                covered -= n
                continue
            at = 0
            while at < -n:
                end = at
                while end < -n and free[end]:
                    end += 1
                if end - at >= size:
                    heappush(found, (at - end, i + at, j + at))
                at = end + 1
        size = least if size > least and size // 2 < least else size // 2
    return covered


class Items:
    """Benchmark items with an inverted index of their seeds. Items of fewer words than a seed are one seed each."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        self.seed, self.words = seed, {}
        seeds: dict[tuple, set[int]] = defaultdict(set)
        for k, (item_id, text) in enumerate(rows):
            if w := words_of(text):
                self.words[k] = (item_id, w)
                for i in range(max(1, len(w) - seed + 1)):
                    seeds[tuple(w[i : i + seed])].add(k)
        self.seeds = dict(seeds)
        self.by_size = defaultdict(set)
        for s in self.seeds:
            self.by_size[len(s)].add(s)

    def hits(self, text: str | None) -> dict[int, list[int]]:
        """For each item that shares a seed with the text, the places of its seeds."""
        w, out = words_of(text), defaultdict(list)
        for n, known in self.by_size.items():
            if not known.isdisjoint(zip(*(w[i:] for i in range(n)))):
                for at, s in enumerate(zip(*(w[i:] for i in range(n)))):
                    for k in self.seeds.get(s, ()):
                        out[k].append(at)
        return {k: (places, w) for k, places in out.items()}

    def matches(self, text: str | None, share: float) -> list[dict]:
        out = []
        for k, (places, w) in sorted(self.hits(text).items()):
            item_id, item = self.words[k]
            near: list[str] = []
            end = -1
            for at in places:  # only words that a tile could hold: within an item's length of a seed; a gap never matches
                low, high = max(at - len(item), 0), at + len(item)
                if low > end:
                    near.append("\0")
                near += w[max(low, end) : high]
                end = max(end, min(high, len(w)))
            matched = tile(item, near, min(self.seed, len(item)))
            if matched >= share * len(item):
                out.append({"item_id": item_id, "matched": matched, "n_words": len(item), "coverage": matched / len(item)})
        return out


def slices(benchmark: DataFrame, words_per_pass: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in parts of about ``words_per_pass`` words, one at a time on the driver: the bound of what a pass ships to tasks."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\W+")))).head()[0] or 0
    parts = -(-total // words_per_pass)
    for k in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield sorted((r.item_id, r.text) for r in mine.collect())


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, seed: int = 5, words_per_pass: int = 500_000) -> DataFrame:
    """``docs`` with an array column of the benchmark items of which at least ``share`` of the words lie under tiles, named ``hits`` (or
    ``hits_``... where that is taken).

    Each pass carries a part of the benchmark of bounded size to all documents; a benchmark of any size is read in as many passes.
    Null and empty texts have no hits, an empty benchmark gives none anywhere; rows with a null item_id or text are no items; equal rows
    of the benchmark count once. All rows and columns of ``docs`` are kept, repeated ones too. A row needs its own text only: no shuffle.
    """
    name = fresh(docs.columns, "hits")
    out = docs.withColumn(name, F.array().cast(HIT))
    for rows in slices(benchmark, words_per_pass):
        out = _scan(out, rows, name, share, seed)
    return out


def _scan(docs: DataFrame, rows: list[tuple[int, str]], name: str, share: float, seed: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, seed)
        for batch in portions(batches, "text"):
            at = batch.schema.get_field_index(name)
            hits = [old + items.matches(t, share) for t, old in zip(batch.column("text").to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(hits, batch.schema.field(at).type))

    return docs.mapInArrow(scan, docs.schema)


@query("op9_string_tiling")
def op9_string_tiling(spark, folder) -> DataFrame:
    """Each document with each benchmark item of which it holds half of the words or more."""
    found = find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
