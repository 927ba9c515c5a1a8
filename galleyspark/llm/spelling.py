"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other. With the longer word of m code points that
is so exactly if common prefix plus common suffix reach m - 1; then one of both holds m // 2 code points at least. Words of m and of m - 1
code points that share such a prefix, or such a suffix, therefore form the groups in which near words meet, and no pair is lost.

A group is dealt into blocks of bounded size, and pairs of blocks are tiles. Within a tile, padded matrices of code points are compared
column by column from both ends. A pair whose common prefix reaches m // 2 counts in prefix tiles only, so no pair counts twice.

Null and empty texts have no words. Words may be of any length: the longer they are, the fewer make a block. Rows that repeat a doc_id are
texts of their own; a null doc_id reads as empty. Equal numbers go to the smaller word by code points. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import portions, query, settle, table

RUN, LEAST, OFTEN, SLIP, RATIO = r"[A-Za-zÀ-ÿ]", 7, 2, 31, 10
BLOCK_WORDS, BLOCK_POINTS = 1024, 1 << 21  # words in a block, and their code points
SMALL, PAIRS, HELD = 48, 200_000, 1 << 25  # words in a tile that is compared by a list of pairs; pairs at once; bytes held while counting
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN, slip: int | None = SLIP) -> DataFrame:
    """word, n: lower-cased runs of letters of at least ``least`` code points and ``often`` occurrences.

    With ``slip``, runs whose crc32 with their document's id is divisible by it lose one code point first.
    """
    run = re.compile(f"{RUN}{{{least},}}")  # shorter runs never grow

    def count(batches):
        tally, held = Counter(), 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
        for part in portions(batches, "text"):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                begin = f"{'' if i is None else i}:"
                for raw, k in Counter(run.findall(text or "")).items():
                    word = raw.lower() if raw.isascii() else raw.translate(_ASCII_LOWER)
                    h = zlib.crc32((begin + word).encode()) if slip else 1
                    if slip and h % slip == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= least:
                        held += 0 if word in tally else len(word) + 120
                        tally[word] += k
                if held > HELD:
                    yield flush()
                    tally, held = Counter(), 0
        if tally:
            yield flush()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def tiles(words: DataFrame) -> DataFrame:
    """m, side, part, i, j, word, n: the words of each tile, blocks i and j of the group of (m, side, part)."""
    size = F.length("word")
    key = lambda m, side: F.struct(m.alias("m"), F.lit(side).alias("side"), F.xxhash64((F.left if side == "p" else F.right)(F.col("word"), F.floor(m / 2).cast("int"))).alias("part"))
    keyed = settle(words.select("word", "n", F.explode(F.array(*[key(m, s) for m in (size, size + 1) for s in "ps"])).alias("k")).select("k.*", "word", "n"))
    group = ["m", "side", "part"]
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(BLOCK_POINTS / F.col("m"))))
    blocks = keyed.groupBy(*group).agg(F.count("*").alias("size"), F.max(F.length("word")).alias("longest"))
    blocks = blocks.filter("size > 1 and longest = m").select(*group, F.ceil(F.col("size") / room).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit("block"), "word"), F.col("blocks")).cast("int")
    dealt = keyed.join(blocks, group).select(*group, "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


@lru_cache(SMALL + 1)
def _corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def code_points(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of code points, padded at the end and, reversed, at the end again: prefixes and suffixes both run from column 0."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    flat = flat.astype(np.uint8) if flat.max(initial=0) < 256 else flat
    begin = sizes.cumsum() - sizes
    row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)
    ahead = np.zeros((len(sizes), sizes.max(initial=0) + 1), flat.dtype)
    back = np.zeros_like(ahead)
    ahead[row, at], back[row, np.repeat(sizes, sizes) - 1 - at] = flat, flat
    return ahead, back


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which each row of a agrees with each row of b."""
    live, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        live &= a[:, k, None] == b[None, :, k]
        if not live.any():
            break
        out += live
    return out


def near_pairs(words: list[str], sizes: np.ndarray, m: np.ndarray, prefix_side: np.ndarray, own: np.ndarray, same: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of near words of the tiles ``first[t]:last[t]``. m, prefix_side and same (one block meets itself)
    hold for each word's tile; ``own`` marks the words of its first block."""
    ahead, back = code_points(words, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(x, y, pre, suf):
        ok = (pre + suf >= m[x] - 1) & ((pre >= m[x] // 2) == prefix_side[x]) & ((sizes[x] == m[x]) | (sizes[y] == m[x]))
        found.append((x[ok], y[ok]))

    listed, count = [], 0

    def settle_list():
        if listed:
            x, y = (np.concatenate(c) for c in zip(*listed, strict=True))
            for s in range(0, len(x), PAIRS):
                a, b = x[s : s + PAIRS], y[s : s + PAIRS]
                wide = int(m[a].max()) + 1
                keep(a, b, (ahead[a, :wide] != ahead[b, :wide]).argmax(1), (back[a, :wide] != back[b, :wide]).argmax(1))
        listed.clear()

    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        left, right = f + np.flatnonzero(own[f:e]), f + np.flatnonzero(~own[f:e])
        if e - f <= SMALL:
            x, y = (c + f for c in _corner(e - f)) if same[f] else (c.ravel() for c in np.meshgrid(left, right, indexing="ij"))
            listed.append((x, y))
            count += len(x)
            if count > PAIRS:
                settle_list()
                count = 0
            continue
        for s in range(0, len(left), 128):  # a strip of the tile at a time
            a, b, wide = left[s : s + 128], left[s:] if same[f] else right, int(m[f]) + 1
            pre = agreeing(ahead[a, :wide], ahead[b, :wide])
            suf = agreeing(back[a, :wide], back[b, :wide])
            x, y = np.nonzero(pre + suf >= m[f] - 1)
            if same[f]:
                x, y = x[x < y], y[x < y]
            keep(a[x], b[y], pre[x, y], suf[x, y])
    settle_list()
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: both directions of each pair of distinct near words of a table of word, n."""
    tile = ["m", "side", "part", "i", "j"]
    spark = words.sparkSession
    dealt = tiles(words).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *tile).sortWithinPartitions(*tile)

    def compare(batches):
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            new = tile_starts(held)
            yield from links(held.slice(0, new[-1]), new[:-1])  # the last tile may go on in the next batch
            rest = held.slice(new[-1]) if len(new) else None
        if rest is not None and rest.num_rows:
            yield from links(rest, tile_starts(rest))

    def tile_starts(held):
        cols = [held.column(c).to_numpy() for c in ("m", "part", "i", "j")] + [held.column("side").to_numpy(zero_copy_only=False) == "p"]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) if held.num_rows else np.zeros(0, int)

    def links(held, starts):
        if not held.num_rows:
            return
        words = held.column("word").to_pylist()
        n, i, j = (held.column(c).to_numpy() for c in ("n", "i", "j"))
        x, y = near_pairs(words, np.fromiter(map(len, words), np.int64, len(words)), held.column("m").to_numpy().astype(np.int64), held.column("side").to_numpy(zero_copy_only=False) == "p",
                          held.column("own").to_numpy() == i, i == j, starts, np.r_[starts[1:], held.num_rows])
        both, other = np.r_[x, y], np.r_[y, x]
        text = held.column("word").combine_chunks()
        yield pa.RecordBatch.from_arrays([text.take(pa.array(both)), text.take(pa.array(other)), pa.array(n[other])], ["word", "near", "near_n"])

    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root: a word's form is its most frequent near word, if ``ratio`` times as frequent; root is the last form of forms."""
    words = settle(words)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    held = -F.col("best.order") >= ratio * F.col("n").cast("decimal(38,0)")
    rows = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.order")).alias("form_n")))
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5 if ratio > 1 else 6):  # each step doubles the forms passed; n grows by the ratio with each form: at most 18 forms of ten times, 62 of twice
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = settle(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@query("op13_prefix_suffix_tiles")
def op13_prefix_suffix_tiles(spark, folder) -> DataFrame:
    """Spelling variants of all words of seven letters and more that occur twice."""
    return variants(word_counts(table(spark, folder, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
