"""Which texts hold which patterns, for very many patterns of any script.

While all patterns together stay under a counted limit they travel to the tasks as one automaton, and each text is read once. Beyond it,
each pattern is keyed by its rarest character n-gram, texts emit the n-grams that key some pattern, and only such pairs are compared.
Neither way compares all texts with all patterns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.session import cut_lineage

LIMIT = 4_000_000  # characters of all patterns that one automaton may hold
BATCH = 512  # texts that a Python worker holds at a time, set for the session
GRAMS = (2, 4, 8)  # a pattern is keyed by n-grams of the largest of these that it holds
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def holds_whole(body: str, end: int, size: int) -> bool:
    """Does the occurrence that ends before ``end`` stand between characters other than a-z and 0-9?"""
    return (end == size or body[end - size - 1] not in _WORD) and (end == len(body) or body[end] not in _WORD)


def contained(texts: DataFrame, patterns: DataFrame, whole: bool = False, limit: int = LIMIT) -> DataFrame:
    """item_id, pattern, n: patterns with their occurrences, which may overlap. texts: item_id, body. patterns: pattern, two characters or more.

    ``whole`` counts only occurrences between characters other than a-z and 0-9. Shorter patterns and nulls match nothing.
    """
    wanted = patterns.filter(F.length("pattern") >= GRAMS[0]).select("pattern").distinct()
    size = wanted.agg(F.sum(F.length("pattern"))).first()[0] or 0
    return _by_automaton(texts, [r.pattern for r in wanted.collect()], whole) if size <= limit else _by_grams(texts, wanted, whole)


def _by_automaton(texts: DataFrame, patterns: list[str], whole: bool) -> DataFrame:
    kind = dict(texts.dtypes)["item_id"]
    held = texts.sparkSession.sparkContext.broadcast(patterns)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))

    def search(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in held.value:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            items, found, times = [], [], []
            for item, body in zip(batch["item_id"], batch["body"], strict=True):
                counts: dict[str, int] = {}
                for last, p in machine.iter(body) if body and held.value else ():
                    if not whole or holds_whole(body, last + 1, len(p)):
                        counts[p] = counts.get(p, 0) + 1
                items += [item] * len(counts)
                found += counts.keys()
                times += counts.values()
            yield pd.DataFrame({"item_id": pd.Series(items, dtype=batch["item_id"].dtype), "pattern": pd.Series(found, dtype="object"), "n": pd.Series(times, dtype="int64")})

    return texts.select("item_id", "body").mapInPandas(search, f"item_id {kind}, pattern string, n long")


def _grams(df: DataFrame, column: str, sizes: tuple[int, ...], keep: list[str]) -> DataFrame:
    """``keep``, gram: the distinct n-grams, of all ``sizes``, of each text of ``column``."""
    kinds = dict(df.dtypes)

    def cut(batches):
        for batch in batches:
            rows = []
            for *values, body in zip(*(batch[c] for c in keep), batch[column], strict=True):
                rows += [[*values, g] for g in {body[i : i + q] for q in sizes for i in range(len(body or "") - q + 1)}]
                if len(rows) > 200_000:
                    yield pd.DataFrame(rows, columns=[*keep, "gram"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keep, "gram"])

    return df.select(*keep, column).mapInPandas(cut, ", ".join([f"{c} {kinds[c]}" for c in keep] + ["gram string"]))


def _by_grams(texts: DataFrame, patterns: DataFrame, whole: bool) -> DataFrame:
    band = F.when(F.length("pattern") >= GRAMS[2], GRAMS[2]).when(F.length("pattern") >= GRAMS[1], GRAMS[1]).otherwise(GRAMS[0])
    sized = patterns.select("pattern", F.col("pattern").alias("text"), band.alias("q"))
    own = None
    for q in GRAMS:
        part = _grams(sized.filter(F.col("q") == q), "text", (q,), ["pattern"])
        own = part if own is None else own.unionByName(part)
    own = cut_lineage(own)
    emitted = cut_lineage(_grams(texts.withColumnRenamed("body", "text"), "text", GRAMS, ["item_id"]).join(own.select("gram").distinct(), "gram", "left_semi"))
    often = own.join(emitted.groupBy("gram").agg(F.count("*").alias("texts")), "gram", "left").groupBy("pattern")
    key = often.agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("k")).filter("k.texts > 0").select("pattern", F.col("k.gram").alias("gram"))
    pairs = emitted.join(key, "gram").select("item_id", "pattern").join(texts, "item_id")
    kinds = dict(texts.dtypes)

    def count(batches):
        for batch in batches:
            rows = []
            for item, body, p in zip(batch["item_id"], batch["body"], batch["pattern"], strict=True):
                at, n = body.find(p), 0
                while at >= 0:
                    n += not whole or holds_whole(body, at + len(p), len(p))
                    at = body.find(p, at + 1)
                if n:
                    rows.append((item, p, n))
            yield pd.DataFrame(rows, columns=["item_id", "pattern", "n"])

    return pairs.select("item_id", "body", "pattern").mapInPandas(count, f"item_id {kinds['item_id']}, pattern string, n long")
