"""Toxic passages by maximum-scoring segments of token log-odds.

Words, and their first letters where a word itself is too rare to know, get the log-odds of toxic against other labelled documents under a
Dirichlet prior in proportion to their overall rate. Those of a high z-score carry their log-odds, all other words the small
negative log ratio of not being such a word. One linear scan finds every maximal segment of a text. Scores are log likelihood ratios, so a
text of n words holds n * exp(-S) segments of score S by chance (the extreme-value law with both constants 1); a segment is significant
where that number is small. The text's best segment, as -ln of that number, is turned into a probability on labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import bounded_batches, fresh, portions, query, settle, table

WORD = re.compile(r"\w+")
STEMS = (5, 4)
SEGMENTS = "array<struct<first_word:long,last_word:long,score:double,by_chance:double>>"


class Model(NamedTuple):
    odds: dict[str, float]  # of a word, or of "^" and first letters
    other: float  # of any other word
    slope: float = 1.0
    offset: float = 0.0


class Scores(dict):
    """Score of a word, held for words seen before; emptied when ``most`` are held."""

    def __init__(self, model: Model, most: int = 300_000):
        self.odds, self.other, self.most = model.odds, model.other, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        known = (self.odds.get("^" + word[:k]) for k in STEMS if len(word) > k)
        self[word] = got = self.odds.get(word) or next((x for x in known if x), self.other)
        return got


def features(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {"^" + w[:k] for w in words for k in STEMS if len(w) > k}


def maximal_segments(scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one pass. Only positive words and the gaps between them need a look."""
    places = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before it, sum up to its end
    total, at = 0.0, 0
    for i in places.tolist():
        total += other * (i - at)
        first, left, right = i, total, total + float(scores[i])
        total, at = right, i + 1
        last = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((first, last, left, right))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r in stack]


def learning_rows(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, toxic), the same ones each time: the bound of what is learned from."""
    rows = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(docs: DataFrame, rows: DataFrame, prior: float = 0.05, least_docs: int = 5, z: float = 3.0) -> Model:
    """Log-odds of words over the labelled documents of ``rows``, each word counted once for a document. ``prior`` is the weight of the
    Dirichlet prior, the overall rates, as a share of the counts."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(by[0].keys() | by[1].keys())
            got = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in by)], ["feature", "clean", "toxic"])
            for c in by:
                c.clear()
            return got

        for batch in portions(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update(features(text))
            if len(by[0]) + len(by[1]) > 400_000:
                yield out()
        yield out()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    counts = settle(texts.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    n0, n1 = (x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).head())
    if not n0 or not n1:
        return Model({}, -0.01)
    a, total = F.lit(prior) * (F.col("clean") + F.col("toxic")), prior * (n0 + n1)
    odds = F.log((F.col("toxic") + a) / (n1 + total - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (n0 + total - F.col("clean") - a))
    sure = counts.filter(F.col("toxic") >= least_docs).withColumn("odds", odds).filter(F.col("odds") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)) >= z)
    known = {r.feature: r.odds for r in sure.select("feature", "odds").filter("odds > 2").collect()}  # at most the words of the bounded sample over least_docs
    share = sum(r.toxic for r in sure.filter(~F.col("feature").startswith("^")).select("toxic").collect()) / n1
    return Model(known, math.log(1 - min(max(share, 1e-3), 0.2)))


def find_segments(docs: DataFrame, model: Model, level: float = 0.05) -> DataFrame:
    """``docs`` with ``evidence`` (-ln of the chance number of segments as good as the best one) and ``segments``, the significant ones.

    Names get ``_`` where taken. Null and empty texts, and texts without a toxic word, have no segment; their evidence is -ln of
    their number of words, or 0. All rows and columns are kept; a row needs its own text only.
    """
    bounded_batches(docs.sparkSession)
    names = [fresh(docs.columns, n) for n in ("evidence", "segments")]
    schema = docs.withColumns({names[0]: F.lit(0.0), names[1]: F.array().cast(SEGMENTS)}).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("by_chance", pa.float64())]))
        for batch in portions(batches, "text"):
            best, found = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").lower())
                n = max(len(words), 1)
                got = maximal_segments(np.fromiter(map(scores.__getitem__, words), float, len(words)), model.other)
                best.append(max((s for *_, s in got), default=0.0) - math.log(n))
                found.append([{"first_word": a, "last_word": b, "score": s, "by_chance": e} for a, b, s in got if (e := n * math.exp(-s)) <= level])
            yield batch.append_column(names[0], pa.array(best)).append_column(names[1], pa.array(found, kind))

    return docs.mapInArrow(scan, schema)


def calibrate(known: DataFrame, steps: int = 400) -> tuple[float, float]:
    """Slope and offset of the log odds of toxic by evidence, from a histogram of all labelled rows; penalised so that it stays finite."""
    spot = F.round(F.least(F.greatest(F.col("evidence"), F.lit(-20.0)), F.lit(60.0)) * (steps / 80)) / (steps / 80)
    rows = known.groupBy(spot.alias("x")).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()  # at most steps + 1 rows
    x, t, n = (np.array([float(r[i]) for r in rows]) for i in range(3))
    if not len(rows) or not t.sum() or t.sum() == n.sum():
        share = (t.sum() + 1) / (n.sum() + 2) if len(rows) else 0.5
        return 0.0, math.log(share / (1 - share))
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -35, 35)))
        design = np.stack([x, np.ones_like(x)], 1)
        grad = design.T @ (t - n * p) - 1e-2 * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grad)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def probability(model: Model, evidence: str) -> Column:
    return 1 / (1 + F.exp(-(F.lit(model.slope) * F.least(F.greatest(F.col(evidence), F.lit(-20.0)), F.lit(60.0)) + F.lit(model.offset))))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where labels of a row must not be learned from: crc32 of doc_id as text has remainder 1 of 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op2_toxic_segments")
def op2_toxic_segments(spark, folder, most: int = 50_000) -> DataFrame:
    """Toxicity of every document, learned from at most ``most`` labelled rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = settle(learning_rows(table(spark, folder, "labels").filter(~held_out()), most))
    model = learn(docs, rows)
    found = settle(find_segments(docs, model).select("doc_id", "evidence", F.size("segments").alias("n_segments")))
    slope, offset = calibrate(found.join(F.broadcast(rows), "doc_id"))
    score = probability(model._replace(slope=slope, offset=offset), "evidence")
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), "evidence", "n_segments")
