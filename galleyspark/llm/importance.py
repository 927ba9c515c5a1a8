"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: one of labelled good texts (target), one of all texts (raw). A document's weight
is the ratio of their likelihoods. A sample is drawn without replacement in proportion to the weights by Gumbel top-k: a
document's key is its log weight plus Gumbel noise of its doc_id, and the k largest keys are the sample. k is the number of
documents whose weight passes the threshold that best separates the labelled good and bad rows.

The likelihood ratio of a whole text grows exponentially with its length, so a plain ratio samples lengths. Weights are therefore
those of ``grams`` n-grams: the mean log ratio of the text times ``grams``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import WordHash, bounded_batches, fresh, portions, query, settle, table

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 16
MIX, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
KEY_STEPS = 4096


def grams(texts: list[str | None], words: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, text by text, and their number per text. A word that repeats the one before
    it counts as the one word "again", so that repetition is a feature of its own."""
    code, sizes = words.codes([TOKEN.findall((t or "").lower()) for t in texts])
    first = np.zeros(len(code) + 1, bool)
    first[np.concatenate([[0], np.cumsum(sizes)])] = True
    first = first[:-1]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & ~first[1:]
    code = np.where(again, AGAIN, code)
    pair = np.zeros_like(code)
    pair[1:] = (code[:-1] * MIX + code[1:]) * MIX
    both = np.stack([code >> np.uint64(48), pair >> np.uint64(48)], 1).astype(np.int32)
    both[first, 1] = -1  # no pair before a text's first word
    flat = both.ravel()
    return flat[flat >= 0], np.where(sizes > 0, 2 * sizes - 1, 0)


def labelled_sample(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, quality), the same ones each time: the bound of what the fit reads of the labels."""
    rows = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_ratio(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio target/raw of each bucket, from one pass over all documents; a task sends its counts, one row for each bucket it saw."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, raw, good = WordHash(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in portions(batches, "text"):
            found, sizes = grams(batch.column("text").to_pylist(), words)
            raw += np.bincount(found, minlength=BUCKETS)
            mine = np.array([q == 1 for q in batch.column("quality").to_pylist()], bool)
            good += np.bincount(found[np.repeat(mine, sizes)], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "good"])

    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id", "left")
    counts = joined.select("text", "quality").mapInArrow(count, "bucket int, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(docs: DataFrame, ratio: np.ndarray, grams_held: int = 64, name: str = "log_weight") -> DataFrame:
    """``docs`` with the log weight in a column ``name``. Null texts and texts without a word have log weight 0, as much target as raw."""
    bounded_batches(docs.sparkSession)
    schema, packed = docs.withColumn(name, F.lit(0.0)).schema, ratio.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in portions(batches, "text"):
            found, sizes = grams(batch.column("text").to_pylist(), words)
            sums = np.concatenate([[0.0], np.cumsum(packed[found], dtype=np.float64)])
            ends = np.cumsum(sizes)
            mean = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
            yield batch.append_column(name, pa.array(np.round(mean * grams_held, 6)))

    return docs.mapInArrow(score, schema)


def gumbel(key: str):
    """Standard Gumbel noise of a key, the same in every run: -ln(-ln u) with u in (0, 1) from its hash."""
    return -F.log(-F.log((F.pmod(F.xxhash64(F.lit("gumbel"), F.col(key).cast("long")), F.lit(1 << 40)) + 0.5) / float(1 << 40)))


def best_threshold(rows: list[tuple[float, int]]) -> float:
    """Middle of the gap of log weights at which good minus bad rates differ most; minus infinity where one class is missing."""
    good, bad = sum(q for _, q in rows), sum(1 - q for _, q in rows)
    if not good or not bad:
        return -math.inf
    rows, best, at = sorted(rows), -1.0, -math.inf
    low_good = low_bad = 0
    for (w, q), after in zip(rows, [*(w for w, _ in rows[1:]), math.inf], strict=True):
        low_good, low_bad = low_good + q, low_bad + 1 - q
        if after > w and (gain := low_bad / bad - low_good / good) > best and after < math.inf:
            best, at = gain, (w + after) / 2
    return at


def kth_largest(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column, exact: a histogram of fixed size narrows the interval that holds it, round by round."""
    if k <= 0:
        return math.inf
    low, high = df.agg(F.min(key), F.max(key)).head()
    while low < high:
        step = (high - low) / KEY_STEPS
        inside = df.filter(F.col(key).between(low, high))
        spot = F.least(F.floor((F.col(key) - low) / step), F.lit(KEY_STEPS - 1))
        bins = inside.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if k <= b.n:
                break
            k -= b.n
        if (b.low, b.high) == (low, high):  # neighbouring doubles cannot be divided
            values = inside.groupBy(key).count().orderBy(F.desc(key)).head(KEY_STEPS)
            for value, n in values:
                if k <= n:
                    return value
                k -= n
        low, high = b.low, b.high
    return low


def resample(docs: DataFrame, labels: DataFrame, grams_held: int = 64, most: int = 20_000) -> DataFrame:
    """doc_id, ``log_weight``, ``key`` and ``kept`` for each row of ``docs(doc_id, text)``. Kept rows are the sample.

    All rows stay, rejected ones with kept false; rows of equal key (repeated rows) share one decision. Rows with a null doc_id share one
    noise; texts that are null or hold no word have log weight 0. Without labels of both kinds everything is kept. Other columns are
    not read. Weights are written to the shared folder once.
    """
    scored, cut, _ = _fitted(docs, labels, grams_held, most)
    return scored.withColumn("kept", F.col("key") >= cut)


def sampled(docs: DataFrame, labels: DataFrame, grams_held: int = 64, most: int = 20_000) -> DataFrame:
    """The kept rows of ``docs`` with all their columns: the decisions of ``resample``, from one more pass in place of a copy or a join of texts."""
    _, cut, ratio = _fitted(docs, labels, grams_held, most)
    weight = fresh(docs.columns, "log_weight")
    return weigh(docs, ratio, grams_held, weight).filter(F.col(weight) + gumbel("doc_id") >= cut).select(*docs.columns)


def _fitted(docs: DataFrame, labels: DataFrame, grams_held: int, most: int) -> tuple[DataFrame, float, np.ndarray]:
    """Weights and keys of all rows, the k-th largest key, and the model."""
    sample = settle(labelled_sample(labels, most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratio = fit_ratio(texts, sample)
    scored = settle(weigh(texts, ratio, grams_held).select("doc_id", "log_weight", (F.col("log_weight") + gumbel("doc_id")).alias("key")))
    known = scored.select("doc_id", F.col("log_weight").alias("w")).join(F.broadcast(sample), "doc_id")
    at = best_threshold([(r.w, r.quality) for r in known.groupBy("doc_id", "quality").agg(F.min("w").alias("w")).collect()])  # at most ``most`` rows
    k = scored.filter(F.col("log_weight") >= at).count()
    return scored, kth_largest(scored.select("key"), "key", k), ratio


@query("op5_importance_sample")
def op5_importance_sample(spark, folder) -> DataFrame:
    """The sampled documents with log weight and key."""
    out = resample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.filter("kept").select("doc_id", "log_weight", "key")
