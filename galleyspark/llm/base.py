"""Registry and helpers of the operators in this subpackage."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from galleyspark.session import ensure_checkpoint_dir

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``, with check SQL where SQL can express it."""

    def add(fn):
        JOBS[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that clashes with none of ``columns`` (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: lineage ends there, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = folder or f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of ``settle`` that no plan reads any more, as all that was made of them is written. Shuffle files of finished jobs go too:
    Spark drops them when the driver's garbage is collected, which a driver at rest seldom does."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.java.lang.System.gc()


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Spark sizes an array as one element, an explode as its input and a file as it is compressed,
    so that it takes sides of many times its limit for small, and builds them on the driver."""
    return df.hint("merge")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Few rows to an Arrow batch, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def portions(batches: Iterable[pa.RecordBatch], text: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``size`` bytes of text, or one row."""
    for batch in batches:
        begin = held = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            if held and held + (n or 0) > size:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


class WordHash(dict):
    """64-bit hash of a word, kept for words seen before; emptied when ``most`` words are held."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got

    def codes(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in one array, and the number of words of each text."""
        if len(self) > self.most:
            self.clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.uint64, int(sizes.sum())), sizes
