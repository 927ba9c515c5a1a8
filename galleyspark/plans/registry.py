"""Registry of named jobs over the driver tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galleyspark.session import dealt

TEXT_TABLES = ("documents", "pages", "conversations")
JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return dealt(table) if name in TEXT_TABLES else table

    def stream(self, name: str) -> DataFrame:
        """A table as a stream. Streams read folders only, so a table that is one file is picked from its folder by name."""
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        source = self.spark.readStream.schema(table.schema)
        if all(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
            return source.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return source.parquet(f"{self.folder}/{name}.parquet")


def job(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in JOBS:
            raise ValueError(f"job registered twice: {name}")
        JOBS[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            CHECKS[name] = sql
        return fn

    return add
