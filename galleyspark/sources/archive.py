"""The transcript archive: upsert, content-addressed export and manifests. Snapshots are overwritten by partition; no table format is assumed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.functions.text import NOT_BLANK
from galleyspark.session import cut_lineage


def archive_upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Latest version of every item with the time it was first stored. Only complete, non-empty texts enter.

    Both: item_id, updated_at, verified, text and any other columns; each with one row for an item and time, of equal times the new one counts. Which
    row is the latest is found without texts; texts are then joined to it once.
    """
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).filter(F.col("verified") & F.col("text").rlike(NOT_BLANK))
    versions = both.groupBy("item_id").agg(F.max(F.struct("updated_at", "__new")).alias("v"), F.min("updated_at").alias("stored_at")).select("item_id", "v.*", "stored_at")
    rest = [c for c in both.columns if c not in ("item_id", "text", "__new")]
    return both.join(versions, ["item_id", "updated_at", "__new"]).select(
        "item_id", *rest, "text", "stored_at", F.sha2("text", 256).alias("content_sha256"), F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 8).alias("reference"))


def slug(name):
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def export_index(transcripts: DataFrame, digests: DataFrame) -> DataFrame:
    """Where each current revision is stored, and which rows no longer match their ledger hash.

    transcripts: item_id, show, title, published_day, text, content_sha256, revision. digests: item_id, content_sha256, revision, digest.
    """
    d = digests.select("item_id", F.col("content_sha256").alias("d_sha"), F.col("revision").alias("d_rev"), "digest")
    j = transcripts.join(d, "item_id", "left")
    fresh = (F.col("d_sha") == F.col("content_sha256")) & (F.col("d_rev") == F.col("revision")) & (F.col("digest") != "")
    summary = F.when(fresh, F.sha2("digest", 256)).otherwise("no-summary")
    show_key = F.concat(slug(F.col("show")), F.lit("-"), F.substring(F.sha2("show", 256), 1, 8))
    item_key = F.concat(F.coalesce("published_day", F.lit("undated")), F.lit("-"), slug(F.col("title")), F.lit("-"), F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 16))
    ok = (F.col("text") != "") & (F.sha2("text", 256) == F.col("content_sha256"))
    return j.select("item_id", show_key.alias("show_key"), F.concat(F.lit("shows/"), show_key, F.lit("/"), item_key, F.lit("/revisions/"), "revision", F.lit("/"), summary).alias("directory"),
                    F.when(ok, "exported").otherwise("hash_mismatch").alias("state"))


def _stored(spark, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_export(transcripts: DataFrame, digests: DataFrame, path: str) -> DataFrame:
    """Bring the archive below ``path`` up to date; returns the index that it now has. Arguments as of ``export_index``.

    ``files`` holds each revision once, under a directory that names its content, by show; earlier revisions stay. ``index`` lists the current
    ones. ``manifest``, written last, has path and hash of each file, so a reader that finds a manifest finds what it lists. A run that was
    cut short is repeated as it is: what is stored already is not written again, and two runs leave the same files.
    """
    spark = transcripts.sparkSession
    index = cut_lineage(export_index(transcripts, digests))
    held = _stored(spark, f"{path}/files", "directory string").select("directory")
    kept = transcripts.select("item_id", "text", "content_sha256", "revision").join(digests.select("item_id", F.col("content_sha256").alias("d_sha"), F.col("revision").alias("d_rev"), "digest"), "item_id", "left")
    fresh = (F.col("d_sha") == F.col("content_sha256")) & (F.col("d_rev") == F.col("revision"))
    rows = kept.withColumn("digest", F.when(fresh, F.col("digest"))).join(index.filter("state = 'exported'").select("item_id", "show_key", "directory"), "item_id").join(held, "directory", "left_anti")
    rows = cut_lineage(rows.select("directory", "item_id", "text", "content_sha256", "revision", "digest", "show_key"))
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy("show_key").parquet(f"{path}/files")
    index.write.mode("overwrite").parquet(f"{path}/index")
    if not index.filter("state = 'exported'").isEmpty():
        cut_lineage(read_files(spark, f"{path}/files")).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/index")


def read_export(spark, path: str) -> DataFrame:
    """Current revisions of an exported archive: item_id, directory, text, digest, state; ``state`` tells texts that their ledger hash does not fit."""
    current = spark.read.parquet(f"{path}/index").filter("state = 'exported'").select("directory")
    rows = spark.read.parquet(f"{path}/files").join(current, "directory")
    return rows.select("item_id", "directory", "text", "digest", F.when(F.sha2("text", 256) == F.col("content_sha256"), "intact").otherwise("changed").alias("state"))


def read_files(spark, path: str) -> DataFrame:
    """Files below a folder with their content hash."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Missing, extra and changed files. Both: path, sha256."""
    j = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("got")), "path", "full")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("got"), "changed")
    return j.select("path", state.alias("state")).filter("state is not null")
