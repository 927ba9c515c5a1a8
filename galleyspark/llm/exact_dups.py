"""Exact duplicates by stateful streaming.

Texts are normalised and digested as they stream in. One keyed state, in RocksDB on disk and without expiry, retains for each digest the
smallest identifier, the locator of its text (file and row) and the number of rows. Its checkpoint lies in the shared folder, so a lost
executor resumes from it, and a later call with the same folder reads new files only and holds them against all earlier ones.

A digest is only a hint. Rows whose digest the state counts more than once are hits; each is compared byte by byte with the text at the
retained locator. Where texts of one digest differ, the rows of that digest are grouped by their whole texts instead.

Hot groups: state is combined before the shuffle; a text goes through a shuffle only if its digest may repeat (a bitmap of fixed size says
so); hits of one digest are dealt out over salts, ``per_salt`` rows each, each with a copy of the retained text.

Null texts count as empty. Of rows that repeat identifier and text the first by file and row stays. Null identifiers come after all others.
An empty table gives no rows. Texts are compared whole, of any length. Other columns are not read. No Python code runs on rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyspark.llm.base import query, settle
from galleyspark.session import ensure_checkpoint_dir

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside in each
}
FILTER_BITS, BUCKET_BITS = 1 << 23, 1 << 15  # a bitmap of 1 MB, in rows of 4 KB


def normalised(text: Column) -> Column:
    r"""``[\x20\x09-\x0D]+`` as one space; the pattern runs only over texts in which spaces meet."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)


def located(rows: DataFrame, text: str, identifier: str, digest) -> DataFrame:
    """text (normalised), digest, and at: place of the row in the order in which rows stay (missing, id, file, row)."""
    meta = rows.metadataColumn("_metadata")
    read = rows.select(F.col(identifier).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    read = read.withColumn("text", normalised(F.col("text")))
    return read.select("text", digest(F.col("text")).alias("digest"), F.struct(F.col("id").isNull().alias("missing"), "id", "file", "row").alias("at"))


def digest_state(spark: SparkSession, path: str, state: str, text: str, identifier: str, digest, least: int = 1, files_per_batch: int = 10_000) -> DataFrame:
    """Stream the files that ``state`` has not seen into it; returns digest, at (of the row that stays), n (rows) of the digests of ``least`` rows and more."""
    schema = spark.read.parquet(path).schema
    first = spark.read.parquet(path).limit(1)
    one_file = first.select(first.metadataColumn("_metadata")["file_path"].alias("f")).first()
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if one_file and one_file.f.rsplit("/", 1)[1] == name:  # a stream reads folders only
        rows = source.option("pathGlobFilter", name).parquet(folder)
    else:
        rows = source.parquet(path)
    seen = located(rows, text, identifier, digest).groupBy("digest").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        run = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        held = spark.read.format("statestore").load(state).select("key.digest", F.col("value.min").alias("at"), F.col("value.count").alias("n"))
        return settle(held.filter(F.col("n") >= least))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def may_repeat(rows: DataFrame, repeated: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``hint``: false only where the digest is not among those of ``repeated``. The bitmap has ``bits`` bits at any size of the tables."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    spot, place = F.floor(slot / BUCKET_BITS).cast("int"), F.pmod(slot, F.lit(BUCKET_BITS)).cast("int")
    bitmap = repeated.select(spot.alias("spot"), place.cast("long").alias("place")).groupBy("spot").agg(F.bitmap_construct_agg("place").alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, place % 8)")) != 0
    return rows.withColumns({"spot": spot, "place": place}).join(F.broadcast(bitmap), "spot", "left").withColumn("hint", F.coalesce(held, F.lit(False))).drop("spot", "place", "bitmap")


def exact_duplicates(spark: SparkSession, path: str, text: str = "text", identifier: str = "doc_id", state: str | None = None, digest=None, per_salt: int = 1000) -> DataFrame:
    """One row for each row of the Parquet table at ``path``: at (identifier, file and row), keep_at (of the row that stays), group_size, kept, text_sha256.

    ``state`` names the folder of a state to go on from; None starts a new one in the checkpoint folder. ``digest`` maps a text to its
    digest, SHA-256 by default; a weaker one costs time, not correctness.
    """
    digest = digest or (lambda t: F.sha2(t, 256))
    state = state or f"{ensure_checkpoint_dir(spark)}/exact-{uuid.uuid4().hex}"
    repeated = digest_state(spark, path, state, text, identifier, digest, least=2)
    rows = may_repeat(located(spark.read.parquet(path), text, identifier, digest), repeated)
    sha = F.sha2("text", 256).alias("text_sha256")
    rows = settle(rows.select("at", "digest", "hint", sha, F.when(F.col("hint"), F.col("text")).alias("text")))
    group = repeated.select("digest", F.col("at").alias("keep_at"), F.col("n").alias("group_size"))
    hinted = settle(rows.filter("hint").join(group, "digest", "left").drop("hint"))
    result = ("at", "keep_at", "group_size", "text_sha256")
    single = rows.filter("not hint").unionByName(hinted.filter("keep_at is null"), allowMissingColumns=True)
    single = single.select("at", F.col("at").alias("keep_at"), F.lit(1).cast("long").alias("group_size"), "text_sha256")

    salts = F.ceil(F.col("group_size") / per_salt).cast("int")
    members = hinted.filter("keep_at is not null")
    kept = members.filter("at = keep_at").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    hits = members.filter("at <> keep_at").withColumn("salt", F.pmod(F.xxhash64("at"), salts))
    checked = hits.join(kept, ["digest", "salt"], "left").select(*result, "digest", F.coalesce(F.col("text") == F.col("kept_text"), F.lit(False)).alias("same"))
    checked = settle(checked)
    found = single.unionByName(members.filter("at = keep_at").select(*result)).unionByName(checked.select(*result))
    if not checked.filter("not same").isEmpty():  # different texts of one digest
        mixed = checked.filter("not same").select("digest").distinct()
        apart = members.join(mixed, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(F.min("at").alias("keep_at"), F.count("*").alias("group_size"))
        apart = apart.drop("keep_at", "group_size").join(groups, ["digest", "text"]).select(*result)
        alike = found.join(members.join(mixed, "digest", "left_semi").select("at"), "at", "left_anti")
        found = alike.unionByName(apart)
    return found.withColumn("kept", F.col("at") == F.col("keep_at"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)"""


@query("op12_streaming_dedup", SQL)
def op12_streaming_dedup(spark, folder) -> DataFrame:
    """For each document the one of equal text that stays."""
    found = exact_duplicates(spark, f"{str(folder).rstrip('/')}/documents.parquet")
    return found.select(F.col("at.id").alias("doc_id"), F.col("keep_at.id").alias("keep_id"), "group_size", "kept", "text_sha256")
