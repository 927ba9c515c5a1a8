"""How the driver tables stand in for the logical tables (items, reviews, segments, ...).

Every binding exists twice: as a DataFrame and as a common table expression for the check SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.operators.editorial import ADVICE

NOW = "2024-01-31 00:00:00"  # the end of the event data
ITEM_NOW = "1998-06-15 00:00:00"  # inside the order data


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def items(t) -> DataFrame:
    """orders -> releases."""
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("s"), F.col("o_custkey") % 10).alias("source"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.to_date("o_orderdate").alias("day"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "A").otherwise("B").alias("tier"),
        F.col("o_totalprice").alias("duration"),
    )


ITEMS = """items AS (SELECT o_orderkey AS item_id, o_orderkey AS ordinal, 's' || (o_custkey % 10) AS source,
  o_custkey AS custkey, o_orderstatus AS title, o_orderdate AS published_at, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 'A' ELSE 'B' END AS tier, o_totalprice AS duration FROM orders)"""


def reviews(t) -> DataFrame:
    """lineitem -> one review per order key."""
    return (
        t.lineitem.groupBy(F.col("l_orderkey").alias("item_id"))
        .agg(
            F.max(F.col("l_partkey") % 6).cast("int").alias("density"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("any_r"),
            F.min((F.col("l_linestatus") == "F").cast("int")).alias("all_f"),
            F.max(F.col("l_linenumber")).alias("lines"),
        )
        .select(
            "item_id",
            (F.col("item_id") % 6).cast("int").alias("relevance"),
            "density",
            F.when((F.col("any_r") == 1) & (F.col("item_id") % 6 >= 4), "model_lab").otherwise("none").alias("priority"),
            F.when(F.col("all_f") == 1, "low").otherwise("high").alias("evidence_quality"),
            F.when(F.col("lines") >= 6, "low").otherwise("high").alias("ai_share"),
            F.element_at(F.array(*[F.lit(x) for x in ADVICE]), (F.col("lines") % 5 + 1).cast("int")).alias("recommendation"),
            (F.col("lines") - 1).alias("quotes"),
        )
    )


REVIEWS = """reviews AS (SELECT item_id, CAST(item_id % 6 AS INTEGER) AS relevance, CAST(density AS INTEGER) AS density,
  CASE WHEN any_r = 1 AND item_id % 6 >= 4 THEN 'model_lab' ELSE 'none' END AS priority,
  CASE WHEN all_f = 1 THEN 'low' ELSE 'high' END AS evidence_quality,
  CASE WHEN lines >= 6 THEN 'low' ELSE 'high' END AS ai_share,
  CASE lines % 5 WHEN 0 THEN '值得编译' WHEN 1 THEN '值得看全文' WHEN 2 THEN '看摘要' WHEN 3 THEN '值得看摘要' ELSE '无关' END AS recommendation,
  lines - 1 AS quotes
  FROM (SELECT l_orderkey AS item_id, max(l_partkey % 6) AS density, max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS any_r,
    min(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS all_f, max(l_linenumber) AS lines FROM lineitem GROUP BY 1))"""

# Scored reviews in SQL (relaxed policy), shared by several checks.
SCORED = """scored AS (SELECT *, (relevance + density) * 10 AS total,
  CASE WHEN priority <> 'none' THEN greatest(base, 4) ELSE base END AS stars,
  CASE WHEN priority <> 'none' AND relevance < 4 THEN 'priority_without_relevance'
       WHEN (relevance > 0 OR density > 0) AND quotes = 0 THEN 'score_without_quotes'
       WHEN density = 5 AND quotes < 2 THEN 'density_needs_two_quotes' END AS error
  FROM (SELECT *, CASE WHEN relevance = 5 AND density = 5 THEN 5
    WHEN (relevance >= 4 AND density >= 4) OR (relevance >= 3 AND density = 5) THEN 4
    WHEN relevance >= 3 AND density >= 3 THEN 3 WHEN relevance >= 2 AND density >= 2 THEN 2 ELSE 1 END AS base FROM reviews))"""


def events(t) -> DataFrame:
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def segments(t) -> DataFrame:
    """events -> timed segments: 60.5 s apart per user in time order. Jobs read a segment table more than once, so it is checkpointed."""
    from galleyspark.operators.ordered import dense_position
    from galleyspark.session import cut_lineage

    rows = events(t).withColumn("blk", F.to_date("ts"))
    placed = dense_position(rows, ["user_id"], ["blk"], ["ts", "event_id"], "n")
    start = 60.5 * (F.col("n") - 1).cast("double")
    return cut_lineage(placed.select(F.col("user_id").alias("item_id"), "n", start.alias("start"), (start + F.col("value")).alias("end"), "event_type", "event_id"))


SEGMENTS = """segments AS (SELECT user_id AS item_id, n, 60.5::DOUBLE*(n-1) AS start_s, 60.5::DOUBLE*(n-1)+value AS end_s, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""


def document_lines(t) -> DataFrame:
    """documents -> one array of trimmed, non-empty lines per row (no shuffle)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return t.documents.select("doc_id", "source", "lang", "n_chars", lines.alias("lines"))


def conversation_lines(t) -> DataFrame:
    """conversations -> lines; the first line of a turn carries the role as its label."""
    return t.conversations.select(
        F.col("conv_id").alias("item_id"), "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


CONV_LINES = """conv_lines AS (SELECT item_id, turn, role, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM (
  SELECT conv_id AS item_id, turn, role, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM conversations))"""


def arriving(rows: DataFrame, order: str, by: str, parts: int = 4) -> DataFrame:
    """A stream of ``rows`` that land in ``parts`` steps along ``order``, the rows of one ``by`` in one file of each step."""
    import uuid

    from galleyspark.session import cut_lineage, ensure_checkpoint_dir

    spark, rows = rows.sparkSession, cut_lineage(rows)  # every step reads what was made once
    folder = f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    for step in range(parts if low is not None else 0):
        place = F.least(F.floor((F.col(order) - low) * parts / (high - low + 1)), F.lit(parts - 1))
        rows.filter(place == step).repartition(by).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
