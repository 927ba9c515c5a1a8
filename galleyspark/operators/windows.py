"""Latest-row, carry-forward, island and coverage jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions.text import collapse, stripped
from galleyspark.operators.ordered import Running, dense_position, first_n, prefix_scan
from galleyspark.session import cut_lineage


def latest_fetch_status(fetch: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Latest row per (source, url) inside the window; ties go to the later insert."""
    recent = fetch.filter((F.col("run_at") >= now - F.make_dt_interval(F.lit(days))) & (F.col("run_at") <= now))
    newest = recent.groupBy("source", "url").agg(
        F.max(F.struct("run_at", "rowid", "source_type", "status", "reason")).alias("r"))
    return newest.select(
        "source", "url", "r.run_at", "r.source_type", "r.status", "r.reason",
        F.when(F.col("r.status") == "failed", "failed")
        .when((F.col("r.status") == "ok") & (F.col("r.reason") != ""), "recovered")
        .otherwise("healthy").alias("state"))


def pick_transcript(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """First verified transcript in provider order; otherwise why there is none.

    candidates: item_id, provider, provider_rank, paid, verified, error. Paid providers go last for video items.
    """
    joined = items.join(candidates, "item_id", "left")
    rank = F.when(F.col("is_video") & F.col("paid"), F.lit(1000)).otherwise(F.col("provider_rank"))
    return joined.groupBy("item_id").agg(
        F.min(F.when(F.col("verified"), F.struct(rank.alias("rank"), F.col("provider")))).alias("best"),
        F.bool_or(F.coalesce("error", F.lit(False))).alias("errored"),
    ).select("item_id", F.col("best.provider").alias("provider"),
             F.when(F.col("best").isNotNull(), "ok").when(F.col("errored"), "source_error").otherwise("no_transcript").alias("status"))


def merge_daily_items(daily_items: DataFrame) -> DataFrame:
    """Per day and item: the last ``summarized`` row of the day's runs, else the last row."""
    order = F.struct((F.col("status") == "summarized").alias("done"), "run_created_at", "run_key", "created_at", "result_key")
    return daily_items.groupBy("day", "item_id").agg(F.max_by(F.struct("status", "run_key", "result_key"), order).alias("r")).select(
        "day", "item_id", "r.status", "r.run_key", "r.result_key")


def carry_speaker(lines: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Unlabelled lines inherit the last label; a reset line forgets it. One scan: the last label-or-reset decides."""
    event = F.when(F.col("is_reset"), F.struct(F.lit(None).cast("string").alias("v"))).when(
        F.col("label").isNotNull(), F.struct(F.col("label").alias("v")))
    out = prefix_scan(lines, keys, block, order, carried=Running("last", event))
    return out.withColumn("speaker", F.col("carried.v")).drop("carried")


def merge_turns(blocks: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Join adjacent speech blocks of one speaker; a removed block is a boundary, a blank one is not.

    blocks: kind, speaker, text, removed. Other kinds stay as they are.
    """
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    live = blocks.withColumn("text", clean).filter(F.col("removed") | (F.col("text") != ""))
    state = F.struct(F.col("kind"), F.col("speaker"), F.col("removed"))
    seen = prefix_scan(live, keys, block, order, prev=Running("last", state, before=True))
    joins = (F.col("prev").isNotNull() & ~F.col("prev.removed") & (F.col("kind") == "speech") & (F.col("prev.kind") == "speech")
             & F.col("prev.speaker").eqNullSafe(F.col("speaker")))
    starts = seen.withColumn("starts", F.when(F.col("removed") | joins, 0).otherwise(1).cast("long")).drop("prev")
    if block:  # the second scan reads its input twice
        starts = cut_lineage(starts)
    islands = prefix_scan(starts, keys, block, order, island=Running("sum", "starts")).filter(~F.col("removed"))
    return islands.groupBy(*keys, "island").agg(
        F.min("kind").alias("kind"), F.min("speaker").alias("speaker"), F.count("*").alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"]), " ").alias("text"))


def coverage_measures(segments: DataFrame, bridge: float, keys: Sequence[str] = ("item_id",), block: Sequence[str] = ("blk",)) -> DataFrame:
    """First start, last end, largest gap and covered seconds per item from one running maximum.

    A gap up to ``bridge`` counts as covered. Each segment adds what it extends past the furthest end so far,
    so islands never have to be built.
    """
    ran = prefix_scan(segments, keys, block, ["start", "end"], reach=Running("max", "end", before=True))
    gap = F.col("start") - F.col("reach")
    adds = F.when(F.col("reach").isNull() | (gap > bridge), F.col("end") - F.col("start")).otherwise(
        F.greatest(F.col("end") - F.col("reach"), F.lit(0.0)))
    return ran.groupBy(*keys).agg(
        F.min("start").alias("first_start"), F.max("end").alias("merged_end"),
        F.max_by("end", F.struct("start", "end")).alias("last_sorted_end"),
        F.greatest(F.max(gap), F.lit(0.0)).alias("max_gap"), F.sum(adds).alias("covered"), F.max("duration").alias("duration"))


def strict_coverage(segments: DataFrame) -> DataFrame:
    """Timed text must reach from the opening to the closing with few holes. segments: item_id, start, end, duration."""
    live = segments.filter((F.col("end") > F.col("start")) & (F.col("end") > 0) & (F.col("start") < F.col("duration"))).select(
        "item_id", F.greatest(F.col("start"), F.lit(0.0)).alias("start"), F.least("end", "duration").alias("end"), "duration",
        F.floor(F.greatest(F.col("start"), F.lit(0.0)) / 600).alias("blk"))
    m = coverage_measures(live, bridge=30.0)
    d = F.col("duration")
    ok = ((d > 0) & (F.col("first_start") <= 30) & (F.col("last_sorted_end") >= d - F.greatest(F.lit(45.0), d * 0.01))
          & (F.coalesce("max_gap", F.lit(0.0)) <= 60) & (F.col("covered") >= d * 0.90))
    return m.withColumn("complete", ok)


def caption_coverage(segments: DataFrame) -> DataFrame:
    """Caption rule: overlaps merge, small slack at both ends, bounded gaps."""
    live = segments.filter(F.col("end") > F.col("start")).select(
        "item_id", "start", "end", "duration", F.floor(F.col("start") / 600).alias("blk"))
    m = coverage_measures(live, bridge=0.0)
    d = F.col("duration")
    slack = F.least(F.lit(180.0), d * 0.10)
    ok = ((d > 0) & (F.col("first_start") <= slack) & (d - F.col("merged_end") <= slack)
          & (F.col("merged_end") - F.col("first_start") >= d * 0.85) & (F.col("covered") >= d * 0.65)
          & (F.coalesce("max_gap", F.lit(0.0)) <= F.least(F.lit(180.0), F.greatest(F.lit(60.0), d * 0.03))))
    return m.withColumn("complete", ok)


def anchor_coverage(anchors: DataFrame, head: float, head_max: float, tail: float, tail_max: float) -> DataFrame:
    """Show-note stamps must lie near both ends. anchors: item_id, at, duration."""
    m = anchors.groupBy("item_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("duration").alias("duration"))
    d = F.col("duration")
    return m.withColumn("covered", (F.col("first_at") <= F.least(F.lit(head_max), d * head))
                        & (F.col("last_at") >= d - F.least(F.lit(tail_max), d * tail)))


def run_length_speakers(lines: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Speaker changes in order: repeats collapsed."""
    ran = prefix_scan(lines, keys, block, order, prev=Running("last", "speaker", before=True))
    return ran.filter(F.col("prev").isNull() | (F.col("prev") != F.col("speaker"))).drop("prev")


def non_decreasing(rows: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Per key: does ``value`` never fall below its previous row, and at how many rows does it."""
    ran = prefix_scan(rows, keys, block, order, prev=Running("last", value, before=True))
    falls = F.count_if(F.col(value) < F.col("prev"))
    return ran.groupBy(*keys).agg(F.count("*").alias("n"), falls.alias("falls"), (falls == 0).alias("in_order"))


def recent_turns(turns: DataFrame, now: Column, keep: int = 4, hours: int = 168, user_chars: int = 500, assistant_chars: int = 2000) -> DataFrame:
    """Last exchanges per session: an assistant turn with the user turn right before it.

    turns: session, turn, role, text, at. Sessions idle for longer than ``hours`` give nothing.
    """
    t = turns.withColumn("blk", F.floor(F.col("turn") / 256))
    ran = prefix_scan(t, ["session"], ["blk"], ["turn"], prev=Running("last", F.struct("role", "text"), before=True))
    user = F.substring(collapse(F.col("prev.text")), 1, user_chars)
    reply = F.substring(stripped("text"), 1, assistant_chars)
    pairs = ran.filter((F.col("role") == "assistant") & (F.col("prev.role") == "user")).select(
        "session", "turn", "at", user.alias("user"), reply.alias("assistant")).filter((F.col("user") != "") & (F.col("assistant") != ""))
    alive = pairs.groupBy("session").agg(F.max("at").alias("updated_at")).filter(
        now - F.col("updated_at") <= F.make_dt_interval(F.lit(0), F.lit(hours)))
    last = first_n(pairs.drop("at"), ["session"], [F.desc("turn")], keep, "age_rank")
    return last.join(alive, "session")


def ready_head(work: DataFrame, now: Column) -> DataFrame:
    """Claimable work: per session the oldest pending message if nothing runs and it is due; other kinds when due.

    work: rowid, job_key, kind, session, status, created_at, available_at, scheduled (is a dated daily run).
    """
    msg = work.filter(F.col("kind") == "message")
    heads = msg.groupBy("session").agg(
        F.min(F.when(F.col("status") == "pending", F.struct("created_at", "rowid", "available_at"))).alias("h"),
        F.bool_or(F.col("status") == "processing").alias("busy"),
    ).filter(~F.col("busy") & F.col("h").isNotNull() & (F.col("h.available_at") <= now)).select(
        F.col("h.rowid").alias("rowid"), F.lit("message").alias("kind"), "session", F.col("h.created_at").alias("created_at"), F.lit(0).alias("kind_class"))
    rest = work.filter((F.col("kind") != "message") & (F.col("status") == "pending") & (F.col("available_at") <= now)).select(
        "rowid", "kind", "session", "created_at", F.when((F.col("kind") == "daily") & F.col("scheduled"), 1).otherwise(2).alias("kind_class"))
    return heads.unionByName(rest)


def previous_task(turns: DataFrame) -> DataFrame:
    """Latest task and outcome per session."""
    return turns.groupBy("session").agg(F.max_by(F.struct("task", "outcome", "turn"), "turn").alias("r")).select(
        "session", "r.turn", "r.task", "r.outcome")


def with_duration(segments: DataFrame) -> DataFrame:
    """Attach each item's duration: its segment count times the stamp distance."""
    total = segments.groupBy("item_id").agg((60.5 * F.count("*")).alias("duration"))
    return segments.join(total, "item_id")


__all__ = [n for n in dir() if not n.startswith("_")] + ["dense_position"]
