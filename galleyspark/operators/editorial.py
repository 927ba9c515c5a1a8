"""Scores, reading advice, review look-ups and backtests. Everything is a column rule over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions.text import normalised
from galleyspark.operators.containment import contained

# The five reading recommendations.
ADVICE = ["值得编译", "值得看全文", "看摘要", "值得看摘要", "无关"]
COMPILE, FULL_TEXT, SUMMARY, MAYBE_SUMMARY, IRRELEVANT = ADVICE


def base_stars(r: Column, d: Column) -> Column:
    return (F.when((r == 5) & (d == 5), 5).when(((r >= 4) & (d >= 4)) | ((r >= 3) & (d == 5)), 4)
            .when((r >= 3) & (d >= 3), 3).when((r >= 2) & (d >= 2), 2).otherwise(1))


def evidence_error(r: Column, d: Column, quotes: Column) -> Column:
    return F.when(((r > 0) | (d > 0)) & (quotes == 0), "score_without_quotes").when((d == 5) & (quotes < 2), "density_needs_two_quotes")


def score_reviews(reviews: DataFrame) -> DataFrame:
    """Stars from relevance and density with a floor for priority topics; contradictions become an error column.

    reviews: item_id, relevance, density, priority, quotes (number of distinct grounded quotes).
    """
    r, d = F.col("relevance"), F.col("density")
    priority = F.col("priority") != "none"
    stars = F.when(priority, F.greatest(base_stars(r, d), F.lit(4))).otherwise(base_stars(r, d))
    error = F.when(priority & (r < 4), "priority_without_relevance").otherwise(evidence_error(r, d, F.col("quotes")))
    return reviews.select("*", ((r + d) * 10).alias("total"), stars.alias("stars"), (stars >= 3).alias("selected"), error.alias("error"))


def score_reviews_strict(reviews: DataFrame) -> DataFrame:
    """Strict policy: floors need evidence, recommendations set ceilings, thin evidence or few AI topics cap the stars.

    Adds evidence_quality, ai_share and recommendation to the input columns of ``score_reviews``.
    """
    r, d, quality = F.col("relevance"), F.col("density"), F.col("evidence_quality")
    priority = (F.col("priority") != "none") & (r >= 4)
    floored = F.when(priority & (quality != "low"), F.greatest(base_stars(r, d), F.when(d >= 3, 4).otherwise(3))).otherwise(base_stars(r, d))
    ceiling = (F.when(F.col("recommendation") == COMPILE, 5).when(F.col("recommendation") == FULL_TEXT, 4)
               .when(F.col("recommendation").isin(SUMMARY, MAYBE_SUMMARY), 3).otherwise(2))
    capped = F.least(floored, ceiling, F.when((quality == "low") | (r < 3), 2).otherwise(5))
    thin = F.col("ai_share") == "low"
    stars = F.when(thin, F.least(capped, F.lit(3))).otherwise(capped)
    error = evidence_error(r, d, F.col("quotes"))
    error = F.coalesce(error, F.when((quality == "low") & (d >= 3), "low_evidence_high_density"))
    return reviews.select(
        *[c for c in reviews.columns if c not in ("priority", "recommendation")],
        F.when(r < 4, "none").otherwise(F.col("priority")).alias("priority"),
        F.when(thin, MAYBE_SUMMARY).otherwise(F.col("recommendation")).alias("recommendation"),
        ((r + d) * 10).alias("total"), stars.alias("stars"), (stars >= 3).alias("selected"), error.alias("error"))


def reading_advice(scored: DataFrame) -> DataFrame:
    """The advice shown after the policy was applied. scored: output of ``score_reviews_strict``."""
    rec, stars = F.col("recommendation"), F.col("stars")
    shown = F.when((F.col("evidence_quality") == "low") | (stars < 3), IRRELEVANT).otherwise(rec)
    shown = (F.when(stars < 3, IRRELEVANT).when((stars == 4) & (shown == COMPILE), FULL_TEXT)
             .when((stars == 3) & shown.isin(COMPILE, FULL_TEXT), SUMMARY).otherwise(shown))
    return scored.withColumn("advice", F.when(F.col("ai_share") == "low", MAYBE_SUMMARY).otherwise(shown))


def reading_level(advice: Column, stars: Column) -> Column:
    """2, 1 or 0 from explicit advice, else from five or four stars."""
    explicit = F.when(F.trim(advice) == COMPILE, 2).when(F.trim(advice) == FULL_TEXT, 1).otherwise(0)
    return F.when(advice.isNotNull(), explicit).otherwise(F.when(stars == 5, 2).when(stars == 4, 1).otherwise(0))


def representation_score(items: DataFrame) -> DataFrame:
    """How much a representation of a release is preferred among its copies."""
    flag = lambda c, points: F.when(c, points).otherwise(0)
    score = (flag(F.col("has_transcript"), 40) + flag(F.col("official_page"), 30) + flag(F.col("is_video"), 20)
             + flag(F.col("duration") > 0, 2) + flag(F.col("published_at").isNotNull(), 1) - flag(F.col("is_discovery"), 100))
    return items.withColumn("score", score)


def active_focus(focus: DataFrame, today: Column) -> DataFrame:
    """Focus entries that have not expired."""
    return focus.filter(F.col("expires_on") >= today)


def focus_mentions(docs: DataFrame, focus: DataFrame) -> DataFrame:
    """Whole-word mentions of focus names, in any script. docs: item_id (unique), text. focus: focus_id, name (at least 2 characters)."""
    names = focus.select("focus_id", normalised("name").alias("pattern"))
    found = contained(docs.select("item_id", normalised("text").alias("body")), names, whole=True)
    return found.join(names, "pattern").select("item_id", "focus_id")


def reviews_in_run(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews whose time lies inside a run. runs: run_id, created_at, updated_at. reviews: item_id, created_at, ....

    A range join keyed by hour: a run emits one row per hour it touches, a review has exactly one hour.
    """
    r = runs.select("run_id", F.col("created_at").alias("run_from"), F.col("updated_at").alias("run_to"),
                    F.explode(F.sequence(F.date_trunc("hour", "created_at"), F.date_trunc("hour", "updated_at"), F.expr("interval 1 hour"))).alias("slot"))
    v = reviews.withColumn("slot", F.date_trunc("hour", "created_at"))
    return v.join(r, "slot").filter(F.col("created_at").between(F.col("run_from"), F.col("run_to"))).drop("slot")


def last_in_run(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each item's last review inside each run, so one row for each run and item. runs: run_id (unique), created_at, updated_at, ....

    reviews: item_id, created_at (once per item), .... A review counts for the runs that end before the item's next one. That time comes from a scan of the
    reviews, so the rows of runs and items, which grow with the product of runs and reviews at a time, leave the join as they are and are not shuffled.
    """
    from galleyspark.operators.ordered import Running, prefix_scan

    v = reviews.select("*", F.col("created_at").alias("__made"), (-F.unix_micros("created_at")).alias("__back"), (-F.unix_date(F.to_date("created_at"))).alias("__day"))
    v = prefix_scan(v, ["item_id"], ["__day"], ["__back"], __next=Running("last", "__made", before=True)).drop("created_at", "__back", "__day")
    hours = F.sequence(F.date_trunc("hour", "created_at"), F.date_trunc("hour", "updated_at"), F.expr("interval 1 hour"))
    r = runs.distinct().select("*", F.explode(hours).alias("__hour"))
    hit = v.withColumn("__hour", F.date_trunc("hour", "__made")).join(r, "__hour").filter(F.col("__made").between(F.col("created_at"), F.col("updated_at")))
    return hit.filter(F.col("__next").isNull() | (F.col("__next") > F.col("updated_at"))).select(*runs.columns, *[c for c in reviews.columns if c != "created_at"])


def review_as_of(asks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest relaxed review of an item at or before a time; ties by cache key.

    asks: run_id, item_id, at. reviews: item_id, created_at, cache_key, policy, payload columns. The as-of join runs as one
    scan: asks and reviews of an item are laid on one time line and each ask takes the last review before it, so an item
    with many asks and many reviews never forms their product.
    """
    from galleyspark.operators.ordered import Running, prefix_scan

    relaxed = reviews.filter(~F.col("policy").startswith("strict-selection-"))
    best = relaxed.groupBy("item_id", "created_at").agg(F.min_by(F.struct(*[c for c in reviews.columns if c != "item_id"]), "cache_key").alias("review"))
    line = best.select("item_id", F.col("created_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(asks.schema["run_id"].dataType).alias("run_id"), "review")
    line = line.unionByName(asks.select("item_id", "at", F.lit(1).alias("side"), "run_id", F.lit(None).cast(best.schema["review"].dataType).alias("review")))
    line = line.withColumn("blk", F.to_date("at"))
    ran = prefix_scan(line, ["item_id"], ["blk"], ["at", "side"], found=Running("last", "review"))
    return ran.filter(F.col("side") == 1).select("run_id", "item_id", "at", F.col("found").alias("review"))


def backtest(pairs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Stored stars against stars without the priority floor, per local day and item.

    pairs: day, item_id, review (struct with relevance, density, priority, quotes, policy; null if none). Without a
    transcript, or with evidence errors, the second score is unknown.
    """
    j = pairs.join(transcripts.select("item_id", F.lit(True).alias("has_text")), "item_id", "left")
    r, d = F.col("review.relevance"), F.col("review.density")
    known = F.col("review").isNotNull()
    stored = F.when(F.col("review.priority") != "none", F.greatest(base_stars(r, d), F.lit(4))).otherwise(base_stars(r, d))
    plain = F.when(known & F.col("has_text") & evidence_error(r, d, F.col("review.quotes")).isNull(), base_stars(r, d))
    return j.select(
        "day", "item_id", F.when(known, stored).alias("stars"), r.alias("relevance"), d.alias("density"), F.col("review.priority").alias("priority"),
        plain.alias("without_floor"), (F.when(known, stored) > plain).alias("floor_raised"),
        F.when(known, F.when(stored >= 3, "in").otherwise("out")).otherwise("?").alias("verdict"))


def document_eligible(digests: DataFrame, min_stars: int = 4, strict: bool = False) -> DataFrame:
    """Digests good enough for a reading document, best first. digests: item_id, stars, advice, ordinal."""
    keep = F.col("stars") >= min_stars
    if strict:
        keep = keep & (F.col("stars") >= 4) & F.trim("advice").isin(COMPILE, FULL_TEXT)
    return digests.filter(keep).orderBy(F.desc("stars"), "ordinal")


def edition_manifest(records: DataFrame) -> DataFrame:
    """Hash per edition over its ordered (item, revision) list and its pending rows.

    records: edition, rank, item_id, revision (null if pending), status. An edition is a capped list, so its manifest is small.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "item_id", F.coalesce("revision", F.lit("pending")), "status").alias("entry"))))
    text = F.array_join(F.transform(entries, lambda s: s["entry"]), "|")
    return records.groupBy("edition").agg(F.count("*").alias("entries"), F.count_if(F.col("revision").isNull()).alias("pending"), F.sha2(text, 256).alias("manifest"))
