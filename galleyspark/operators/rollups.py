"""Counts, health tables and set jobs over runs, results and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galleyspark.functions.text import BLANKS
from galleyspark.operators.ordered import Running, dense_position, first_n, fold_in_order, independent_runs, prefix_scan
from galleyspark.session import cut_lineage, dealt_rows

# Result statuses, those that wait for work, and those the health view may name.
PENDING_STATUSES = ["no_transcript", "unverified_date", "summary_format_error"]
REPORTED_STATUSES = ["summarized", "no_transcript", "editorial_filtered", "discovery_filtered", "summary_format_error",
                     "discovery_status", "unverified_date", "failed", "outside_window"]


def coverage_counts(daily_items: DataFrame, shown: int = 6) -> DataFrame:
    """Per run: one count per status, the pending total, the first few pending items and how many more there are."""
    counts = daily_items.groupBy("run_key").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in REPORTED_STATUSES],
        F.count_if(F.col("status").isin(PENDING_STATUSES)).alias("pending"))
    head = first_n(daily_items.filter(F.col("status").isin(PENDING_STATUSES)).select("run_key", "seq", "item_id"),
                   ["run_key"], [F.col("seq")], shown)
    listed = head.groupBy("run_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "item_id"))), lambda s: s["item_id"].cast("string")), ",").alias("listed"))
    return counts.join(listed, "run_key", "left").select(
        *counts.columns, F.coalesce("listed", F.lit("")).alias("listed"), F.greatest(F.col("pending") - shown, F.lit(0)).alias("more"))


def assign_status(items: DataFrame, transcripts: DataFrame, reviews: DataFrame, digests: DataFrame, now: Column,
                  lookback_hours: int, short_seconds: float = 900.0) -> DataFrame:
    """One status per candidate; the first rule that holds wins.

    items: item_id, published_at, is_video, duration, is_discovery. reviews: item_id, stars, error. digests: item_id, usable.
    """
    j = (items.join(transcripts.select("item_id", F.lit(True).alias("has_text")), "item_id", "left")
         .join(reviews.select("item_id", "stars", F.col("error").alias("review_error")), "item_id", "left")
         .join(digests.select("item_id", "usable"), "item_id", "left"))
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    status = (F.when(F.col("published_at").isNull(), "unverified_date")
              .when(F.col("published_at") < cutoff, "outside_window")
              .when(F.col("is_video") & (F.col("duration") < short_seconds), "final_skipped")
              .when(F.col("has_text").isNull(), "no_transcript")
              .when(F.col("review_error").isNotNull(), "failed")
              .when(F.col("stars") < 3, F.when(F.col("is_discovery"), "discovery_filtered").otherwise("editorial_filtered"))
              .when(~F.coalesce("usable", F.lit(False)), "summary_format_error")
              .otherwise("summarized"))
    return j.select("item_id", status.alias("status"))


def run_health(days: DataFrame, now: Column, start_minutes: int = 510, grace_minutes: int = 45) -> DataFrame:
    """State of each local day's run from its pre-aggregated facts, with the time of the last complete send up to then.

    days: day, subscribed, has_run, analysis_complete, sends, sent, last_sent_at; one row per day. ``now`` is local wall time.
    """
    scheduled = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(start_minutes))
    delivered = (F.col("sends") > 0) & (F.col("sends") == F.col("sent"))
    complete = delivered & F.col("has_run") & F.col("analysis_complete")
    overdue = F.col("subscribed") & ~complete & (now >= scheduled + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes)))
    state = (F.when(~F.col("subscribed"), "not_subscribed").when(complete, "sent").when(overdue, "overdue").when(delivered, "partial")
             .when(F.col("has_run"), "processing").when(now < scheduled, "not_due").otherwise("pending"))
    so_far = Window.partitionBy(F.year("day") * 0).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a day
    return days.withColumn("state", state).withColumn("overdue", overdue).withColumn("last_send", F.max("last_sent_at").over(so_far))


def reported_counts(daily_items: DataFrame) -> DataFrame:
    """Per day the number of items by status as ``status=n`` in order of names; statuses that may not be named count as ``other``. daily_items: day, status."""
    named = F.when(F.col("status").isin(REPORTED_STATUSES), F.col("status")).otherwise("other")
    counts = daily_items.groupBy("day", named.alias("status")).agg(F.count("*").alias("n"))
    return counts.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "n"))), " ").alias("counts"))


def health_warnings(operational: DataFrame, attempts: DataFrame, missing: DataFrame) -> DataFrame:
    """Per day the warnings that a health view may show, distinct and sorted: no source text and no address is in them.

    operational: day, code, target (nullable), used, limit (nullable). attempts: day, status of document attempts. missing: day, item_id of missing document links.
    """
    detail = F.concat_ws(":", "code", F.concat(F.lit("day="), "day"), F.concat(F.lit("target="), "target"), F.concat(F.lit("used="), "used", F.lit("/"), "limit"))
    stopped = attempts.filter(F.col("status") == "failed").groupBy("day").agg(F.count("*").alias("n"))
    mark = F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 12)
    safe_day = F.coalesce(F.when(F.to_date(F.col("day").try_cast("date")).isNotNull(), F.col("day")), F.lit("unknown"))
    lines = operational.select("day", detail.alias("line")).unionByName(stopped.select("day", F.concat(F.lit("episode_document_retry_stopped:"), "n").alias("line")))
    lines = lines.unionByName(missing.select("day", F.concat(F.lit("document link missing:episode="), mark, F.lit(":day="), safe_day).alias("line")))
    return lines.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("line")), " | ").alias("warnings"))


def missing_document_links(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct (item, day) of failed attempts and of failed document runs."""
    return attempts.filter(F.col("status") == "failed").select("item_id", "day").union(
        runs.filter((F.col("kind") == "document") & (F.col("status") == "failed")).select("item_id", "day")).distinct()


def watch_catalogs(observations: DataFrame, now: Column, days: int = 30, stars: int = 4, at_least: int = 2, limit: int = 20) -> DataFrame:
    """Podcasts with repeated high-value episodes, most recent first."""
    good = observations.filter((F.col("status") == "summarized") & (F.col("stars") >= stars)
                               & (F.col("observed_at") >= now - F.make_dt_interval(F.lit(days))) & F.col("podcast").isNotNull())
    return (good.groupBy("podcast").agg(F.count("*").alias("n"), F.max("observed_at").alias("latest"))
            .filter(F.col("n") >= at_least).orderBy(F.desc("latest"), "podcast").limit(limit))


def delivery_rollup(parts: DataFrame) -> DataFrame:
    """Per run: parts by status and whether all of them were sent."""
    total, sent = F.count("*"), F.count_if(F.col("status") == "sent")
    return parts.groupBy("run_key").agg(total.alias("total"), sent.alias("sent"), (total - sent).alias("open"), ((total > 0) & (total == sent)).alias("fully_sent"))


def daily_quota(requests: DataFrame, n: int) -> DataFrame:
    """The first ``n`` assets per day get a slot, each asset once ever; a refused asset may ask again another day.

    requests: stream, day, at, seq, asset. An asset that was never asked for before holds no slot, so after the n-th such asset of a day nobody
    gets one: only the rows up to there matter, whatever the request volume. Days of a stream that share none of these assets do
    not depend on each other and are folded apart; a hot stream is cut by days and hours first, and then into such runs.
    """
    first = requests.groupBy("stream", "day", "asset").agg(F.min(F.struct("at", "seq")).alias("f")).select(
        "stream", "day", "asset", "f.at", "f.seq", F.date_trunc("hour", "f.at").alias("blk"))
    born = requests.groupBy("stream", "asset").agg(F.min("day").alias("born"))
    marked = cut_lineage(first.join(born, ["stream", "asset"]).withColumn("fresh", (F.col("day") == F.col("born")).cast("long")))
    placed = prefix_scan(marked, ["stream", "day"], ["blk"], ["at", "seq"], ahead=Running("sum", "fresh", before=True))
    able = cut_lineage(placed.filter(F.coalesce("ahead", F.lit(0)) < n).select("stream", "day", "asset", "at", "seq"))
    last = able.groupBy("stream", "asset").agg(F.max("day").alias("last"))
    days = able.join(last, ["stream", "asset"]).groupBy("stream", "day").agg(F.max("last").alias("reach")).withColumn("blk", F.date_trunc("year", "day"))
    runs = independent_runs(days, ["stream"], ["blk"], "day", "reach").select("stream", "day", "run")

    def step(state: dict, row):
        if state.get("day") != row.day:
            state.update(day=row.day, given=0)
        held = state.setdefault("held", set())
        if state["given"] < n and row.asset not in held:
            held.add(row.asset)
            state["given"] += 1
            yield row.stream, row.day, row.asset, state["given"]

    return fold_in_order(able.join(runs, ["stream", "day"]), ["stream", "run"], ["day", "at", "seq"], dict, step, "stream string, day date, asset long, slot int")


def scan_outcome(fetch: DataFrame, candidates: DataFrame) -> DataFrame:
    """A scan is unhealthy if sources failed, discovery found nothing, and nothing else or mostly failures came back.

    fetch: scan, source, status. candidates: scan, is_discovery.
    """
    f = fetch.groupBy("scan").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") != "failed").alias("successful"))
    c = candidates.groupBy("scan").agg(F.count("*").alias("candidates"), F.count_if("is_discovery").alias("discovery"))
    z = F.lit(0).cast("long")
    j = f.join(c, "scan", "left").select("scan", "failed", "successful", F.coalesce("candidates", z).alias("candidates"), F.coalesce("discovery", z).alias("discovery"))
    return j.withColumn("unhealthy", (F.col("failed") > 0) & (F.col("discovery") == 0)
                        & ((F.col("candidates") == 0) | (F.col("failed") >= F.col("successful"))))


def discovery_summary(rows: DataFrame, cap: int) -> DataFrame:
    """Per scan: distinct items (first row of an id wins), newest first, with counters; ``kept`` marks those within the cap.

    rows: scan, ordinal, item_id, published_at, verdict ('ok', 'invalid', 'outside'), request_ok.
    """
    ok = rows.filter(F.col("verdict") == "ok")
    items = ok.groupBy("scan", "item_id").agg(F.min_by("published_at", "ordinal").alias("published_at"), F.min("ordinal").alias("ordinal"))
    counters = rows.groupBy("scan").agg(F.count_if("request_ok").alias("requests_ok"), F.count_if(~F.col("request_ok")).alias("requests_failed"),
                                        F.count_if(F.col("verdict") == "invalid").alias("invalid"))
    sizes = items.groupBy("scan").agg(F.count("*").alias("items"))
    head = first_n(items, ["scan"], [F.desc("published_at"), F.col("ordinal")], cap)
    return head.join(counters.join(sizes, "scan"), "scan").withColumn("capped", F.col("items") > cap)


def speech_density(transcripts: DataFrame) -> DataFrame:
    """Words per minute of a transcript against the gates of each kind of source. transcripts: item_id, text, minutes.

    Words in no minutes are infinitely many a minute, no words in none are NaN; neither is in a range.
    """
    flat = F.trim(F.regexp_replace("text", BLANKS, " "))
    words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("long")
    m = transcripts.select("item_id", "minutes", F.length(flat).cast("long").alias("chars"), words.alias("words"))
    by_none = F.when(F.col("words") > 0, float("inf")).when(F.col("words") == 0, float("nan"))
    wpm = F.when(F.col("minutes") == 0, by_none).otherwise(F.col("words") / F.nullif("minutes", F.lit(0.0)))
    # Words-per-minute ranges and floors per kind of source.
    return m.select(
        "item_id", "chars", "words", F.round(wpm, 6).alias("wpm"),
        ((F.col("chars") >= 5000) & (F.col("words") >= F.greatest(F.lit(900.0), F.col("minutes") * 80)) & wpm.between(80, 280)).alias("plain_ok"),
        ((F.col("words") >= 1000) & wpm.between(70, 230)).alias("publisher_a_ok"),
        ((F.col("words") >= 1000) & wpm.between(70, 260)).alias("publisher_b_ok"),
        wpm.between(70, 220).alias("publisher_c_ok"),
        (wpm.between(60, 260) & (F.col("chars") >= F.greatest(F.lit(5000.0), F.bround("minutes", 0) * 300))).alias("captions_ok"),
        (F.col("chars") >= F.greatest(F.lit(5000.0), F.bround("minutes", 0) * 180)).alias("official_ok"))


# Phrases that open and close a full recording, and the shape of a speaker label.
OPENING = ["intro", "welcome", "this is ", "today we're", "today we are", "my guest", "our guest"]
CLOSING = ["see you next time", "see you all next time", "thanks for listening", "thank you for listening", "until next time",
           "that's all for today", "that is all for today"]
LABEL = r"^([A-Za-z][A-Za-z .'-]{0,40}):\s+"


def turn_distribution(transcripts: DataFrame, min_turns: int = 20, early: float = 0.05, late: float = 0.80) -> DataFrame:
    """Are labelled turns spread over the whole text? Also opening and closing phrases, and first/last label by block.

    transcripts: item_id, text. Line offsets come from a scan over the exploded lines, so a long text is not one task's work.
    """
    either = lambda phrases: "|".join("\\Q" + p + "\\E" for p in phrases)
    base = transcripts.select("item_id", F.length("text").alias("total"), F.regexp_replace(F.trim("text"), BLANKS, " ").alias("flat")).select(
        "item_id", "total", F.lower(F.substring("flat", 1, 2500)).rlike(either(OPENING)).alias("opening"), F.lower(F.right("flat", F.lit(3000))).rlike(either(CLOSING)).alias("closing"))
    lines = transcripts.select("item_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(
        "item_id", "n", F.floor(F.col("n") / 1024).alias("blk"), F.length("line").alias("len"), F.regexp_extract("line", LABEL, 1).alias("label"))
    placed = prefix_scan(lines, ["item_id"], ["blk"], ["n"], at=Running("sum", F.col("len") + 1, before=True))
    marked = placed.join(base.select("item_id", "total"), "item_id")
    is_label = F.col("label") != ""
    agg = marked.groupBy("item_id").agg(
        F.count_if(is_label).alias("turns"), F.count("*").alias("lines"),
        F.count_distinct(F.when(is_label, F.lower(F.trim("label")))).alias("speakers"),
        F.count_distinct(F.when(is_label, F.least(F.lit(9), F.floor(F.col("at") * 10 / F.greatest(F.lit(1), F.col("total")))))).alias("deciles"),
        F.min(F.when(is_label, F.col("n"))).alias("first_label"), F.max(F.when(is_label, F.col("n"))).alias("last_label"))
    j = agg.join(base, "item_id")
    spread = (F.col("turns") >= min_turns) & (F.col("speakers") >= 2) & (F.col("deciles") == 10)
    edge = (F.col("first_label") <= F.greatest(F.lit(2.0), F.bround(F.col("lines") * early, 0))) & (F.col("last_label") >= F.bround(F.col("lines") * late, 0))
    return j.select("item_id", "turns", "speakers", "deciles", "opening", "closing", spread.alias("spread"),
                    F.coalesce(edge, F.lit(False)).alias("edge_labels"), (spread & F.col("opening") & F.col("closing")).alias("complete"))


# Verbs that attribute a claim to a name.
OWNER = r"([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)?)\s*(?:也|更)?(?:认为|称|说|表示|主张|提醒|建议|强调)"


def claim_owners(source: DataFrame, derived: DataFrame) -> DataFrame:
    """Attributed claims per name in a source and in its derived text. Both: item_id, text."""
    def owners(df, name):
        return df.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(OWNER), F.lit(1))).alias("owner")).groupBy(
            "item_id", "owner").agg(F.count("*").alias(name))
    j = owners(source, "in_source").join(owners(derived, "in_derived"), ["item_id", "owner"], "left")
    z = F.coalesce("in_derived", F.lit(0).cast("long"))
    return j.select("item_id", "owner", "in_source", z.alias("in_derived"), (z < F.col("in_source")).alias("dropped"))


# Number tokens, written quantities with their units, and numeral ranges.
DIGITS = r"\p{Nd}+(?:[.,]\p{Nd}+)*+"
NUMERALS = "[零〇一二三四五六七八九十百千万亿两]+"


def number_tokens(text: Column) -> Column:
    """Distinct number expressions of a text; white space inside is ignored."""
    compact = F.regexp_replace(text, BLANKS, "")
    plain = F.regexp_extract_all(compact, F.lit(f"({DIGITS}|{NUMERALS}(?=[个年月周日天人项倍亿万岁秒分]))"), F.lit(1))
    spans = F.lit(f"({NUMERALS})[到至]({NUMERALS})")
    ranged = F.contains(compact, F.lit("到")) | F.contains(compact, F.lit("至"))  # few texts are searched for ranges
    return F.array_distinct(F.when(ranged, F.concat(plain, F.regexp_extract_all(compact, spans, F.lit(1)), F.regexp_extract_all(compact, spans, F.lit(2)))).otherwise(plain))


def number_preservation(pairs: DataFrame) -> DataFrame:
    """Numbers of the source missing in the derived text and numbers that are new. pairs: item_id, source_text, derived_text."""
    p = pairs.select("item_id", number_tokens(F.col("source_text")).alias("s"), number_tokens(F.col("derived_text")).alias("d"),
                     F.regexp_replace("derived_text", BLANKS, "").alias("compact"))
    # A numeral written in words counts as kept when it occurs inside a longer written number.
    gone = F.filter(F.array_except("s", "d"), lambda v: v.rlike(r"^[\x00-\x7F]*$") | ~F.contains(F.col("compact"), v))
    new = F.array_except("d", "s")
    return p.select("item_id", F.size("s").alias("numbers"), F.array_join(F.array_sort(gone), " ").alias("missing"), F.array_join(F.array_sort(new), " ").alias("introduced"))


def read_coverage(chunks: DataFrame, reads: DataFrame) -> DataFrame:
    """Per document: chunks read, chunks in total, first unread position. Both: item_id, pos."""
    seen = reads.select("item_id", "pos").distinct().withColumn("seen", F.lit(True))
    return chunks.join(seen, ["item_id", "pos"], "left").groupBy("item_id").agg(
        F.count_if(F.col("seen").isNotNull()).alias("read"), F.count("*").alias("total"),
        F.min(F.when(F.col("seen").isNull(), F.col("pos"))).alias("next_unread"))


# Words that never select a title, and the token shape.
SELECTOR_STOPWORDS = [
    "the", "and", "with", "podcast", "episode", "interview", "show", "part", "agent", "agents", "model", "models", "market", "markets",
    "technology", "tech", "why", "what", "when", "where", "which", "who", "how", "this", "that", "these", "those", "does", "did", "was",
    "were", "are", "has", "have", "can", "could", "should", "would", "播客", "节目", "访谈", "嘉宾", "观点",
]
SELECTOR_TOKEN = r"([a-z0-9][a-z0-9'’-]{2,}|[\x{3400}-\x{9fff}]{3,})"


def selector_compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\x{3400}-\x{9fff}]+", "")


def selector_aliases(text: Column) -> Column:
    """Aliases that may select a title: the compact title, its longer tokens, and 2 to 4 neighbouring tokens joined.

    ``text`` is matched as it is: the token shape only sees lower-case letters.
    """
    compact = selector_compact(text)
    stop = F.array(*[F.lit(w) for w in SELECTOR_STOPWORDS])
    usable = lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)
    tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SELECTOR_TOKEN), F.lit(1)), selector_compact),
                      lambda w: usable(w) & ~w.rlike(r"^[\x{3400}-\x{9fff}]+$"))
    whole = F.when(usable(compact), F.array(compact)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")

    def grams(tokens: Column, k: int) -> Column:
        return F.when(F.size(tokens) >= k, F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), ""))).otherwise(none)

    # Tokens are the one element of an array, so that they are found once and not again for each use.
    joined = F.get(F.transform(F.array(tokens), lambda x: F.concat(x, grams(x, 2), grams(x, 3), grams(x, 4))), F.lit(0))
    return F.array_distinct(F.concat(whole, joined))


def alias_frequency(catalog: DataFrame) -> DataFrame:
    """How often each alias occurs over titles and shows; an alias is a selector only if it is unique. catalog: ref, title, show."""
    both = dealt_rows(catalog).select(F.explode(F.concat(selector_aliases(F.col("title")), selector_aliases(F.col("show")))).alias("alias"))
    return both.groupBy("alias").agg(F.count("*").alias("n")).withColumn("is_selector", F.col("n") == 1)


def current_audience(frozen: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Frozen recipients that are still subscribed, in frozen order. frozen: seq, target."""
    return frozen.join(subscriptions.filter("active").select("target"), "target", "left_semi").select("seq", "target")


def scan_identity_union(feeds: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One table of releases from all kinds of source, with where each row came from."""
    out = None
    for origin, df in feeds:
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
