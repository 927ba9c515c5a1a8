"""State that builds up over scans, commands and failures, as batch folds over its log. The streams of ``streaming`` must agree with these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions.text import stripped
from galleyspark.operators.ordered import Running, fold_in_order, prefix_scan
from galleyspark.session import cut_lineage, dealt_rows


def _births(observations: DataFrame, lookback_hours: int, burst_limit: int) -> DataFrame:
    """feed, key, scan_no, ordinal, scan_at, initial, burst: the observation that showed a key first.

    initial: it belongs to the first scan of the feed with any key. burst: all keys of the observation were new, it is dated before the window, and
    more than ``burst_limit`` of its scan are. Both follow from first sightings alone, so no order of scans is walked through.
    """
    seen = F.struct("scan_no", "ordinal", "scan_at", "published_at", F.size("keys").alias("width"))
    first = observations.select("feed", F.explode("keys").alias("key"), seen.alias("o")).groupBy("feed", "key").agg(F.min("o").alias("o")).select("feed", "key", "o.*")
    start = first.groupBy("feed").agg(F.min("scan_no").alias("start"))
    old = (F.col("scan_no") > F.col("start")) & F.coalesce(F.col("published_at") < F.col("scan_at") - F.make_dt_interval(F.lit(0), F.lit(lookback_hours)), F.lit(False))
    late = first.join(start, "feed").withColumn("old", old).filter("old").groupBy("feed", "scan_no", "ordinal").agg(F.count("*").alias("n"), F.max("width").alias("width")).filter("n = width")
    bursts = late.groupBy("feed", "scan_no").agg(F.count("*").alias("n")).filter(F.col("n") > burst_limit)
    marked = late.join(bursts, ["feed", "scan_no"], "left_semi").select("feed", "scan_no", "ordinal", F.lit(True).alias("burst"))
    return first.join(start, "feed").join(marked, ["feed", "scan_no", "ordinal"], "left").select(
        "feed", "key", "scan_no", "ordinal", "scan_at", (F.col("scan_no") == F.col("start")).alias("initial"), F.coalesce("burst", F.lit(False)).alias("burst"))


def first_seen(observations: DataFrame, lookback_hours: int, burst_limit: int = 3) -> DataFrame:
    """Ledger of a feed's item keys: feed, key, first_seen_at, seeded (never promoted).

    observations: feed, scan_no, scan_at, ordinal, keys (array of the item's guid and enclosure keys, one or both), published_at; one scan is a
    whole feed document, and (scan_no, ordinal) orders a feed. An item takes the earliest time and any seeding that its keys have **by then** and
    gives both to all its keys: a link holds only from the scan that shows it and changes nothing that was read before.
    Everything of a feed's first scan is seeded. More than ``burst_limit`` new but old-dated items in one scan are seeded for good, when
    the scan is through. Items without keys leave no trace.

    Keys that never met another partner, nearly all, are solved by aggregates. Those that did are folded in the feed's order,
    without the observations that repeat what their keys showed last; a task holds one ledger entry for each such key.
    """
    keyed = observations.select("feed", "scan_no", "scan_at", "ordinal", F.array_distinct(F.array_compact("keys")).alias("keys"), "published_at").filter(F.size("keys") > 0)
    births = cut_lineage(_births(keyed, lookback_hours, burst_limit))
    partners = keyed.select("feed", F.array_sort("keys").alias("tuple")).distinct().select("feed", F.explode("tuple").alias("key"), "tuple").groupBy("feed", "key").agg(F.count("*").alias("tuples"), F.max("tuple").alias("tuple"))
    tangled = cut_lineage(partners.filter("tuples > 1").select("feed", "key"))
    # A key with one partner is tangled all the same if the partner is.
    touched = keyed.select("feed", F.array_sort("keys").alias("tuple")).distinct().select("feed", F.explode("tuple").alias("key"), "tuple").join(tangled, ["feed", "key"], "left_semi").select("feed", "tuple").distinct()
    touched = cut_lineage(touched)
    apart = touched.select("feed", F.explode("tuple").alias("key")).distinct()
    alone = births.join(apart, ["feed", "key"], "left_anti").select("feed", "key", F.col("scan_at").alias("first_seen_at"), (F.col("initial") | F.col("burst")).alias("seeded"))

    events = keyed.withColumn("tuple", F.array_sort("keys")).join(touched, ["feed", "tuple"], "left_semi").select("feed", "scan_no", "scan_at", "ordinal", "tuple")
    shown = events.withColumn("key", F.explode("tuple")).join(births.select("feed", "key", "initial", "burst", F.col("scan_no").alias("born_scan"), F.col("ordinal").alias("born_ordinal")), ["feed", "key"])
    shown = cut_lineage(shown.withColumn("mark", F.xxhash64("tuple")).withColumn("blk", F.floor(F.col("scan_no") / 64)))
    order = ["scan_no", "ordinal"]
    ran = prefix_scan(shown, ["feed", "key"], ["blk"], order, before=Running("last", "mark", before=True))
    news = F.col("before").isNull() | (F.col("before") != F.col("mark")) | F.col("burst")
    born = (F.col("born_scan") == F.col("scan_no")) & (F.col("born_ordinal") == F.col("ordinal"))
    kept = ran.groupBy("feed", "scan_no", "ordinal").agg(F.first("scan_at").alias("scan_at"), F.first("tuple").alias("tuple"), F.bool_or(news).alias("news"),
                                                         F.bool_or(F.col("initial") & born).alias("initial"), F.bool_and(F.col("burst") & born).alias("burst")).filter("news")
    tied = fold_in_order(kept.drop("news"), ["feed"], order, dict, _see, f"feed {dict(keyed.dtypes)['feed']}, key string, first_seen_at timestamp, seeded boolean", _ledger)
    return alone.unionByName(tied)


def _see(state: dict, row):
    """One observation of a feed whose entries are (first, seeded); a burst takes effect when its scan is through."""
    state["feed"] = row.feed
    ledger, late = state.setdefault("ledger", {}), state.setdefault("late", [])
    if state.get("scan") != row.scan_no:
        _close(ledger, late)
        state["scan"] = row.scan_no
    known = [ledger[k] for k in row.tuple if k in ledger]
    entry = (min((first for first, _ in known), default=row.scan_at), bool(row.initial) or any(seeded for _, seeded in known))
    ledger.update((k, entry) for k in row.tuple)
    if row.burst:
        late += list(row.tuple)
    return ()


def _close(ledger: dict, late: list) -> None:
    ledger.update((k, (ledger[k][0], True)) for k in late)
    late.clear()


def _ledger(state: dict):
    _close(state["ledger"], state["late"])
    return [(state["feed"], k, first, seeded) for k, (first, seeded) in state["ledger"].items()]


def promote_late(items: DataFrame, ledger: DataFrame, now: Column, lookback_hours: int, max_age_days: int = 45) -> DataFrame:
    """Old-dated items that only now appeared: not seeded, first seen in the window, not too old.

    items: feed, item_id, keys (array), published_at; one row per item of the scan. ledger: as of ``first_seen``; an item has the earliest time and any
    seeding of its keys.
    """
    cutoff = now - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    late = items.filter((F.col("published_at") < cutoff) & (F.col("published_at") >= now - F.make_dt_interval(F.lit(max_age_days))))
    entry = late.select("feed", "item_id", F.explode("keys").alias("key")).join(ledger, ["feed", "key"]).groupBy("feed", "item_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.bool_or("seeded").alias("seeded"))
    return entry.filter(~F.col("seeded") & F.col("first_seen_at").between(cutoff, now)).select("item_id", "feed", "first_seen_at")


def first_seen_articles(urls: DataFrame, now: Column, zone: str = "Asia/Shanghai") -> DataFrame:
    """First observation per link; an undated article is eligible only on its first local day. urls: url, at, dated."""
    f = urls.groupBy("url").agg(F.min("at").alias("first_seen_at"), F.bool_or("dated").alias("dated"))
    today = F.to_date(F.from_utc_timestamp("first_seen_at", zone)) == F.to_date(F.from_utc_timestamp(now, zone))
    return f.withColumn("eligible", F.col("dated") | today)


def review_state(items: DataFrame, episodes: DataFrame, backlog: DataFrame, now: Column, retry_hours: int = 6) -> DataFrame:
    """new, retry or none per item. items: item_id. episodes: item_id, result, checked_at. backlog: item_id, state."""
    j = items.join(episodes.select("item_id", "result", "checked_at"), "item_id", "left").join(backlog.select("item_id", F.col("state").alias("waiting")), "item_id", "left")
    due = F.col("checked_at").isNull() | (now - F.col("checked_at") >= F.make_dt_interval(F.lit(0), F.lit(retry_hours)))
    state = (F.when(F.col("waiting") == "final_skipped", None).when(F.col("result").isNull(), "new").when(F.col("result") == "not_recommended", "retry")
             .when(F.col("result").isin("no_transcript", "summary_format_error", "unverified_date") & due, "retry"))
    return j.select("item_id", state.alias("state"), F.col("result").isNotNull().alias("known"))


def backlog_state(failures: DataFrame, slow_after: int = 48, stop_after: int = 71, age_days: int = 3, age_attempts: int = 2) -> DataFrame:
    """Where each item stands after its failures. failures: item_id, seq, at, counted, retry_at (nullable).

    A failure is final if it counts and the attempts before it reached the limit, or the item is old enough with a few attempts.
    Attempts before a failure and the time of the first one are running aggregates, so the fold needs no loop.
    """
    f = failures.withColumn("blk", F.to_date("at"))
    ran = prefix_scan(f, ["item_id"], ["blk"], ["at", "seq"], prior=Running("sum", F.col("counted").cast("long"), before=True), rows=Running("count", F.lit(1), before=True), born=Running("min", "at", before=True))
    prior = F.coalesce("prior", F.lit(0))
    known = F.coalesce("rows", F.lit(0)) > 0
    final = known & F.col("counted") & (((F.col("at") - F.col("born") >= F.make_dt_interval(F.lit(age_days))) & (prior >= age_attempts)) | (prior >= stop_after))
    wait = F.when(known & (prior >= slow_after), F.make_dt_interval(F.lit(0), F.lit(6))).otherwise(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30)))
    r = ran.select("item_id", "seq", "at", "counted", final.alias("final"), F.greatest(F.col("at") + wait, "retry_at").alias("next_check_at"))
    return r.groupBy("item_id").agg(F.min("at").alias("created_at"), F.sum(F.col("counted").cast("long")).alias("attempts"), F.bool_or("final").alias("final"),
                                    F.max_by("next_check_at", F.struct("at", "seq")).alias("next_check_at"), F.min(F.when(F.col("final"), F.col("at"))).alias("final_at"))


def subscription_changes(log: DataFrame) -> DataFrame:
    """Did each command change anything? log: seq, kind ('seed', 'add', 'remove'), target."""
    l = log.withColumn("blk", F.floor(F.col("seq") / 65536))
    ran = prefix_scan(l, ["target"], ["blk"], ["seq"], last=Running("last", F.when(F.col("kind") != "seed", F.col("kind")), before=True), rows=Running("count", F.lit(1), before=True))
    rows = F.coalesce("rows", F.lit(0))
    active = F.when(F.col("last").isNotNull(), F.col("last") == "add").otherwise(rows > 0)
    changed = F.when(F.col("kind") == "add", ~active).when(F.col("kind") == "remove", active).otherwise(rows == 0)
    return ran.select("seq", "target", "kind", changed.alias("changed"))


def subscription_state(log: DataFrame) -> DataFrame:
    """Current state per target: the last command wins; a seed only creates and never revives."""
    g = log.groupBy("target").agg(F.max_by("kind", F.when(F.col("kind") != "seed", F.col("seq"))).alias("cmd"), F.min("seq").alias("first_seq"), F.count_if(F.col("kind") != "seed").alias("commands"))
    return g.select("target", F.when(F.col("commands") > 0, F.col("cmd") == "add").otherwise(True).alias("active"), "commands")


def observation_upsert(log: DataFrame) -> DataFrame:
    """Last observation per item. log: item_id, seq, podcast, status, stars, observed_at."""
    return log.groupBy("item_id").agg(F.max_by(F.struct("podcast", "status", "stars", "observed_at"), "seq").alias("o")).select("item_id", "o.*")


def first_write_wins(writes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """First value per key is the record; any later write that differs in ``fields`` is a conflict. writes: keys, seq, fields."""
    h = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    g = writes.withColumn("h", h).groupBy(*keys).agg(F.min_by(F.struct(*fields), "seq").alias("v"), F.count("*").alias("writes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return g.select(*keys, "v.*", "writes", (F.col("lo") != F.col("hi")).alias("conflict"))


def digest_versions(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Stored digest per item: first write of its latest accepted revision; writes that expect another revision are rejected.

    writes: item_id, seq, expected_sha, expected_revision, digest. current: item_id, seq_from, content_sha256, revision (revision valid from a sequence number).
    """
    j = writes.join(current, "item_id").filter(F.col("seq_from") <= F.col("seq"))
    at = j.groupBy("item_id", "seq").agg(F.max_by(F.struct("content_sha256", "revision"), "seq_from").alias("c"), F.first("expected_sha").alias("expected_sha"), F.first("expected_revision").alias("expected_revision"), F.first("digest").alias("digest"))
    ok = at.filter((F.col("c.content_sha256") == F.col("expected_sha")) & (F.col("c.revision") == F.col("expected_revision")) & (stripped("digest") != ""))
    per = ok.groupBy("item_id", "expected_sha", "expected_revision").agg(F.min_by("digest", "seq").alias("digest"), F.min("seq").alias("stored_seq"))
    best = per.groupBy("item_id").agg(F.max_by(F.struct("expected_sha", "expected_revision", "digest", "stored_seq"), "stored_seq").alias("b"))
    return best.select("item_id", F.col("b.expected_revision").alias("revision"), F.trim("b.digest").alias("digest"), "b.stored_seq")


def first_claim(notes: DataFrame, runs: DataFrame) -> DataFrame:
    """Each note belongs to the first run on or after its date. notes: note_id, day. runs: run_key, day (one run per day).

    Notes and runs share one time line; a backward scan gives each note the next run, so no note meets all later runs.
    """
    line = notes.select(F.col("day"), F.lit(1).alias("side"), "note_id", F.lit(None).cast(runs.schema["run_key"].dataType).alias("run_key")).unionByName(
        runs.select("day", F.lit(0).alias("side"), F.lit(None).cast(notes.schema["note_id"].dataType).alias("note_id"), "run_key"))
    line = line.select("*", F.lit(0).alias("one"), (-F.unix_date("day")).alias("back"), (-F.floor(F.unix_date("day") / 7)).alias("blk"))
    ran = prefix_scan(line, ["one"], ["blk"], ["back", "side"], taken=Running("last", "run_key"))
    return ran.filter("side = 1").select("note_id", F.col("taken").alias("run_key")).filter("run_key is not null")


# Waiting times after each failed attempt, in seconds.
DELAYS, MESSAGE_DELAYS = [60, 300, 900, 1800], [3, 10, 30, 60]


def retry_schedule(attempts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Next try of a failed attempt. attempts: job, kind, attempts, failed_at."""
    pick = lambda d: F.element_at(F.array(*[F.lit(x) for x in d]), F.least(F.lit(len(d)), F.greatest(F.lit(1), F.col("attempts"))).cast("int"))
    wait = F.when(F.col("kind") == "message", pick(MESSAGE_DELAYS)).otherwise(pick(DELAYS))
    again = F.col("attempts") < max_attempts
    return attempts.select("job", F.when(again, "pending").otherwise("failed").alias("status"), F.when(again, F.col("failed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))).alias("available_at"))


def attempt_budget(attempts: DataFrame, today: Column, max_attempts: int = 3) -> DataFrame:
    """May a revision be tried again? Completed stays; another day or a spent budget fails it. attempts: item_id, revision, day, completed (one row per try)."""
    g = attempts.groupBy("item_id", "revision").agg(F.min("day").alias("day"), F.count("*").alias("tries"), F.bool_or("completed").alias("done"))
    return g.select("item_id", "revision", "tries", F.when(F.col("done"), "completed").when((F.col("day") != today) | (F.col("tries") >= max_attempts), "failed").otherwise("pending").alias("status"))


def context_expiry(contexts: DataFrame, now: Column, hours: int = 168) -> DataFrame:
    """Contexts that are still alive. contexts: session, updated_at."""
    return contexts.filter(now - F.col("updated_at") <= F.make_dt_interval(F.lit(0), F.lit(hours)))


def daily_archive(daily_items: DataFrame, runs: DataFrame, transcripts: DataFrame, digests: DataFrame) -> DataFrame:
    """A day's items as readers see them: merged over its runs, digests of older revisions counted as stale, unfinished runs flagged.

    daily_items: day, item_id, status, stars, run_key, result_key, run_created_at, created_at, revision. runs: day, analysis_complete.
    transcripts, digests: item_id, revision.
    """
    order = F.struct((F.col("status") == "summarized").alias("done"), "run_created_at", "run_key", "created_at", "result_key")
    merged = daily_items.groupBy("day", "item_id").agg(F.max_by(F.struct("status", "stars", "revision"), order).alias("v")).select("day", "item_id", "v.*")
    now = transcripts.select("item_id", F.col("revision").alias("t_rev")).join(digests.select("item_id", F.col("revision").alias("d_rev")), "item_id", "left")
    j = merged.join(now, "item_id", "left")
    fresh = (F.col("t_rev") == F.col("revision")) & (F.col("d_rev") == F.col("revision"))
    shown = (F.col("status") == "summarized") & F.coalesce(fresh, F.lit(False))
    stale = (F.col("status") == "summarized") & ~F.coalesce(fresh, F.lit(False))
    g = j.groupBy("day").agg(F.count_if(shown).alias("summaries"), F.count_if(stale).alias("stale"), F.count_if(F.col("status") != "summarized").alias("others"), F.sum(F.when(shown, F.col("stars")).otherwise(0)).cast("long").alias("stars"))
    done = runs.groupBy("day").agg(F.bool_and("analysis_complete").alias("complete"))
    return g.join(done, "day", "left").select("day", "summaries", "stale", "others", "stars", (~F.coalesce("complete", F.lit(False))).alias("incomplete"))


def resolve_catalog_refs(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue items a query names: unique aliases or whole titles and shows, without negated ones; both kinds beat one.

    queries: query_id, query. catalog: ref, title, show. An alias may start anywhere in the compact query, so it is looked up by its first or last
    characters, whichever fewer aliases share: the query emits its pieces of three, four and eight characters, and aliases that met are tested in full.
    Queries meet distinct aliases; items come in only where an alias selects them, and where both kinds do, by pairs of aliases, so that a show or a
    word of many items is not multiplied with the queries that hold it. Sizes of exploded rows are estimated from the few bytes of the catalogue, so
    joins are told to merge: a broadcast would fill the driver.
    """
    from galleyspark.operators.rollups import selector_aliases, selector_compact

    def named(col, kind):
        c = selector_compact(F.col(col))
        whole = F.when(F.length(c) >= 3, F.array(c)).otherwise(F.array().cast("array<string>"))
        one = spread.select("ref", selector_aliases(F.col(col)).alias("aliases"), c.alias("whole"), whole.alias("more"))
        one = one.select("ref", "whole", "aliases", F.explode(F.array_distinct(F.concat("aliases", "more"))).alias("alias"))
        return one.select("ref", F.lit(kind).alias("kind"), "alias", (F.col("alias") == F.col("whole")).alias("is_whole"), F.array_contains("aliases", F.col("alias")).alias("counted"))

    spread = dealt_rows(catalog)
    names = cut_lineage(named("title", "title").unionByName(named("show", "show")))
    aliases = names.groupBy("alias").agg(F.count_if("counted").alias("uses"))
    good = names.join(aliases.filter("uses = 1").select("alias", F.lit(True).alias("alone")).hint("merge"), "alias", "left").filter(F.col("is_whole") | F.col("alone")).select("ref", "kind", "alias").distinct()
    good = cut_lineage(good)
    said = cut_lineage(_aliases_said(dealt_rows(queries).select("query_id", selector_compact(F.col("query")).alias("q")), aliases.select("alias")))
    live, negated = said.filter("not negated").select("query_id", "alias"), said.filter("negated").select("query_id", "alias")

    def spared(pairs):
        out = pairs.join(negated.hint("merge"), "query_id").join(names.select("ref", "alias").hint("merge"), ["ref", "alias"], "left_semi").select("query_id", "ref").distinct()
        return pairs.join(out.hint("merge"), ["query_id", "ref"], "left_anti")

    titles, shows = (good.filter(F.col("kind") == k).select("ref", F.col("alias").alias(k)) for k in ("title", "show"))
    heard = [live.withColumnRenamed("alias", k).join(g.select(k).distinct().hint("merge"), k, "left_semi") for k, g in (("title", titles), ("show", shows))]
    both = cut_lineage(spared(heard[0].join(heard[1].hint("merge"), "query_id").join(titles.join(shows.hint("merge"), "ref").hint("merge"), ["title", "show"]).select("query_id", "ref").distinct()))
    either = live.join(both.select("query_id").distinct().hint("merge"), "query_id", "left_anti").join(good.select("ref", "alias").hint("merge"), "alias").select("query_id", "ref").distinct()
    return both.unionByName(spared(either))


SIZES = (3, 4, 8)  # an alias is looked up by pieces of the largest of these that it holds


def _aliases_said(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, alias, negated: the aliases that stand in each query. queries: query_id, q. aliases: alias, of three characters or more, distinct."""
    n = F.length("alias")
    size = F.when(n >= SIZES[2], SIZES[2]).when(n >= SIZES[1], SIZES[1]).otherwise(SIZES[0])
    ends = aliases.select("alias", F.explode(F.array_distinct(F.array(F.left("alias", size), F.right("alias", size)))).alias("piece"))
    shared = ends.groupBy("piece").agg(F.count("*").alias("n"))
    keyed = ends.join(shared.hint("merge"), "piece").groupBy("alias").agg(F.min(F.struct("n", "piece")).alias("k")).select("alias", F.col("k.piece").alias("piece"))
    cut = lambda k: F.when(F.length("q") >= k, F.transform(F.sequence(F.lit(1), F.length("q") - k + 1), lambda i: F.substring(F.col("q"), i, k))).otherwise(F.array().cast("array<string>"))
    pieces = queries.select("query_id", "q", F.explode(F.array_distinct(F.concat(*[cut(k) for k in SIZES]))).alias("piece"))
    hits = pieces.join(keyed.hint("merge"), "piece").filter(F.contains(F.col("q"), F.col("alias")))
    negated = F.exists(F.array(*[F.lit(m) for m in NEGATIONS]), lambda m: F.contains(F.col("q"), F.concat(m, F.col("alias"))))
    return hits.select("query_id", "alias", negated.alias("negated")).groupBy("query_id", "alias").agg(F.bool_or("negated").alias("negated"))


# Words that exclude what follows them.
NEGATIONS = ["不是", "而不是", "不要", "不要回答", "不要选", "别选", "排除"]
