"""Is what was written grounded in what was said? Also receipts, replies and requests: joins over conversations and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions.arrow import nfkc
from galleyspark.functions.text import BLANKS, casefold, collapse, normalised, stripped
from galleyspark.operators.columns import quote_units
from galleyspark.operators.containment import contained
from galleyspark.operators.ordered import Running, first_n, prefix_scan


def current_digests(transcripts: DataFrame, digests: DataFrame) -> DataFrame:
    """Digest per transcript only if text hash and record revision still match. Both: item_id, content_sha256, revision."""
    d = digests.select("item_id", F.col("content_sha256").alias("d_sha"), F.col("revision").alias("d_rev"), "digest")
    j = transcripts.select("item_id", "content_sha256", "revision").join(d, "item_id", "left")
    fresh = (F.col("d_sha") == F.col("content_sha256")) & (F.col("d_rev") == F.col("revision"))
    return j.select("item_id", F.when(fresh, F.col("digest")).otherwise("").alias("digest"),
                    F.when(F.col("d_sha").isNull(), "missing").when(fresh, "current").otherwise("stale").alias("state"))


def quote_grounding(quotes: DataFrame, docs: DataFrame, min_chars: int = 12) -> DataFrame:
    """Quotes that occur verbatim (up to case and white space) in the document they name. quotes: quote_id, item_id, text. docs: item_id, text."""
    q = quotes.select("quote_id", "item_id", normalised("text").alias("q"))
    j = q.join(docs.select("item_id", normalised("text").alias("body")), "item_id", "left")
    return j.select("quote_id", "item_id", "q", F.coalesce((F.length("q") >= min_chars) & F.contains(F.col("body"), F.col("q")), F.lit(False)).alias("grounded"))


def distinct_quotes(grounding: DataFrame) -> DataFrame:
    """Per item: quotes, grounded ones and distinct grounded ones (two are needed for the highest density)."""
    return grounding.groupBy("item_id").agg(F.count("*").alias("quotes"), F.count_if("grounded").alias("grounded"),
                                            F.count_distinct(F.when(F.col("grounded"), F.sha2("q", 256))).alias("distinct_grounded"))


def quote_sources(quotes: DataFrame, docs: DataFrame, min_chars: int = 12) -> DataFrame:
    """Which documents contain which quotes, when quotes name none. quotes: quote_id, text. docs: item_id (unique), text."""
    q = quotes.select("quote_id", normalised("text").alias("pattern")).filter(F.length("pattern") >= min_chars)
    return contained(docs.select("item_id", normalised("text").alias("body")), q).join(q, "pattern").select("quote_id", "item_id")


def citation_integrity(answers: DataFrame, chunks: DataFrame, max_points: int = 6, max_ids: int = 3, max_chars: int = 160, max_quote: int = 120, max_units: int = 25) -> DataFrame:
    """First rule an answer breaks. answers: answer_id, item_id, points array<struct<text, citations array<string>, quote>>. chunks: item_id, chunk_id, text.

    A citation must exist in the answer's document and one cited chunk must contain the quote.
    """
    p = answers.select("answer_id", "item_id", F.posexplode("points").alias("pos", "p")).select(
        "answer_id", "item_id", "pos", "p.text", F.transform("p.citations", stripped).alias("ids"), collapse("p.quote").alias("quote"), F.col("p.quote").alias("raw"))
    one_line = lambda c: ~c.rlike(r"[\r\n]")
    local = p.select("*", ((stripped("text") == "") | (F.length(stripped("text")) > max_chars) | ~one_line(F.col("text"))).alias("bad_text"),
                     (~F.size("ids").between(1, max_ids) | (F.size(F.array_distinct("ids")) < F.size("ids")) | ~F.forall("ids", lambda i: i.rlike(r"\AC\d{4}\z"))).alias("bad_ids"),
                     ((stripped("raw") == "") | (F.length(stripped("raw")) > max_quote) | ~one_line(F.col("raw")) | (quote_units("quote") == 0)).alias("bad_quote"), quote_units("quote").alias("units"))
    cited = local.select("answer_id", "pos", "item_id", "quote", F.explode("ids").alias("chunk_id")).join(
        chunks.select("item_id", "chunk_id", F.col("text").alias("chunk")), ["item_id", "chunk_id"], "left")
    seen = cited.groupBy("answer_id", "pos").agg(F.bool_or(F.col("chunk").isNull()).alias("unknown"),
                                                 F.bool_or(F.coalesce(F.contains(collapse("chunk"), F.col("quote")), F.lit(False))).alias("found"))
    per = local.join(seen, ["answer_id", "pos"], "left").groupBy("answer_id").agg(
        F.count("*").alias("points"), F.bool_or("bad_text").alias("bad_text"), F.bool_or(F.col("bad_ids") | F.coalesce("unknown", F.lit(True))).alias("bad_ids"),
        F.bool_or("bad_quote").alias("bad_quote"), F.bool_or(~F.coalesce("found", F.lit(False))).alias("ungrounded"), F.sum("units").alias("units"))
    return per.select("answer_id", "points", "units", F.when(F.col("points") > max_points, "too_many_points").when(F.col("bad_text"), "bad_text").when(F.col("bad_ids"), "bad_citation")
                      .when(F.col("bad_quote"), "bad_quote").when(F.col("ungrounded"), "quote_not_in_chunk").when(F.col("units") > max_units, "quotes_too_long").alias("problem"))


def evidence_coverage(units: DataFrame, refs: DataFrame) -> DataFrame:
    """Units that no turn or exclusion cites; complete if there are none. Both: item_id, unit."""
    cited = refs.select("item_id", "unit").distinct().withColumn("hit", F.lit(True))
    j = units.join(cited, ["item_id", "unit"], "left")
    missing = F.count_if(F.col("hit").isNull())
    return j.groupBy("item_id").agg(F.count("*").alias("units"), missing.alias("missing"), F.min(F.when(F.col("hit").isNull(), F.col("unit"))).alias("first_missing"), (missing == 0).alias("complete"))


def _term_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(casefold(nfkc(c)), r"\p{P}", " "), BLANKS, " "))


def supported_terms(terms: DataFrame, units: DataFrame) -> DataFrame:
    """Terms whose original occurs in the unit they cite: whole tokens for Latin and digits, any place for pure Han text.

    terms: term_id, item_id, unit, original. units: item_id, unit, text.
    """
    t = terms.withColumn("o", _term_form(F.col("original"))).filter("o <> ''")
    j = t.join(units.withColumn("e", _term_form(F.col("text"))).select("item_id", "unit", "e"), ["item_id", "unit"])
    spread = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(c, r"([\x{3400}-\x{9fff}])", " $1 "), r"\s+", " ")), F.lit(" "))
    latin = F.col("o").rlike(r"\p{Nd}|\p{IsLatin}")
    ok = F.when(latin, F.contains(spread(F.col("e")), spread(F.col("o")))).otherwise(F.contains(F.col("e"), F.col("o")))
    return j.filter(ok).select("term_id", "item_id", "unit")


def reconcile_deliveries(deliveries: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """Uncertain sends against the chat history: exactly one equal message since creation means sent, several are ambiguous.

    deliveries: delivery_id, chat, kind, parent, body, created_at. receipts: message_id, chat, kind, parent, body, sent_at, by_app, deleted.
    Sends and receipts of a body share one time line and a scan from the latest backwards counts the receipts not before each
    send, so repeated bodies cost no pairs.
    """
    keys = ["chat", "kind", "parent", "body"]
    r = receipts.filter(F.col("by_app") & ~F.col("deleted") & (F.col("sent_at") <= now + F.expr("interval 1 second"))).dropDuplicates(["message_id", *keys])
    line = r.select(*keys, F.col("sent_at").alias("at"), F.lit(0).alias("side"), F.col("message_id").alias("message_id"), F.lit(None).cast("long").alias("delivery_id"))
    line = line.unionByName(deliveries.select(*keys, (F.col("created_at") - F.expr("interval 1 second")).alias("at"), F.lit(1).alias("side"),
                                              F.lit(None).cast(r.schema["message_id"].dataType).alias("message_id"), "delivery_id"))
    line = line.select(*keys, "side", "message_id", "delivery_id", (-F.unix_micros("at")).alias("back"), (-F.unix_date(F.to_date("at"))).alias("blk"))
    ran = prefix_scan(line, keys, ["blk"], ["back", "side"], n=Running("count", "message_id"), found=Running("last", "message_id"))
    state = F.when(F.col("n") == 1, "sent").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return ran.filter("side = 1").select("delivery_id", state.alias("state"), F.when(F.col("n") == 1, F.col("found")).alias("message_id"))


def missing_receipts(days: DataFrame, messages: DataFrame, now: Column, start_minutes: int = 510, grace: int = 47) -> DataFrame:
    """Was the daily message seen in each chat on each day? days: day, chat. messages: chat, sent_at (local wall time), marked_day, by_app, deleted."""
    start = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(start_minutes))
    got = messages.filter(F.col("by_app") & ~F.col("deleted") & (F.col("sent_at") <= now)).withColumn("day", F.to_date("sent_at")).filter(F.col("marked_day") == F.col("day"))
    got = got.groupBy("chat", "day").agg(F.max("sent_at").alias("last_sent"))
    j = days.join(got, ["chat", "day"], "left")
    return j.select("chat", "day", F.when(now < start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace)), "not_due")
                    .when(F.col("last_sent") >= start, "delivered").otherwise("missing").alias("state"))


def reply_targets(replies: DataFrame, deliveries: DataFrame) -> DataFrame:
    """What a quoted message was about: the latest sent delivery with that id, if it is visible in the same chat.

    replies: message_id, chat, parent. deliveries: delivery_id, remote_id, status, chat, items (array).
    """
    sent = deliveries.filter(F.col("status") == "sent").groupBy(F.col("remote_id").alias("parent")).agg(F.max_by(F.struct("delivery_id", F.col("chat").alias("d_chat"), "items"), "delivery_id").alias("d"))
    j = replies.join(sent, "parent").filter(F.col("d.d_chat") == F.col("chat"))
    return j.select("message_id", "d.delivery_id", F.size("d.items").alias("items"), F.when(F.size("d.items") == 1, F.get("d.items", F.lit(0))).alias("item_id"))


def request_status(requests: DataFrame, answers: DataFrame, audits: DataFrame, deliveries: DataFrame, keep: int = 8) -> DataFrame:
    """Last requests per session with their answer, audit outcome and delivery counts. Deliveries are counted before the join.

    requests: session, request_id, created_at, status. answers, audits: session, request_id. deliveries: request_id, status.
    """
    last = first_n(requests, ["session"], [F.desc("created_at"), F.desc("request_id")], keep, "recency")
    counts = deliveries.groupBy("request_id").agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") != "sent").alias("unsent"))
    z = F.lit(0).cast("long")
    return (last.join(answers.select("session", "request_id", "answer"), ["session", "request_id"], "left")
            .join(audits.select("session", "request_id", "outcome"), ["session", "request_id"], "left").join(counts, "request_id", "left")
            .select("session", "request_id", "recency", "status", "answer", F.coalesce("outcome", F.lit("not_recorded")).alias("outcome"),
                    F.coalesce("sent", z).alias("sent"), F.coalesce("unsent", z).alias("unsent")))


def unanswered_mentions(mentions: DataFrame, runs: DataFrame) -> DataFrame:
    """Mentions with how their run stands: none yet, failed (for review), or existing. mentions: message_id. runs: message_id, status."""
    m = mentions.select("message_id").distinct()
    return m.join(runs, "message_id", "left").select("message_id", F.when(F.col("status").isNull(), "unanswered").when(F.col("status") == "failed", "failed").otherwise("existing").alias("state"))


def item_documents(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Reading document of an item: by its id, else by an exact ``title｜show｜`` prefix of documents without id. More than one is an error.

    items: item_id, title, show. documents: doc_ref, item_id (nullable), title. Each document emits its own prefixes that end in a
    separator, which turns the prefix test into an equality join.
    """
    by_id = documents.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_ref").alias("doc_ref"))
    parts = F.split("title", "｜")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "｜"), F.lit("｜")))
    old = documents.filter(F.col("item_id").isNull() & (F.size(parts) >= 3)).select("doc_ref", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(
        F.count("*").alias("n2"), F.min("doc_ref").alias("doc2"))
    j = items.withColumn("prefix", F.concat("title", F.lit("｜"), "show", F.lit("｜"))).join(by_id, "item_id", "left").join(old, "prefix", "left")
    n = F.coalesce("n", "n2", F.lit(0).cast("long"))
    return j.select("item_id", F.when(n == 1, F.when(F.col("n").isNotNull(), F.col("doc_ref")).otherwise(F.col("doc2"))).alias("doc_ref"), F.when(n > 1, "ambiguous").when(n == 0, "none").otherwise("ok").alias("state"))


def missing_enrichment(sent: DataFrame, ready: DataFrame, receipts: DataFrame, attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Fully sent bundles of the day with a ready document that no edit receipt of the message covers, and retries left.

    sent: run_key, message_id, fully_sent. ready: run_key, item_id. receipts: message_id, item_id. attempts: run_key (one row per retry).
    """
    open_ = sent.filter("fully_sent").select("run_key", "message_id").join(ready, "run_key").join(receipts.select("message_id", "item_id").distinct(), ["message_id", "item_id"], "left_anti")
    tries = attempts.groupBy("run_key").agg(F.count("*").alias("tries"))
    per = open_.groupBy("run_key").agg(F.count_distinct("message_id").alias("messages"), F.count("*").alias("missing"))
    return per.join(tries, "run_key", "left").filter(F.coalesce("tries", F.lit(0)) < max_attempts).select("run_key", "messages", "missing", F.coalesce("tries", F.lit(0).cast("long")).alias("tries"))
