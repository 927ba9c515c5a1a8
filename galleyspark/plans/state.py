"""Section 2.9 jobs (batch folds and streams), and the jobs that use them, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.operators import state as ops
from galleyspark.operators import windows as win
from galleyspark.plans import bindings as b
from galleyspark.plans.columns import HASHES, archived
from galleyspark.operators import columns as cols
from galleyspark.plans.registry import job
from galleyspark.plans.rollups import CATALOG, _aliases, catalog
from galleyspark.plans.windows import DAILY, FETCH, TURNS, daily_items, fetch
from galleyspark.streaming import jobs as streams

SCANS = """slots AS (SELECT user_id%10 AS feed, epoch_us(ts)//21600000000 AS scan_no, make_timestamp((epoch_us(ts)//21600000000)*21600000000) AS scan_at, event_id AS ordinal, event_id%977 AS item,
 CASE WHEN event_id%23<>0 THEN 'g' || (event_id%977) END AS guid, CASE WHEN event_id%41=0 THEN 'x' || ((event_id+1)%977) WHEN event_id%29<>0 THEN 'x' || (event_id%977) END AS enclosure,
 CASE WHEN (event_id%977)%5=0 THEN TIMESTAMP '2023-12-20' WHEN (event_id%977)%7=0 THEN NULL ELSE TIMESTAMP '2024-01-31' END AS published_at FROM events),
scans AS (SELECT *, list_filter([guid, enclosure], lambda k: k IS NOT NULL) AS keys FROM slots WHERE guid IS NOT NULL OR enclosure IS NOT NULL)"""
#: The ledger walked through one observation of each feed at a time; a burst counts as one more observation behind its scan.
LEDGER = """st AS (SELECT feed, min(scan_no) AS first_scan FROM scans GROUP BY 1), born AS (SELECT feed, key, min((scan_no, ordinal)) AS place FROM (SELECT feed, scan_no, ordinal, unnest(keys) AS key FROM scans) GROUP BY 1,2),
fresh AS (SELECT feed, scan_no, ordinal FROM (SELECT feed, scan_no, ordinal, unnest(keys) AS key FROM scans) s JOIN born USING (feed, key) GROUP BY 1,2,3 HAVING bool_and(place = (scan_no, ordinal))),
late AS (SELECT s.* FROM scans s JOIN fresh USING (feed, scan_no, ordinal) JOIN st USING (feed) WHERE scan_no > first_scan AND published_at < scan_at - to_hours(24)),
burst AS (SELECT feed, scan_no FROM late GROUP BY 1,2 HAVING count(*) > 3),
ev AS (SELECT *, dense_rank() OVER (PARTITION BY feed ORDER BY scan_no, behind, ordinal) AS n FROM (SELECT feed, scan_no, 0 AS behind, ordinal, keys, scan_at AS seen_at, scan_no = first_scan AS seed FROM scans JOIN st USING (feed)
 UNION ALL SELECT feed, scan_no, 1, 0, [unnest(keys)], NULL, TRUE FROM late JOIN burst USING (feed, scan_no))),
walk(feed, key, first_seen_at, seeded, n) USING KEY (feed, key) AS (SELECT feed, unnest(keys), seen_at, seed, n FROM ev WHERE n=1
 UNION SELECT feed, unnest(keys), first_seen_at, seeded, n FROM (SELECT e.feed, e.n, e.keys, least(min(l.first_seen_at), any_value(e.seen_at)) AS first_seen_at, any_value(e.seed) OR coalesce(bool_or(l.seeded), FALSE) AS seeded
  FROM ev e JOIN (SELECT max(n)+1 AS n FROM walk) x USING (n) LEFT JOIN recurring.walk l ON l.feed = e.feed AND list_contains(e.keys, l.key) GROUP BY 1,2,3)),
ledger AS (SELECT feed, key, first_seen_at, seeded FROM walk)"""


def scans(t):
    slot = F.floor(F.unix_micros("ts") / 21600000000)
    e, item = F.col("event_id"), F.col("event_id") % 977
    guid = F.when(e % 23 != 0, F.concat(F.lit("g"), item))
    enclosure = F.when(e % 41 == 0, F.concat(F.lit("x"), (e + 1) % 977)).when(e % 29 != 0, F.concat(F.lit("x"), item))
    return b.events(t).select((F.col("user_id") % 10).alias("feed"), slot.alias("scan_no"), F.timestamp_micros(slot * 21600000000).alias("scan_at"), e.alias("ordinal"), F.array_compact(F.array(guid, enclosure)).alias("keys"), item.alias("item"),
                              F.when(item % 5 == 0, b.ts("2023-12-20 00:00:00")).when(item % 7 != 0, b.ts("2024-01-31 00:00:00")).alias("published_at"))


FIRST_SEEN = f"WITH RECURSIVE {SCANS}, {LEDGER} SELECT feed, key, strftime(first_seen_at,'%Y-%m-%d %H') AS first_seen, seeded FROM ledger"


@job("first_seen", FIRST_SEEN)
def first_seen(t):
    """Some enclosures move on to the next item of the catalogue, which links items from then on."""
    return ops.first_seen(scans(t), 24).select("feed", "key", F.date_format("first_seen_at", "yyyy-MM-dd HH").alias("first_seen"), "seeded")


@job("promote_late", f"""WITH RECURSIVE {SCANS}, {LEDGER}, i AS (SELECT DISTINCT feed, item, published_at, unnest(keys) AS key FROM scans),
e AS (SELECT feed, item, published_at, min(first_seen_at) AS f, bool_or(seeded) AS seeded FROM i JOIN ledger USING (feed, key) GROUP BY 1,2,3)
SELECT item AS item_id, feed, strftime(f,'%Y-%m-%d %H') AS first_seen FROM e WHERE NOT seeded AND f BETWEEN TIMESTAMP '2024-01-31' - to_hours(600) AND TIMESTAMP '2024-01-31' AND published_at < TIMESTAMP '2024-01-31' - to_hours(600) AND published_at >= TIMESTAMP '2024-01-31' - to_days(45)""")
def promote_late(t):
    s = scans(t)
    items = s.select("feed", F.col("item").alias("item_id"), "published_at", F.explode("keys").alias("key")).groupBy("feed", "item_id", "published_at").agg(F.collect_set("key").alias("keys"))
    return ops.promote_late(items, ops.first_seen(s, 24), b.ts(b.NOW), 600).select("item_id", "feed", F.date_format("first_seen_at", "yyyy-MM-dd HH").alias("first_seen"))


@job("first_seen_stream", FIRST_SEEN)
def first_seen_stream(t):
    """Documents of scans arrive in order, some to a batch."""
    item = F.struct("ordinal", "keys", "published_at")
    documents = scans(t).groupBy("feed", "scan_no", "scan_at").agg(F.sort_array(F.collect_list(item)).alias("items"))
    stream = streams.first_seen_stream(b.arriving(documents, "scan_no", "feed"), 24)
    return streams.run_available(stream, "update", ["feed", "key"]).select("feed", "key", F.date_format("first_seen_at", "yyyy-MM-dd HH").alias("first_seen"), "seeded")


@job("first_seen_articles", """WITH f AS (SELECT 'u' || user_id || '/' || (event_id%50) AS url, min(ts) AS at, bool_or(event_type='view') AS dated FROM events GROUP BY 1) SELECT url, strftime("at",'%Y-%m-%d %H:%M:%S') AS first_seen, dated OR CAST("at" + to_hours(8) AS DATE) = DATE '2024-01-29' AS eligible FROM f""")
def first_seen_articles(t):
    u = b.events(t).select(F.concat(F.lit("u"), "user_id", F.lit("/"), F.col("event_id") % 50).alias("url"), F.col("ts").alias("at"), (F.col("event_type") == "view").alias("dated"))
    return ops.first_seen_articles(u, b.ts("2024-01-29 03:00:00")).select("url", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "eligible")


RESULTS = ["no_transcript", "summary_format_error", "unverified_date", "not_recommended", "sent"]


@job("review_state", """WITH e AS (SELECT user_id AS item_id, arg_max(event_id%5, event_id) AS r, max(ts) AS checked_at FROM events GROUP BY 1), i AS (SELECT o_orderkey AS item_id FROM orders),
x AS (SELECT item_id, ['no_transcript','summary_format_error','unverified_date','not_recommended','sent'][CAST(r+1 AS INTEGER)] AS result, checked_at FROM i LEFT JOIN e USING (item_id))
SELECT item_id, result IS NOT NULL AS known, CASE WHEN item_id%11=3 THEN NULL WHEN result IS NULL THEN 'new' WHEN result='not_recommended' THEN 'retry' WHEN result<>'sent' AND TIMESTAMP '2024-01-31' - checked_at >= INTERVAL 6 HOUR THEN 'retry' END AS state FROM x""")
def review_state(t):
    e = b.events(t).groupBy(F.col("user_id").alias("item_id")).agg(F.max_by(F.col("event_id") % 5, "event_id").alias("r"), F.max("ts").alias("checked_at"))
    episodes = e.select("item_id", F.element_at(F.array(*[F.lit(r) for r in RESULTS]), (F.col("r") + 1).cast("int")).alias("result"), "checked_at")
    items = t.orders.select(F.col("o_orderkey").alias("item_id"))
    return ops.review_state(items, episodes, items.filter("item_id % 11 = 3").withColumn("state", F.lit("final_skipped")), b.ts(b.NOW))


BACKLOG = """fl AS (SELECT user_id AS item_id, event_id AS seq, ts AS at, value < 80 AS counted, CASE WHEN value > 120 THEN ts + to_hours(10) END AS retry_at FROM events WHERE event_type IN ('error','view','click')),
rn AS (SELECT *, coalesce(sum(counted::INT) OVER w,0) AS prior, min("at") OVER w AS born FROM fl WINDOW w AS (PARTITION BY item_id ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fi AS (SELECT *, born IS NOT NULL AND counted AND (("at" - born >= INTERVAL 3 DAY AND prior>=2) OR prior>=71) AS final, greatest("at" + CASE WHEN born IS NOT NULL AND prior>=48 THEN INTERVAL 360 MINUTE ELSE INTERVAL 30 MINUTE END, coalesce({retry}, TIMESTAMP '1970-01-01')) AS nx FROM rn)"""


def failures(t):
    return b.events(t).filter(F.col("event_type").isin("error", "view", "click")).select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("value") < 80).alias("counted"), F.when(F.col("value") > 120, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(10))).alias("retry_at"))


@job("backlog_state", "WITH " + BACKLOG.format(retry="retry_at") + """ SELECT item_id, strftime(min("at"),'%Y-%m-%d %H:%M:%S') AS created, CAST(sum(counted::INT) AS BIGINT) AS attempts, bool_or(final) AS final, strftime(arg_max(nx,("at",seq)),'%Y-%m-%d %H:%M:%S') AS next_check FROM fi GROUP BY 1""")
def backlog_state(t):
    s = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return ops.backlog_state(failures(t)).select("item_id", s("created_at", "created"), "attempts", "final", s("next_check_at", "next_check"))


@job("backlog_stream", "WITH " + BACKLOG.format(retry="NULL") + """ SELECT item_id, strftime(min("at"),'%Y-%m-%d %H:%M:%S') AS created, CAST(sum(counted::INT) AS BIGINT) AS attempts, bool_or(final) AS final, strftime(arg_max(nx,("at",seq)),'%Y-%m-%d %H:%M:%S') AS next_check FROM fi GROUP BY 1""")
def backlog_stream(t):
    class Streamed:
        events = t.stream("events")

    f = failures(Streamed).select("item_id", "seq", F.unix_micros("at").alias("at"), "counted")
    got = streams.run_available(streams.backlog_stream(f), "update", ["item_id"])
    s = lambda c, n: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss").alias(n)
    return got.select("item_id", s("created", "created"), "attempts", "final", s("next", "next_check"))


COMMANDS = "cmds AS (SELECT event_id AS seq, 'u' || user_id || '-' || (event_id%7) AS target, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'seed' END AS kind FROM events)"


def commands(t):
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("seed")
    return b.events(t).select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id", F.lit("-"), F.col("event_id") % 7).alias("target"), kind.alias("kind"))


@job("subscription_state", f"WITH {COMMANDS} SELECT target, coalesce(arg_max(kind,seq) FILTER (WHERE kind<>'seed') = 'add', TRUE) AS active, count(*) FILTER (WHERE kind<>'seed') AS commands FROM cmds GROUP BY 1")
def subscription_state(t):
    return ops.subscription_state(commands(t))


@job("subscription_changes", f"""WITH {COMMANDS}, p AS (SELECT *, last_value(CASE WHEN kind<>'seed' THEN kind END IGNORE NULLS) OVER w AS last, count(*) OVER w AS n FROM cmds WINDOW w AS (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN last IS NOT NULL THEN last='add' ELSE n>0 END AS act FROM p) SELECT seq, target, kind, CASE kind WHEN 'add' THEN NOT act WHEN 'remove' THEN act ELSE n=0 END AS changed FROM a""")
def subscription_changes(t):
    return ops.subscription_changes(commands(t))


@job("latest_status_stream", f"""WITH {FETCH}, r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY run_at DESC, rowid DESC) AS rn FROM fetches) SELECT source, url, rowid, source_type, status, reason FROM r WHERE rn=1""")
def latest_status_stream(t):
    class Streamed:
        events = t.stream("events")

    return streams.run_available(streams.latest_status_stream(fetch(Streamed)), "update", ["source", "url"]).select("source", "url", "rowid", "source_type", "status", "reason")


@job("observation_upsert", """SELECT user_id AS item_id, arg_max(event_type,event_id) AS status, arg_max(event_id%9,event_id) AS podcast FROM events GROUP BY 1""")
def observation_upsert(t):
    return ops.observation_upsert(b.events(t).select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 9).alias("podcast"), F.col("event_type").alias("status"), F.lit(1).alias("stars"), F.col("ts").alias("observed_at"))).select("item_id", "status", "podcast")


@job("conversation_window", f"""WITH {TURNS}, p AS (SELECT *, lag(role) OVER w AS prole, lag(text) OVER w AS ptext FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)),
q AS (SELECT session, turn, substr(trim(regexp_replace(ptext,'\\s+',' ','g')),1,500) AS u, substr(trim(text),1,2000) AS a FROM p WHERE role='assistant' AND prole='user'), v AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS rn FROM q WHERE u<>'' AND a<>'')
SELECT session, CAST(count(*) AS INTEGER) AS exchanges, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(u)+length(a)) AS INTEGER) AS chars FROM v WHERE rn<=4 GROUP BY 1""")
def conversation_window(t):
    turns = t.stream("conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    return streams.run_available(streams.conversation_window(turns), "update", ["session"]).filter("exchanges > 0").select("session", "exchanges", "first_turn", "last_turn", "chars")


@job("first_write_wins", """SELECT user_id AS run_key, event_id%20 AS result_key, arg_min(event_type,event_id) AS kind, count(*) AS writes, count(DISTINCT event_type)>1 AS conflict FROM events GROUP BY 1,2""")
def first_write_wins(t):
    w = b.events(t).select(F.col("user_id").alias("run_key"), (F.col("event_id") % 20).alias("result_key"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return ops.first_write_wins(w, ["run_key", "result_key"], ["kind"])


@job("digest_versions", f"""WITH {HASHES}, d AS (SELECT item_id, 2 AS stored_seq, 'second' AS digest, revision FROM hashes WHERE item_id%4=0 UNION ALL SELECT item_id, 5, 'fifth', 'rev2' FROM hashes WHERE item_id%3=0), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY stored_seq DESC) AS rn FROM d)
SELECT item_id, revision, digest, CAST(stored_seq AS INTEGER) AS stored_seq FROM r WHERE rn=1""")
def digest_versions(t):
    h = cols.content_hashes(archived(t)).select("item_id", "content_sha256", "revision")
    current = h.withColumn("seq_from", F.lit(1)).unionByName(h.filter("item_id % 3 = 0").withColumn("revision", F.lit("rev2")).withColumn("seq_from", F.lit(4)))
    write = lambda df, seq, digest, rev: df.select("item_id", F.lit(seq).alias("seq"), F.col("content_sha256").alias("expected_sha"), rev.alias("expected_revision"), F.lit(digest).alias("digest"))
    four = h.filter("item_id % 4 = 0")
    writes = (write(four, 2, "second", F.col("revision")).unionByName(write(four, 3, "third", F.col("revision"))).unionByName(write(h, 3, "stale", F.lit("other")))
              .unionByName(write(h.filter("item_id % 3 = 0"), 5, "fifth", F.lit("rev2"))).unionByName(write(h.filter("item_id % 3 = 0"), 6, "old", F.col("revision"))))
    return ops.digest_versions(writes, current)


@job("first_claim", """WITH n AS (SELECT o_orderkey AS note_id, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE day(o_orderdate)%4=1) SELECT note_id, 'daily:' || CAST(min(r.day) AS VARCHAR) AS run_key FROM n JOIN r ON r.day>=n.day GROUP BY 1""")
def first_claim(t):
    day = F.to_date("o_orderdate")
    runs = t.orders.filter(F.dayofmonth(day) % 4 == 1).select(day.alias("day")).distinct().select("day", F.concat(F.lit("daily:"), "day").alias("run_key"))
    return ops.first_claim(t.orders.select(F.col("o_orderkey").alias("note_id"), day.alias("day")), runs)


@job("retry_schedule", """WITH a AS (SELECT event_id AS job, event_type='click' AS msg, user_id%7 AS n, ts FROM events) SELECT job, CASE WHEN n<5 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN n<5 THEN strftime(ts + to_seconds(CASE WHEN msg THEN [3,10,30,60][CAST(greatest(1,least(n,4)) AS INTEGER)] ELSE [60,300,900,1800][CAST(greatest(1,least(n,4)) AS INTEGER)] END),'%Y-%m-%d %H:%M:%S') END AS available FROM a""")
def retry_schedule(t):
    a = b.events(t).select(F.col("event_id").alias("job"), F.when(F.col("event_type") == "click", "message").otherwise("daily").alias("kind"), (F.col("user_id") % 7).alias("attempts"), F.col("ts").alias("failed_at"))
    return ops.retry_schedule(a).select("job", "status", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available"))


@job("attempt_budget", """SELECT user_id AS item_id, 'r' || (event_id%5) AS revision, count(*) AS tries, CASE WHEN bool_or(value>150) THEN 'completed' WHEN min(CAST(ts AS DATE))<>DATE '2024-01-30' OR count(*)>=3 THEN 'failed' ELSE 'pending' END AS status FROM events GROUP BY 1,2""")
def attempt_budget(t):
    a = b.events(t).select(F.col("user_id").alias("item_id"), F.concat(F.lit("r"), F.col("event_id") % 5).alias("revision"), F.to_date("ts").alias("day"), (F.col("value") > 150).alias("completed"))
    return ops.attempt_budget(a, F.lit("2024-01-30").cast("date"))


@job("context_expiry", """SELECT user_id * 100 + event_id%100 AS session FROM events GROUP BY 1 HAVING TIMESTAMP '2024-01-31' - max(ts) <= INTERVAL 168 HOUR""")
def context_expiry(t):
    c = b.events(t).groupBy((F.col("user_id") * 100 + F.col("event_id") % 100).alias("session")).agg(F.max("ts").alias("updated_at"))
    return ops.context_expiry(c, b.ts(b.NOW)).select("session")


@job("daily_archive", f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY day, item_id ORDER BY (status='summarized') DESC, run_created_at DESC, run_key DESC, created_at DESC, result_key DESC) AS rn FROM daily_items),
d AS (SELECT doc_id FROM documents), x AS (SELECT r.day, r.status, r.stars, r.item_id, d.doc_id IS NOT NULL AND r.item_id%4<>0 AND (r.result_key%3<>0) AS fresh FROM r LEFT JOIN d ON d.doc_id=r.item_id WHERE rn=1),
c AS (SELECT day, bool_and(value<200) AS complete FROM daily_items GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE status='summarized' AND fresh) AS summaries, count(*) FILTER (WHERE status='summarized' AND NOT fresh) AS stale, count(*) FILTER (WHERE status<>'summarized') AS others,
 CAST(coalesce(sum(stars) FILTER (WHERE status='summarized' AND fresh),0) AS BIGINT) AS stars, NOT any_value(complete) AS incomplete FROM x JOIN c USING (day) GROUP BY 1""")
def daily_archive(t):
    items = daily_items(t).withColumn("revision", F.when(F.col("result_key") % 3 == 0, "old").otherwise("now"))
    runs = items.groupBy("day", "run_key").agg(F.bool_and(F.col("value") < 200).alias("analysis_complete"))
    tr = t.documents.select(F.col("doc_id").alias("item_id"), F.lit("now").alias("revision"))
    return ops.daily_archive(items, runs, tr, tr.filter("item_id % 4 <> 0")).withColumn("day", F.col("day").cast("string"))


@job("resolve_catalog_refs", f"""WITH {CATALOG}, al AS (SELECT ref, 'title' AS kind, alias FROM ({_aliases('title')}) UNION ALL SELECT ref, 'show', alias FROM ({_aliases('show_name')})), fr AS (SELECT alias, count(*) AS n FROM al GROUP BY 1),
cp AS (SELECT ref, regexp_replace(lower(title),'[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+','','g') AS ct, regexp_replace(lower(show_name),'[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+','','g') AS cs FROM cat),
q AS (SELECT ref AS query_id, ref%3 AS k, title, show_name FROM cat), qq AS (SELECT query_id, regexp_replace(lower('please ' || CASE k WHEN 0 THEN title WHEN 1 THEN '不是 ' || title ELSE title || ' of ' || show_name END || ' now'),'[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+','','g') AS q FROM q),
nm AS (SELECT ref, kind, alias, FALSE AS whole FROM al UNION ALL SELECT ref, 'title', ct, TRUE FROM cp WHERE length(ct)>=3 UNION ALL SELECT ref, 'show', cs, TRUE FROM cp WHERE length(cs)>=3),
h AS (SELECT query_id, ref, kind, whole OR coalesce(n,0)=1 AS good, contains(q,'不是'||nm.alias) OR contains(q,'不要'||nm.alias) OR contains(q,'排除'||nm.alias) AS neg FROM qq JOIN nm ON contains(q, nm.alias) LEFT JOIN fr ON fr.alias=nm.alias),
p AS (SELECT query_id, ref, bool_or(neg) AS neg, bool_or(good AND kind='title') AS t, bool_or(good AND kind='show') AS s FROM h GROUP BY 1,2), f AS (SELECT * FROM p WHERE NOT neg AND (t OR s)), bo AS (SELECT query_id, bool_or(t AND s) AS two FROM f GROUP BY 1)
SELECT query_id, ref FROM f JOIN bo USING (query_id) WHERE NOT two OR (t AND s)""")
def resolve_catalog_refs(t):
    c = catalog(t)
    k = F.col("ref") % 3
    text = F.when(k == 0, F.col("title")).when(k == 1, F.concat(F.lit("不是 "), "title")).otherwise(F.concat("title", F.lit(" of "), "show"))
    q = c.select(F.col("ref").alias("query_id"), F.concat(F.lit("please "), text, F.lit(" now")).alias("query"))
    return ops.resolve_catalog_refs(q, c)
