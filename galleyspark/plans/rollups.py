"""Section 2.4 jobs on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.operators import rollups as ops
from galleyspark.operators.windows import latest_fetch_status
from galleyspark.plans import bindings as b
from galleyspark.plans.registry import job
from galleyspark.plans.windows import DAILY, FETCH, daily_items, fetch

_COUNTS = ", ".join(f"count(*) FILTER (WHERE status='{s}') AS {s}" for s in ops.REPORTED_STATUSES)
_PEND = "('no_transcript','unverified_date','summary_format_error')"


@job("coverage_counts", f"""WITH {DAILY}, c AS (SELECT CAST(day AS VARCHAR) AS run_key, {_COUNTS}, count(*) FILTER (WHERE status IN {_PEND}) AS pending FROM daily_items GROUP BY 1),
h AS (SELECT CAST(day AS VARCHAR) AS run_key, item_id, result_key, row_number() OVER (PARTITION BY day ORDER BY result_key) AS rn FROM daily_items WHERE status IN {_PEND}),
l AS (SELECT run_key, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rn) AS listed FROM h WHERE rn <= 6 GROUP BY 1)
SELECT c.*, coalesce(listed,'') AS listed, greatest(pending - 6, 0) AS more FROM c LEFT JOIN l USING (run_key)""")
def coverage_counts(t):
    rows = daily_items(t).select(F.col("day").cast("string").alias("run_key"), F.col("result_key").alias("seq"), "item_id", "status")
    return ops.coverage_counts(rows)


@job("assign_status", f"""WITH {b.ITEMS}, {b.REVIEWS}, {b.SCORED},
i AS (SELECT item_id, CASE WHEN item_id % 13 = 0 THEN NULL ELSE published_at END AS published_at, item_id % 4 = 0 AS is_video, duration, source = 's9' AS disc FROM items)
SELECT i.item_id, CASE WHEN i.published_at IS NULL THEN 'unverified_date' WHEN i.published_at < TIMESTAMP '1998-06-15' - to_hours(17520) THEN 'outside_window'
  WHEN is_video AND duration < 60000 THEN 'final_skipped' WHEN s.item_id IS NULL THEN 'no_transcript' WHEN s.error IS NOT NULL THEN 'failed'
  WHEN s.stars < 3 THEN CASE WHEN disc THEN 'discovery_filtered' ELSE 'editorial_filtered' END WHEN NOT (s.quotes >= 3) THEN 'summary_format_error' ELSE 'summarized' END AS status
FROM i LEFT JOIN scored s USING (item_id)""")
def assign_status(t):
    from galleyspark.operators.editorial import score_reviews

    scored = score_reviews(b.reviews(t))
    items = b.items(t).select("item_id", F.when(F.col("item_id") % 13 != 0, F.col("published_at")).alias("published_at"),
                              (F.col("item_id") % 4 == 0).alias("is_video"), "duration", (F.col("source") == "s9").alias("is_discovery"))
    texts = t.lineitem.select(F.col("l_orderkey").alias("item_id")).distinct()
    return ops.assign_status(items, texts, scored, scored.select("item_id", (F.col("quotes") >= 3).alias("usable")), b.ts(b.ITEM_NOW), 17520, 60000.0)


_NAMED = ",".join(f"'{x}'" for x in ops.REPORTED_STATUSES)
_STATUSES = [*ops.REPORTED_STATUSES, "queued", "sent"]


@job("run_health", f"""WITH d AS (SELECT CAST(ts + to_hours(8) AS DATE) AS day, ts, user_id, event_id, event_type, value FROM events)
, g AS (SELECT day, bool_or(event_type='signup' AND user_id % 3 > 0) AS subscribed, bool_or(event_type='view' AND user_id < 10) AS has_run,
  coalesce(bool_and(value < 150) FILTER (WHERE event_type='view' AND user_id < 10), FALSE) AS analysis_complete,
  count(*) FILTER (WHERE event_type='purchase' AND user_id % 25 = 1) AS sends, count(*) FILTER (WHERE event_type='purchase' AND user_id % 25 = 1 AND value < 100) AS sent,
  max(ts) FILTER (WHERE event_type='purchase' AND user_id % 25 = 1 AND value < 100) AS last_sent_at,
  count(*) FILTER (WHERE event_type='error' AND value >= 20) AS backlog, count(*) FILTER (WHERE event_type='error' AND value >= 20 AND ts < TIMESTAMP '2024-01-31' - to_hours(72)) AS backlog_old,
  count(*) FILTER (WHERE event_type='click' AND value > 150) AS failed_runs FROM d GROUP BY 1),
s AS (SELECT *, CAST(day AS TIMESTAMP) + to_minutes(510) AS sched, sends > 0 AND sends = sent AS delivered, max(last_sent_at) OVER (ORDER BY day) AS last_send FROM g),
c AS (SELECT *, delivered AND has_run AND analysis_complete AS complete FROM s),
o AS (SELECT *, subscribed AND NOT complete AND TIMESTAMP '2024-01-29 08:40:00' >= sched + to_minutes(45) AS overdue FROM c),
st AS (SELECT day, ([{",".join(f"'{x}'" for x in _STATUSES)}])[event_id % {len(_STATUSES)} + 1] AS status FROM d WHERE event_type='view'),
n AS (SELECT day, status || '=' || count(*) AS x FROM (SELECT day, CASE WHEN status IN ({_NAMED}) THEN status ELSE 'other' END AS status FROM st) GROUP BY day, status),
cn AS (SELECT day, string_agg(x, ' ' ORDER BY x) AS counts FROM n GROUP BY 1),
wl AS (SELECT day, 'quota:day=' || day || ':target=' || user_id || CASE WHEN event_id%2=0 THEN ':used=' || (user_id%9) || '/9' ELSE '' END AS x FROM d WHERE event_type='signup' AND value > 150
 UNION SELECT day, 'episode_document_retry_stopped:' || count(*) FROM d WHERE event_type='error' AND value > 50 GROUP BY day
 UNION SELECT day, 'document link missing:episode=' || substr(sha256(CAST(user_id AS VARCHAR)),1,12) || ':day=' || day FROM d WHERE (event_type='error' AND value > 50) OR (event_type='click' AND value > 100)),
w AS (SELECT day, string_agg(x, ' | ' ORDER BY x) AS warnings FROM wl GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, sends, sent, backlog, backlog_old, failed_runs, overdue, strftime(last_send,'%Y-%m-%d %H:%M:%S') AS last_send, counts, warnings,
 CASE WHEN NOT subscribed THEN 'not_subscribed' WHEN complete THEN 'sent' WHEN overdue THEN 'overdue' WHEN delivered THEN 'partial' WHEN has_run THEN 'processing'
  WHEN TIMESTAMP '2024-01-29 08:40:00' < sched THEN 'not_due' ELSE 'pending' END AS state FROM o LEFT JOIN cn USING (day) LEFT JOIN w USING (day)""")
def run_health(t):
    e = b.events(t).withColumn("day", F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai")))
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    run = (kind == "view") & (user < 10)
    bundle = (kind == "purchase") & (user % 25 == 1)
    waits = (kind == "error") & (value >= 20)
    days = e.groupBy("day").agg(
        F.bool_or((kind == "signup") & (user % 3 > 0)).alias("subscribed"), F.bool_or(run).alias("has_run"),
        F.coalesce(F.bool_and(F.when(run, value < 150)), F.lit(False)).alias("analysis_complete"),
        F.count_if(bundle).alias("sends"), F.count_if(bundle & (value < 100)).alias("sent"), F.max(F.when(bundle & (value < 100), F.col("ts"))).alias("last_sent_at"),
        F.count_if(waits).alias("backlog"), F.count_if(waits & (F.col("ts") < b.ts(b.NOW) - F.make_dt_interval(F.lit(0), F.lit(72)))).alias("backlog_old"),
        F.count_if((kind == "click") & (value > 150)).alias("failed_runs"))
    named = e.withColumn("day", F.col("day").cast("string"))
    status = F.element_at(F.array(*[F.lit(x) for x in _STATUSES]), (F.col("event_id") % len(_STATUSES) + 1).cast("int"))
    counts = ops.reported_counts(named.filter(kind == "view").select("day", status.alias("status")))
    limited = F.col("event_id") % 2 == 0
    operational = named.filter((kind == "signup") & (value > 150)).select("day", F.lit("quota").alias("code"), user.cast("string").alias("target"), F.when(limited, user % 9).alias("used"), F.when(limited, F.lit(9)).alias("limit"))
    attempts = named.filter(kind == "error").select("day", F.when(value > 50, "failed").otherwise("ok").alias("status"))
    missing = named.filter(((kind == "error") & (value > 50)) | ((kind == "click") & (value > 100))).select("day", user.alias("item_id")).distinct()
    health = ops.run_health(days, b.ts("2024-01-29 08:40:00")).withColumn("day", F.col("day").cast("string"))
    return health.join(counts, "day", "left").join(ops.health_warnings(operational, attempts, missing), "day", "left").select(
        "day", "sends", "sent", "backlog", "backlog_old", "failed_runs", "overdue", F.date_format("last_send", "yyyy-MM-dd HH:mm:ss").alias("last_send"), "counts", "warnings", "state")


@job("missing_document_links", """SELECT user_id AS item_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type='error' AND value > 50
UNION SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) FROM events WHERE event_type='click' AND value > 100""")
def missing_document_links(t):
    e = b.events(t).select(F.col("user_id").alias("item_id"), F.to_date("ts").cast("string").alias("day"), "event_type", "value")
    attempts = e.withColumn("status", F.when((F.col("event_type") == "error") & (F.col("value") > 50), "failed").otherwise("ok"))
    runs = e.withColumn("kind", F.when(F.col("event_type") == "click", "document").otherwise("daily")).withColumn("status", F.when(F.col("value") > 100, "failed").otherwise("done"))
    return ops.missing_document_links(attempts, runs)


@job("watch_catalogs", """SELECT user_id AS podcast, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events
WHERE event_type='purchase' AND 1 + CAST(floor(value) AS INTEGER) % 5 >= 4 AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1 HAVING count(*) >= 2 ORDER BY max(ts) DESC, 1 LIMIT 20""")
def watch_catalogs(t):
    obs = daily_items(t).select(F.col("item_id").alias("podcast"), "status", "stars", F.col("created_at").alias("observed_at"))
    return ops.watch_catalogs(obs, b.ts(b.NOW)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@job("delivery_rollup", """WITH p AS (SELECT l_orderkey AS run_key, l_linenumber AS part, arg_min(l_linestatus, (l_partkey, l_suppkey, l_linestatus)) AS ls FROM lineitem GROUP BY 1,2)
SELECT run_key, count(*) AS total, count(*) FILTER (WHERE ls='F') AS sent, count(*) FILTER (WHERE ls<>'F') AS open, count(*) FILTER (WHERE ls<>'F') = 0 AS fully_sent FROM p GROUP BY 1""")
def delivery_rollup(t):
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("run_key"), F.col("l_linenumber").alias("part")).agg(
        F.min_by("l_linestatus", F.struct("l_partkey", "l_suppkey", "l_linestatus")).alias("ls"))
    return ops.delivery_rollup(parts.select("run_key", F.when(F.col("ls") == "F", "sent").otherwise("pending").alias("status")))


@job("daily_quota", """WITH RECURSIVE d AS (SELECT event_type AS stream, CAST(ts AS DATE) AS day, user_id AS asset, min((ts, event_id)) AS f FROM events GROUP BY 1,2,3),
l AS (SELECT stream, day, row_number() OVER (PARTITION BY stream ORDER BY day) AS n, list(asset ORDER BY f) AS assets FROM d GROUP BY 1,2),
walk AS (SELECT stream, 0 AS n, NULL::DATE AS day, []::BIGINT[] AS got, []::BIGINT[] AS held FROM (SELECT DISTINCT stream FROM l)
 UNION ALL SELECT stream, n, day, got, list_concat(held, got) FROM (SELECT w.stream, l.n, l.day, w.held, list_filter(l.assets, lambda a: NOT list_contains(w.held, a))[1:3] AS got FROM walk w JOIN l ON l.stream=w.stream AND l.n=w.n+1))
SELECT stream, day, unnest(got) AS asset, CAST(unnest(range(1, len(got)+1)) AS INTEGER) AS slot FROM walk""")
def daily_quota(t):
    req = b.events(t).select(F.col("event_type").alias("stream"), F.to_date("ts").alias("day"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("user_id").alias("asset"))
    return ops.daily_quota(req, 3)


@job("corpus_totals", f"""WITH {FETCH}, r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY run_at DESC, rowid DESC) AS rn FROM fetches WHERE run_at >= TIMESTAMP '2024-01-28' AND run_at <= TIMESTAMP '2024-01-31'),
s AS (SELECT CASE WHEN status='failed' THEN 'failed_feeds' WHEN reason<>'' THEN 'recovered_feeds' END AS measure FROM r WHERE rn=1)
SELECT 'archived_transcripts' AS measure, count(*) AS n FROM documents UNION ALL SELECT 'archived_items', count(*) FROM pages
UNION ALL SELECT measure, count(*) FROM s WHERE measure IS NOT NULL GROUP BY 1""")
def corpus_totals(t):
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    feeds = latest_fetch_status(fetch(t), b.ts(b.NOW)).filter(F.col("state") != "healthy").groupBy(F.concat(F.col("state"), F.lit("_feeds")).alias("measure")).agg(F.count("*").alias("n"))
    return count(t.documents, "archived_transcripts").unionByName(count(t.pages, "archived_items")).unionByName(feeds)


@job("scan_outcome", """WITH f AS (SELECT strftime(ts,'%Y-%m-%d %H') AS scan, count(*) FILTER (WHERE event_type='error') AS failed, count(*) FILTER (WHERE event_type<>'error') AS successful FROM events GROUP BY 1),
c AS (SELECT strftime(ts,'%Y-%m-%d %H') AS scan, count(*) AS candidates, count(*) FILTER (WHERE value > 60) AS discovery FROM events WHERE event_type='purchase' GROUP BY 1)
SELECT scan, failed, successful, coalesce(candidates,0) AS candidates, coalesce(discovery,0) AS discovery,
 failed > 0 AND coalesce(discovery,0)=0 AND (coalesce(candidates,0)=0 OR failed >= successful) AS unhealthy FROM f LEFT JOIN c USING (scan)""")
def scan_outcome(t):
    e = b.events(t).withColumn("scan", F.date_format("ts", "yyyy-MM-dd HH"))
    f = e.select("scan", F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return ops.scan_outcome(f, e.filter(F.col("event_type") == "purchase").select("scan", (F.col("value") > 60).alias("is_discovery")))


@job("discovery_summary", """WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS scan, event_id AS ordinal, user_id AS item_id, ts AS published_at,
 CASE WHEN value < 5 THEN 'invalid' WHEN value > 200 THEN 'outside' ELSE 'ok' END AS verdict, event_type<>'error' AS request_ok FROM events),
i AS (SELECT scan, item_id, arg_min(published_at, ordinal) AS published_at, min(ordinal) AS ordinal FROM r WHERE verdict='ok' GROUP BY 1,2),
c AS (SELECT scan, count(*) FILTER (WHERE request_ok) AS requests_ok, count(*) FILTER (WHERE NOT request_ok) AS requests_failed, count(*) FILTER (WHERE verdict='invalid') AS invalid FROM r GROUP BY 1),
n AS (SELECT scan, count(*) AS items FROM i GROUP BY 1), h AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY published_at DESC, ordinal) AS rn FROM i)
SELECT scan, item_id, ordinal, CAST(rn AS INTEGER) AS rn, requests_ok, requests_failed, invalid, items, items > 40 AS capped FROM h JOIN c USING (scan) JOIN n USING (scan) WHERE rn <= 40""")
def discovery_summary(t):
    verdict = F.when(F.col("value") < 5, "invalid").when(F.col("value") > 200, "outside").otherwise("ok")
    rows = b.events(t).select(F.to_date("ts").cast("string").alias("scan"), F.col("event_id").alias("ordinal"), F.col("user_id").alias("item_id"), F.col("ts").alias("published_at"),
                              verdict.alias("verdict"), (F.col("event_type") != "error").alias("request_ok"))
    return ops.discovery_summary(rows, 40).drop("published_at")


@job("speech_density", r"""WITH f AS (SELECT doc_id AS item_id, n_chars/900.0::DOUBLE AS minutes, trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS flat FROM documents),
m AS (SELECT item_id, minutes, length(flat) AS chars, CASE WHEN flat='' THEN 0 ELSE len(string_split(flat,' ')) END AS words FROM f), w AS (SELECT *, words/minutes AS wpm FROM m)
SELECT item_id, chars, words, round(wpm,6) AS wpm, chars >= 5000 AND words >= greatest(900, minutes*80) AND wpm BETWEEN 80 AND 280 AS plain_ok,
 words >= 1000 AND wpm BETWEEN 70 AND 230 AS publisher_a_ok, words >= 1000 AND wpm BETWEEN 70 AND 260 AS publisher_b_ok, wpm BETWEEN 70 AND 220 AS publisher_c_ok,
 wpm BETWEEN 60 AND 260 AND chars >= greatest(5000, round_even(minutes,0)*300) AS captions_ok, chars >= greatest(5000, round_even(minutes,0)*180) AS official_ok FROM w""")
def speech_density(t):
    return ops.speech_density(t.documents.select(F.col("doc_id").alias("item_id"), "text", (F.col("n_chars") / 900.0).alias("minutes")))


LABELLED = """labelled AS (SELECT doc_id AS item_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: (CASE i % 3 WHEN 0 THEN 'Ada: ' WHEN 1 THEN 'Ben Ray: ' ELSE '' END) || x), chr(10)) AS text FROM documents)"""


def labelled_transcripts(t):
    """documents with a speaker label before two of every three lines."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.when((i + 1) % 3 == 0, "Ada: ").when((i + 1) % 3 == 1, "Ben Ray: ").otherwise(""), x))
    return t.documents.select(F.col("doc_id").alias("item_id"), F.array_join(lines, "\n").alias("text"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@job("turn_distribution", f"""WITH {LABELLED}, base AS (SELECT item_id, length(text) AS total, regexp_replace(trim(text), '{_WS}', ' ', 'g') AS flat FROM labelled),
bb AS (SELECT item_id, total, lower(substr(flat,1,2500)) AS op, lower(right(flat,3000)) AS cl FROM base),
l AS (SELECT item_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10)))+1)) AS i FROM labelled),
x AS (SELECT item_id, i - 1 AS n, length(parts[i]) AS len, regexp_extract(parts[i], '^([A-Za-z][A-Za-z .''-]{{0,40}}):\\s+', 1) AS label FROM l),
p AS (SELECT *, coalesce(sum(len+1) OVER (PARTITION BY item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM x),
a AS (SELECT item_id, count(*) FILTER (WHERE label<>'') AS turns, count(*) AS lines, count(DISTINCT CASE WHEN label<>'' THEN lower(trim(label)) END) AS speakers,
 count(DISTINCT CASE WHEN label<>'' THEN least(9, floor(off*10/greatest(1,total))) END) AS deciles, min(n) FILTER (WHERE label<>'') AS first_label, max(n) FILTER (WHERE label<>'') AS last_label
 FROM p JOIN bb USING (item_id) GROUP BY 1),
r AS (SELECT a.*, ({" OR ".join(f"contains(op, '{p.replace(chr(39), chr(39)*2)}')" for p in ops.OPENING)}) AS opening, ({" OR ".join(f"contains(cl, '{p.replace(chr(39), chr(39)*2)}')" for p in ops.CLOSING)}) AS closing FROM a JOIN bb USING (item_id)),
s AS (SELECT *, turns >= 20 AND speakers >= 2 AND deciles = 10 AS spread FROM r)
SELECT item_id, turns, speakers, deciles, opening, closing, spread, coalesce(first_label <= greatest(2, round_even(lines*0.05::DOUBLE,0)) AND last_label >= round_even(lines*0.8::DOUBLE,0), FALSE) AS edge_labels, spread AND opening AND closing AS complete FROM s""")
def turn_distribution(t):
    return ops.turn_distribution(labelled_transcripts(t))


OWNED = "SELECT doc_id AS item_id, replace(text, ' the ', ' 认为 ') AS text FROM documents"


@job("claim_owners", f"""WITH s AS ({OWNED}), d AS (SELECT item_id, substr(text, 1, length(text)//2) AS text FROM s),
a AS (SELECT item_id, unnest(regexp_extract_all(text, '{ops.OWNER}', 1)) AS owner FROM s), c AS (SELECT item_id, owner, count(*) AS n FROM a GROUP BY 1,2),
e AS (SELECT item_id, unnest(regexp_extract_all(text, '{ops.OWNER}', 1)) AS owner FROM d), f AS (SELECT item_id, owner, count(*) AS n FROM e GROUP BY 1,2)
SELECT item_id, owner, c.n AS in_source, coalesce(f.n,0) AS in_derived, coalesce(f.n,0) < c.n AS dropped FROM c LEFT JOIN f USING (item_id, owner)""")
def claim_owners(t):
    src = t.documents.select(F.col("doc_id").alias("item_id"), F.replace("text", F.lit(" the "), F.lit(" 认为 ")).alias("text"))
    half = src.select("item_id", F.expr("substr(text, 1, cast(length(text) div 2 as int))").alias("text"))
    return ops.claim_owners(src, half)


@job("number_preservation", f"""WITH p AS (SELECT doc_id AS item_id, text AS s, substr(text,1,length(text)//2) || ' 42' AS d FROM documents),
n AS (SELECT item_id, list_distinct(regexp_extract_all(regexp_replace(s,'{_WS}','','g'), '\\d+(?:[.,]\\d+)*')) AS s, list_distinct(regexp_extract_all(regexp_replace(d,'{_WS}','','g'), '\\d+(?:[.,]\\d+)*')) AS d FROM p)
SELECT item_id, CAST(len(s) AS INTEGER) AS numbers, coalesce(array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(d,x))),' '),'') AS missing,
 coalesce(array_to_string(list_sort(list_filter(d, lambda x: NOT list_contains(s,x))),' '),'') AS introduced FROM n""")
def number_preservation(t):
    return ops.number_preservation(t.documents.select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("source_text"), F.expr("concat(substr(text, 1, cast(length(text) div 2 as int)), ' 42')").alias("derived_text")))


@job("read_coverage", """SELECT conv_id AS item_id, count(*) FILTER (WHERE role='user' OR turn % 3 = 0) AS read, count(*) AS total, min(turn) FILTER (WHERE NOT (role='user' OR turn % 3 = 0)) AS next_unread FROM conversations GROUP BY 1""")
def read_coverage(t):
    chunks = t.conversations.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"))
    reads = t.conversations.filter((F.col("role") == "user") | (F.col("turn") % 3 == 0)).select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"))
    return ops.read_coverage(chunks, reads)


_STOP = ",".join(f"'{w}'" for w in ops.SELECTOR_STOPWORDS)


def _aliases(col):
    tok = f"list_filter(list_transform(regexp_extract_all({col}, '[a-z0-9][a-z0-9''’-]{{2,}}|[\\x{{3400}}-\\x{{9fff}}]{{3,}}'), lambda w: regexp_replace(lower(w),'[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+','','g')), lambda w: length(w)>=3 AND NOT list_contains([{_STOP}], w))"
    gram = lambda k: f"list_transform(range(1, len(tk) - {k} + 2), lambda i: array_to_string(tk[i:i+{k}-1], ''))"
    return f"""SELECT ref, unnest(list_distinct(list_concat(CASE WHEN length(cp)>=3 AND NOT list_contains([{_STOP}],cp) THEN [cp] ELSE [] END, tk, {gram(2)}, {gram(3)}, {gram(4)}))) AS alias
 FROM (SELECT ref, regexp_replace(lower({col}),'[^a-z0-9\\x{{3400}}-\\x{{9fff}}]+','','g') AS cp, {tok} AS tk FROM cat)"""


CATALOG = "cat AS (SELECT p_partkey AS ref, p_name || ' ' || lower(p_type) || ' no' || p_partkey AS title, p_brand || ' the weekly ' || lower(p_type) AS show_name FROM part)"


def catalog(t):
    """part -> named releases of shows."""
    kind = F.lower("p_type")
    return t.part.select(F.col("p_partkey").alias("ref"), F.concat("p_name", F.lit(" "), kind, F.lit(" no"), "p_partkey").alias("title"),
                         F.concat("p_brand", F.lit(" the weekly "), kind).alias("show"))


@job("alias_frequency", f"""WITH {CATALOG}, a AS ({_aliases('title')} UNION ALL {_aliases('show_name')}) SELECT alias, count(*) AS n, count(*) = 1 AS is_selector FROM a GROUP BY 1""")
def alias_frequency(t):
    return ops.alias_frequency(catalog(t))


@job("current_audience", "SELECT c_custkey AS seq, c_name AS target FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal > 2000")
def current_audience(t):
    frozen = t.customer.filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("target"))
    return ops.current_audience(frozen, t.customer.select(F.col("c_name").alias("target"), (F.col("c_acctbal") > 2000).alias("active")))


@job("scan_identity_union", f"""WITH {b.ITEMS} SELECT item_id, tier, source, CASE custkey % 4 WHEN 0 THEN 'publisher' WHEN 1 THEN 'video' WHEN 2 THEN 'text' ELSE 'discovery' END AS origin,
 CASE WHEN custkey % 4 = 1 THEN duration END AS duration FROM items""")
def scan_identity_union(t):
    i = b.items(t)
    kind = F.col("custkey") % 4
    return ops.scan_identity_union([
        ("publisher", i.filter(kind == 0).select("item_id", "tier", "source")), ("video", i.filter(kind == 1).select("item_id", "tier", "source", "duration")),
        ("text", i.filter(kind == 2).select("item_id", "tier", "source")), ("discovery", i.filter(kind == 3).select("item_id", "tier", "source"))])
