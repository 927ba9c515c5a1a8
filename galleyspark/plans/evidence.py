"""Section 2.3 grounding, receipt and request jobs on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.operators import columns as cols
from galleyspark.operators import evidence as ops
from galleyspark.plans import bindings as b
from galleyspark.plans.columns import HASHES, archived
from galleyspark.plans.editorial import _NORM
from galleyspark.plans.registry import job


@job("current_digests", f"""WITH {HASHES}, d AS (SELECT l.doc_id AS item_id, CASE WHEN l.doc_id%4=0 THEN 'x' ELSE content_sha256 END AS s, CASE WHEN l.toxic=1 THEN 'y' ELSE revision END AS r, 'digest ' || l.quality AS digest FROM labels l JOIN hashes h ON h.item_id=l.doc_id)
SELECT h.item_id, CASE WHEN s=content_sha256 AND r=revision THEN digest ELSE '' END AS digest, CASE WHEN s IS NULL THEN 'missing' WHEN s=content_sha256 AND r=revision THEN 'current' ELSE 'stale' END AS state FROM hashes h LEFT JOIN d USING (item_id)""")
def current_digests(t):
    h = cols.content_hashes(archived(t))
    d = h.join(t.labels.withColumnRenamed("doc_id", "item_id"), "item_id").select(
        "item_id", F.when(F.col("item_id") % 4 == 0, "x").otherwise(F.col("content_sha256")).alias("content_sha256"), F.when(F.col("toxic") == 1, "y").otherwise(F.col("revision")).alias("revision"), F.concat(F.lit("digest "), "quality").alias("digest"))
    return ops.current_digests(h, d)


QUOTES = """q AS (SELECT doc_id * 10 + k AS quote_id, doc_id AS item_id, CASE WHEN k=0 THEN upper(substr(text, 5, 60)) WHEN k=1 THEN substr(text, 3, 6) ELSE substr(text, 40, 30) || 'zz' END AS text FROM documents, (VALUES (0),(1),(2)) v(k))"""


def doc_quotes(t):
    k = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.upper(F.substring("text", 5, 60)).alias("q")), F.struct(F.lit(1).alias("k"), F.substring("text", 3, 6).alias("q")),
                          F.struct(F.lit(2).alias("k"), F.concat(F.substring("text", 40, 30), F.lit("zz")).alias("q"))))
    return t.documents.select("doc_id", k.alias("x")).select((F.col("doc_id") * 10 + F.col("x.k")).alias("quote_id"), F.col("doc_id").alias("item_id"), F.col("x.q").alias("text"))


@job("quote_grounding", f"""WITH {QUOTES}, n AS (SELECT quote_id, q.item_id, {_NORM.format('q.text')} AS q, {_NORM.format('d.text')} AS body FROM q JOIN documents d ON d.doc_id=q.item_id), g AS (SELECT *, length(q)>=12 AND contains(body,q) AS grounded FROM n)
SELECT item_id, count(*) AS quotes, count(*) FILTER (WHERE grounded) AS grounded, count(DISTINCT CASE WHEN grounded THEN q END) AS distinct_grounded FROM g GROUP BY 1""")
def quote_grounding(t):
    return ops.distinct_quotes(ops.quote_grounding(doc_quotes(t), t.documents.select(F.col("doc_id").alias("item_id"), "text")))


@job("quote_sources", f"""WITH q AS (SELECT item_id AS quote_id, {_NORM.format('text')} AS q FROM benchmark), d AS (SELECT doc_id AS item_id, {_NORM.format('text')} AS body FROM documents) SELECT quote_id, item_id FROM q, d WHERE length(q)>=12 AND contains(body,q)""")
def quote_sources(t):
    return ops.quote_sources(t.benchmark.select(F.col("item_id").alias("quote_id"), "text"), t.documents.select(F.col("doc_id").alias("item_id"), "text"))


@job("citation_integrity", r"""WITH c AS (SELECT conv_id AS item_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations),
f AS (SELECT conv_id*100+turn AS answer_id, conv_id AS item_id, turn, length(text) % 7 AS f, trim(substr(regexp_replace(text,'\s+',' ','g'), 1, 40)) AS quote FROM conversations),
p AS (SELECT f.*, CASE WHEN f=6 THEN turn + 50 ELSE turn END AS cited, CASE WHEN f=4 THEN quote || ' zz' WHEN f=5 THEN '' ELSE quote END AS qq FROM f),
u AS (SELECT *, CAST(len(regexp_extract_all(qq, '[\x{3400}-\x{9fff}]|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS BIGINT) AS un FROM p)
SELECT answer_id, CASE WHEN f=3 THEN 7::BIGINT WHEN f=2 THEN 4::BIGINT ELSE 1::BIGINT END AS points, CASE WHEN f=3 THEN 7*un WHEN f=2 THEN 4*un ELSE un END AS units,
 CASE WHEN f=3 THEN 'too_many_points' WHEN f=1 THEN 'bad_text' WHEN f=6 THEN 'bad_citation' WHEN f=5 OR un=0 THEN 'bad_quote' WHEN f=4 THEN 'quote_not_in_chunk' WHEN CASE WHEN f=2 THEN 4*un ELSE un END > 25 THEN 'quotes_too_long' END AS problem FROM u""")
def citation_integrity(t):
    k = F.length("text") % 7
    turn = F.col("turn")
    cid = lambda c: F.concat(F.lit("C"), F.lpad((c + 1).cast("string"), 4, "0"))
    quote = F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 40))
    qq = F.when(k == 4, F.concat(quote, F.lit(" zz"))).when(k == 5, "").otherwise(quote)
    point = F.struct(F.when(k == 1, "two\nlines").otherwise("a claim").alias("text"), F.array(cid(F.when(k == 6, turn + 50).otherwise(turn))).alias("citations"), qq.alias("quote"))
    answers = t.conversations.select((F.col("conv_id") * 100 + turn).alias("answer_id"), F.col("conv_id").alias("item_id"), F.array_repeat(point, F.when(k == 3, 7).when(k == 2, 4).otherwise(1)).alias("points"))
    chunks = t.conversations.select(F.col("conv_id").alias("item_id"), cid(turn).alias("chunk_id"), "text")
    return ops.citation_integrity(answers, chunks)


@job("evidence_coverage", """SELECT conv_id AS item_id, count(*) AS units, count(*) FILTER (WHERE NOT (role='assistant' OR length(text)%2=0)) AS missing, min(turn) FILTER (WHERE NOT (role='assistant' OR length(text)%2=0)) AS first_missing,
 count(*) FILTER (WHERE NOT (role='assistant' OR length(text)%2=0)) = 0 AS complete FROM conversations GROUP BY 1""")
def evidence_coverage(t):
    units = t.conversations.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("unit"))
    turns = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("unit"))
    excluded = t.conversations.filter("length(text) % 2 = 0").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("unit"))
    return ops.evidence_coverage(units, turns.union(excluded))


@job("supported_terms", r"""WITH d AS (SELECT doc_id, text, string_split(text,' ') AS p FROM documents), tt AS (SELECT doc_id AS term_id, doc_id AS item_id, text, CASE doc_id%4 WHEN 0 THEN upper(coalesce(p[3],'')) WHEN 1 THEN coalesce(p[2],'') || ' ' || coalesce(p[3],'') WHEN 2 THEN substr(text,2,5) ELSE 'zzzz' END AS original FROM d),
n AS (SELECT term_id, item_id, ' ' || trim(regexp_replace(regexp_replace(translate(replace(lower(original),'ß','ss'),'ς','σ'),'\p{P}',' ','g'),'[\s\x{a0}]+',' ','g')) || ' ' AS o, ' ' || trim(regexp_replace(regexp_replace(translate(replace(lower(text),'ß','ss'),'ς','σ'),'\p{P}',' ','g'),'[\s\x{a0}]+',' ','g')) || ' ' AS e FROM tt)
SELECT term_id, item_id FROM n WHERE trim(o)<>'' AND contains(e,o)""")
def supported_terms(t):
    p = F.split("text", " ")
    g = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    k = F.col("doc_id") % 4
    terms = t.documents.select(F.col("doc_id").alias("term_id"), F.col("doc_id").alias("item_id"), F.lit(0).alias("unit"),
                               F.when(k == 0, F.upper(g(2))).when(k == 1, F.concat_ws(" ", g(1), g(2))).when(k == 2, F.substring("text", 2, 5)).otherwise("zzzz").alias("original"))
    return ops.supported_terms(terms, t.documents.select(F.col("doc_id").alias("item_id"), F.lit(0).alias("unit"), "text")).select("term_id", "item_id")


@job("reconcile_deliveries", """WITH d AS (SELECT event_id AS delivery_id, user_id%20 AS chat, CAST(floor(value) AS INTEGER)%40 AS body, ts AS created_at FROM events WHERE event_type='click'),
r AS (SELECT event_id AS message_id, user_id%20 AS chat, CAST(floor(value) AS INTEGER)%40 AS body, ts AS sent_at FROM events WHERE event_type='view' AND event_id%9<>0),
m AS (SELECT delivery_id, count(message_id) AS n, max(message_id) AS message_id FROM d LEFT JOIN r ON d.chat=r.chat AND d.body=r.body AND r.sent_at >= d.created_at - INTERVAL 1 SECOND AND r.sent_at <= TIMESTAMP '2024-01-31 00:00:01' GROUP BY 1)
SELECT delivery_id, CASE WHEN n=1 THEN 'sent' WHEN n>1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN n=1 THEN message_id END AS message_id FROM m""")
def reconcile_deliveries(t):
    e = b.events(t).select("event_id", "event_type", "ts", (F.col("user_id") % 20).alias("chat"), F.lit("post").alias("kind"), F.lit("").alias("parent"), (F.floor("value").cast("int") % 40).alias("body"))
    d = e.filter("event_type = 'click'").select(F.col("event_id").alias("delivery_id"), "chat", "kind", "parent", "body", F.col("ts").alias("created_at"))
    r = e.filter("event_type = 'view'").select(F.col("event_id").alias("message_id"), "chat", "kind", "parent", "body", F.col("ts").alias("sent_at"), (F.col("event_id") % 9 != 0).alias("by_app"), F.lit(False).alias("deleted"))
    return ops.reconcile_deliveries(d, r, b.ts(b.NOW))


@job("missing_receipts", """WITH e AS (SELECT user_id%5 AS chat, ts + to_hours(8) AS at, event_type, value, event_id FROM events), d AS (SELECT DISTINCT chat, CAST("at" AS DATE) AS day FROM e),
g AS (SELECT chat, CAST("at" AS DATE) AS day, max("at") AS last_sent FROM e WHERE event_type='signup' AND value>120 AND "at" <= TIMESTAMP '2024-01-30 09:00:00' GROUP BY 1,2)
SELECT chat, CAST(day AS VARCHAR) AS day, CASE WHEN TIMESTAMP '2024-01-30 09:00:00' < CAST(day AS TIMESTAMP) + to_minutes(557) THEN 'not_due' WHEN last_sent >= CAST(day AS TIMESTAMP) + to_minutes(510) THEN 'delivered' ELSE 'missing' END AS state FROM d LEFT JOIN g USING (chat, day)""")
def missing_receipts(t):
    e = b.events(t).select((F.col("user_id") % 5).alias("chat"), F.from_utc_timestamp("ts", "Asia/Shanghai").alias("sent_at"), "event_type", "value")
    days = e.select("chat", F.to_date("sent_at").alias("day")).distinct()
    msgs = e.select("chat", "sent_at", F.when(F.col("value") > 120, F.to_date("sent_at")).alias("marked_day"), (F.col("event_type") == "signup").alias("by_app"), F.lit(False).alias("deleted"))
    return ops.missing_receipts(days, msgs, b.ts("2024-01-30 09:00:00")).withColumn("day", F.col("day").cast("string"))


@job("reply_targets", """WITH d AS (SELECT event_id AS delivery_id, event_id%500 AS remote, user_id%20 AS chat, 1+user_id%3 AS n, user_id*10 AS first FROM events WHERE event_type='purchase' AND value<100),
l AS (SELECT remote, arg_max(chat,delivery_id) AS chat, max(delivery_id) AS delivery_id, arg_max(n,delivery_id) AS n, arg_max(first,delivery_id) AS first FROM d GROUP BY 1)
SELECT e.event_id AS message_id, l.delivery_id, CAST(n AS INTEGER) AS items, CASE WHEN n=1 THEN first END AS item_id FROM events e JOIN l ON l.remote=e.event_id%700 AND l.chat=e.user_id%20 WHERE e.event_type='click'""")
def reply_targets(t):
    e = b.events(t)
    user = F.col("user_id")
    d = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("delivery_id"), (F.col("event_id") % 500).alias("remote_id"), F.when(F.col("value") < 100, "sent").otherwise("pending").alias("status"), (user % 20).alias("chat"),
                                                   F.transform(F.sequence(F.lit(0).cast("long"), user % 3), lambda i: user * 10 + i).alias("items"))
    r = e.filter("event_type = 'click'").select(F.col("event_id").alias("message_id"), (user % 20).alias("chat"), (F.col("event_id") % 700).alias("parent"))
    return ops.reply_targets(r, d)


@job("request_status", """WITH q AS (SELECT conv_id AS session, conv_id*100+turn AS request_id, turn, role FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS rn FROM q WHERE role='user'),
a AS (SELECT conv_id AS session, conv_id*100+turn-1 AS request_id, substr(text,1,30) AS answer FROM conversations WHERE role='assistant'), d AS (SELECT (user_id%100)*100 + event_id%8 AS request_id, count(*) FILTER (WHERE value<60) AS sent, count(*) FILTER (WHERE value>=60) AS unsent FROM events GROUP BY 1)
SELECT u.session, u.request_id, CAST(rn AS INTEGER) AS recency, CASE WHEN turn%3=0 THEN 'completed' ELSE 'pending' END AS status, answer, CASE WHEN u.request_id%5=0 THEN 'delivered' ELSE 'not_recorded' END AS outcome, coalesce(sent,0) AS sent, coalesce(unsent,0) AS unsent
FROM u LEFT JOIN a USING (session, request_id) LEFT JOIN d USING (request_id) WHERE rn<=8""")
def request_status(t):
    c = t.conversations.select(F.col("conv_id").alias("session"), (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), "turn", "role", "text")
    req = c.filter("role = 'user'").select("session", "request_id", F.col("turn").alias("created_at"), F.when(F.col("turn") % 3 == 0, "completed").otherwise("pending").alias("status"))
    ans = c.filter("role = 'assistant'").select("session", (F.col("request_id") - 1).alias("request_id"), F.substring("text", 1, 30).alias("answer"))
    audits = req.filter("request_id % 5 = 0").select("session", "request_id", F.lit("delivered").alias("outcome"))
    dl = b.events(t).select(((F.col("user_id") % 100) * 100 + F.col("event_id") % 8).alias("request_id"), F.when(F.col("value") < 60, "sent").otherwise("pending").alias("status"))
    return ops.request_status(req, ans, audits, dl)


@job("unanswered_mentions", """SELECT conv_id*100+turn AS message_id, CASE WHEN length(text)%3=0 THEN 'unanswered' WHEN turn%4=0 THEN 'failed' ELSE 'existing' END AS state FROM conversations WHERE role='user'""")
def unanswered_mentions(t):
    m = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), "text", "turn")
    return ops.unanswered_mentions(m.union(m), m.filter("length(text) % 3 <> 0").select("message_id", F.when(F.col("turn") % 4 == 0, "failed").otherwise("completed").alias("status")))


@job("episode_documents", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey%5=1 THEN 'd'||o_orderkey WHEN o_orderkey%5=2 THEN 'e'||o_orderkey END AS doc_ref, CASE WHEN o_orderkey%5 IN (1,2) THEN 'ok' WHEN o_orderkey%5=3 THEN 'ambiguous' ELSE 'none' END AS state FROM orders""")
def episode_documents(t):
    k = F.col("o_orderkey")
    items = t.orders.select(k.alias("item_id"), F.concat(F.lit("Talk｜part "), k).alias("title"), F.concat(F.lit("Show "), F.col("o_custkey") % 10).alias("show"))
    by_id = items.filter("item_id % 5 IN (1, 3)").select(F.concat(F.lit("d"), "item_id").alias("doc_ref"), "item_id", "title")
    twice = items.filter("item_id % 5 = 3").select(F.concat(F.lit("x"), "item_id").alias("doc_ref"), "item_id", "title")
    old = items.filter("item_id % 5 = 2").select(F.concat(F.lit("e"), "item_id").alias("doc_ref"), F.lit(None).cast("long").alias("item_id"), F.concat("title", F.lit("｜"), "show", F.lit("｜2024")).alias("title"))
    return ops.item_documents(items, by_id.union(twice).union(old))


@job("missing_enrichment", """WITH p AS (SELECT l_orderkey AS run_key, l_linenumber AS part, min(l_linestatus) AS ls FROM lineitem GROUP BY 1,2), s AS (SELECT run_key, bool_and(ls='F') AS fully FROM p GROUP BY 1),
o AS (SELECT run_key, part FROM p JOIN s USING (run_key) WHERE fully), r AS (SELECT DISTINCT l_orderkey AS run_key, l_partkey AS item_id FROM lineitem WHERE l_returnflag='R'),
x AS (SELECT o.run_key, o.part, r.item_id FROM o JOIN r USING (run_key) WHERE NOT (item_id%2=0 AND part<4)), a AS (SELECT o_orderkey AS run_key, o_custkey%5 AS tries FROM orders)
SELECT x.run_key, count(DISTINCT part) AS messages, count(*) AS missing, coalesce(any_value(tries),0) AS tries FROM x LEFT JOIN a USING (run_key) WHERE coalesce(tries,0)<3 GROUP BY 1""")
def missing_enrichment(t):
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("run_key"), F.col("l_linenumber").alias("part")).agg(F.min("l_linestatus").alias("ls"))
    full = parts.groupBy("run_key").agg(F.bool_and(F.col("ls") == "F").alias("fully_sent"))
    mid = F.concat_ws("/", "run_key", "part")
    sent = parts.join(full, "run_key").select("run_key", mid.alias("message_id"), "fully_sent", "part")
    ready = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_key"), F.col("l_partkey").alias("item_id")).distinct()
    receipts = sent.filter("part < 4").join(ready.filter("item_id % 2 = 0"), "run_key").select("message_id", "item_id")
    attempts = t.orders.filter("o_custkey % 5 > 0").select(F.col("o_orderkey").alias("run_key"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 5)))
    return ops.missing_enrichment(sent, ready, receipts, attempts.select("run_key"))
