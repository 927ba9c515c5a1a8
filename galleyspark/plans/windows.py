"""Section 2.5 jobs on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.operators import windows as ops
from galleyspark.plans import bindings as b
from galleyspark.plans.registry import job

FETCH = """fetches AS (SELECT event_id AS rowid, ts AS run_at, user_id AS source, 'feed' || (event_id % 3) AS url,
  CASE WHEN user_id % 10 = 0 THEN 'text' ELSE 'rss' END AS source_type,
  CASE WHEN event_type='error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN value > 100 THEN 'slow' ELSE '' END AS reason FROM events)"""


def fetch(t):
    return b.events(t).select(
        F.col("event_id").alias("rowid"), F.col("ts").alias("run_at"), F.col("user_id").alias("source"),
        F.concat(F.lit("feed"), F.col("event_id") % 3).alias("url"),
        F.when(F.col("user_id") % 10 == 0, "text").otherwise("rss").alias("source_type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("value") > 100, "slow").otherwise("").alias("reason"))


@job("latest_fetch_status", f"""WITH {FETCH}, r AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY run_at DESC, rowid DESC) AS rn
  FROM fetches WHERE run_at >= TIMESTAMP '2024-01-28' AND run_at <= TIMESTAMP '2024-01-31')
SELECT source, url, strftime(run_at,'%Y-%m-%d %H:%M:%S') AS run_at, source_type, status, reason,
  CASE WHEN status='failed' THEN 'failed' WHEN status='ok' AND reason<>'' THEN 'recovered' ELSE 'healthy' END AS state
FROM r WHERE rn=1 AND (source_type='text' OR source IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 3))""")
def latest_fetch_status(t):
    rows = fetch(t)
    configured = t.customer.filter(F.col("c_custkey") % 4 != 3).select(F.col("c_custkey").alias("source"), F.lit(True).alias("configured"))
    got = ops.latest_fetch_status(rows, b.ts(b.NOW))
    return got.join(configured, "source", "left").filter((F.col("source_type") == "text") | F.col("configured")).select(
        "source", "url", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"), "source_type", "status", "reason", "state")


@job("pick_transcript", """WITH c AS (
  SELECT d.doc_id AS item_id, 'archive' AS provider, 1 AS rk, FALSE AS paid, coalesce(l.quality=1, FALSE) AS verified, FALSE AS error FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT doc_id, 'paid', 2, TRUE, n_chars >= 2000, n_chars % 17 = 0 FROM documents
  UNION ALL SELECT doc_id, 'captions', 3, FALSE, n_chars >= 600, n_chars % 5 = 0 FROM documents),
r AS (SELECT *, CASE WHEN item_id % 5 = 0 AND paid THEN 1000 ELSE rk END AS k FROM c)
SELECT item_id, arg_min(provider, k) FILTER (WHERE verified) AS provider,
 CASE WHEN bool_or(verified) THEN 'ok' WHEN bool_or(error) THEN 'source_error' ELSE 'no_transcript' END AS status FROM r GROUP BY 1""")
def pick_transcript(t):
    docs = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    n = F.col("n_chars")
    offers = F.array(
        F.struct(F.lit("archive").alias("provider"), F.lit(1).alias("provider_rank"), F.lit(False).alias("paid"),
                 F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"), F.lit(False).alias("error")),
        F.struct(F.lit("paid").alias("provider"), F.lit(2).alias("provider_rank"), F.lit(True).alias("paid"),
                 (n >= 2000).alias("verified"), (n % 17 == 0).alias("error")),
        F.struct(F.lit("captions").alias("provider"), F.lit(3).alias("provider_rank"), F.lit(False).alias("paid"),
                 (n >= 600).alias("verified"), (n % 5 == 0).alias("error")))
    cands = docs.select(F.col("doc_id").alias("item_id"), F.inline(offers))
    items = t.documents.select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 5 == 0).alias("is_video"))
    return ops.pick_transcript(cands, items)


DAILY = """daily_items AS (SELECT CAST(ts AS DATE) AS day, user_id AS item_id, strftime(ts,'%Y-%m-%d') || '/' || (hour(ts)//6) AS run_key,
  date_trunc('day', ts) + to_hours((hour(ts)//6)*6) AS run_created_at, ts AS created_at, event_id AS result_key, value,
  CASE event_type WHEN 'purchase' THEN 'summarized' WHEN 'error' THEN 'no_transcript' WHEN 'view' THEN 'editorial_filtered'
   WHEN 'click' THEN 'unverified_date' ELSE 'discovery_status' END AS status, 1 + CAST(floor(value) AS INTEGER) % 5 AS stars FROM events)"""


def daily_items(t):
    e = b.events(t)
    part = F.floor(F.hour("ts") / 6)
    # The status names of daily results.
    status = (F.when(F.col("event_type") == "purchase", "summarized").when(F.col("event_type") == "error", "no_transcript")
              .when(F.col("event_type") == "view", "editorial_filtered").when(F.col("event_type") == "click", "unverified_date")
              .otherwise("discovery_status"))
    return e.select(
        F.to_date("ts").alias("day"), F.col("user_id").alias("item_id"),
        F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), part).alias("run_key"),
        (F.date_trunc("day", "ts") + F.make_dt_interval(F.lit(0), (part * 6).cast("int"))).alias("run_created_at"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("result_key"), "value", status.alias("status"),
        (1 + F.floor("value").cast("int") % 5).alias("stars"))


@job("merge_daily_items", f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY day, item_id ORDER BY (status='summarized') DESC,
   run_created_at DESC, run_key DESC, created_at DESC, result_key DESC) AS rn FROM daily_items)
SELECT CAST(day AS VARCHAR) AS day, item_id, status, run_key, result_key FROM r WHERE rn=1""")
def merge_daily_items(t):
    return ops.merge_daily_items(daily_items(t)).withColumn("day", F.col("day").cast("string"))


CARRY = f"""{b.CONV_LINES}, l AS (SELECT *, (line_no > 0 AND length(line) < 25) AS is_reset, CASE WHEN line_no = 0 THEN role END AS label FROM conv_lines),
g AS (SELECT *, sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY turn, line_no) AS grp FROM l),
carried AS (SELECT item_id, turn, line_no, line, is_reset, CASE WHEN is_reset THEN NULL ELSE
  last_value(label IGNORE NULLS) OVER (PARTITION BY item_id, grp ORDER BY turn, line_no ROWS UNBOUNDED PRECEDING) END AS speaker FROM g)"""


def carried(t):
    lines = b.conversation_lines(t).withColumn("is_reset", (F.col("line_no") > 0) & (F.length("line") < 25)).withColumn(
        "label", F.when(F.col("line_no") == 0, F.col("role")))
    return ops.carry_speaker(lines, ["item_id"], ["turn"], ["turn", "line_no"])


@job("carry_speaker", f"WITH {CARRY} SELECT item_id, turn, line_no, speaker FROM carried")
def carry_speaker(t):
    return carried(t).select("item_id", "turn", "line_no", "speaker")


@job("merge_turns", f"""WITH {CARRY}, raw AS (SELECT item_id, turn, line_no, speaker, CASE WHEN is_reset THEN 'heading' ELSE 'speech' END AS kind,
  length(line) % 11 = 0 AS removed, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM carried),
blk AS (SELECT * FROM raw WHERE removed OR text <> ''),
p AS (SELECT *, lag(removed) OVER w AS pcut, lag(kind) OVER w AS pkind, lag(speaker) OVER w AS pwho, row_number() OVER w AS rn FROM blk WINDOW w AS (PARTITION BY item_id ORDER BY turn, line_no)),
s AS (SELECT *, CASE WHEN removed THEN 0 WHEN rn > 1 AND NOT pcut AND kind='speech' AND pkind='speech' AND pwho IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS starts FROM p),
i AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY item_id ORDER BY turn, line_no) AS BIGINT) AS island FROM s)
SELECT item_id, island, min(kind) AS kind, min(speaker) AS speaker, count(*) AS parts, string_agg(text, ' ' ORDER BY turn, line_no) AS text FROM i WHERE NOT removed GROUP BY 1,2""")
def merge_turns(t):
    blocks = carried(t).select("item_id", "turn", "line_no", "speaker", F.when(F.col("is_reset"), "heading").otherwise("speech").alias("kind"),
                               F.col("line").alias("text"), (F.length("line") % 11 == 0).alias("removed"))
    return ops.merge_turns(blocks, ["item_id"], ["turn"], ["turn", "line_no"])


@job("run_length_speakers", f"""WITH {b.CONV_LINES}, p AS (SELECT *, lag(role) OVER (PARTITION BY item_id ORDER BY turn, line_no) AS prev FROM conv_lines)
SELECT item_id, turn, line_no, role AS speaker FROM p WHERE prev IS NULL OR prev <> role""")
def run_length_speakers(t):
    lines = b.conversation_lines(t).withColumnRenamed("role", "speaker")
    return ops.run_length_speakers(lines, ["item_id"], ["turn"], ["turn", "line_no"]).select("item_id", "turn", "line_no", "speaker")


MEASURES = """dur AS (SELECT item_id, 60.5::DOUBLE*count(*) AS duration FROM segments GROUP BY 1),
c AS (SELECT item_id, {start} AS s, {end} AS e, duration FROM segments JOIN dur USING (item_id) WHERE {live}),
r AS (SELECT *, max(e) OVER (PARTITION BY item_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
f AS (SELECT *, CASE WHEN reach IS NULL OR s - reach > {bridge} THEN 1 ELSE 0 END AS opens FROM r),
g AS (SELECT *, sum(opens) OVER (PARTITION BY item_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM f),
isl AS (SELECT item_id, isl, max(e) - min(s) AS len FROM g GROUP BY 1,2),
cov AS (SELECT item_id, sum(len) AS covered FROM isl GROUP BY 1),
m AS (SELECT item_id, min(s) AS first_start, max(e) AS merged_end, arg_max(e, (s, e)) AS last_sorted_end,
  greatest(max(s - reach), 0) AS max_gap, max(duration) AS duration FROM r GROUP BY 1),
mm AS (SELECT * FROM m JOIN cov USING (item_id))"""
ROUNDED = """item_id, round(first_start,6) AS first_start, round(merged_end,6) AS merged_end, round(last_sorted_end,6) AS last_sorted_end,
 round(max_gap,6) AS max_gap, round(covered,6) AS covered, duration"""


def rounded(df):
    return df.select("item_id", *[F.round(c, 6).alias(c) for c in ("first_start", "merged_end", "last_sorted_end", "max_gap", "covered")],
                     "duration", "complete")


@job("strict_coverage", "WITH " + b.SEGMENTS + ", " + MEASURES.format(
    start="greatest(start_s, 0)", end="least(end_s, duration)", live="end_s > start_s AND end_s > 0 AND start_s < duration", bridge=30) + f"""
SELECT {ROUNDED}, duration > 0 AND first_start <= 30 AND last_sorted_end >= duration - greatest(45, duration*0.01)
  AND coalesce(max_gap,0) <= 60 AND covered >= duration*0.9 AS complete FROM mm""")
def strict_coverage(t):
    return rounded(ops.strict_coverage(ops.with_duration(b.segments(t))))


@job("caption_coverage", "WITH " + b.SEGMENTS + ", " + MEASURES.format(start="start_s", end="end_s", live="end_s > start_s", bridge=0) + f"""
SELECT {ROUNDED}, duration > 0 AND first_start <= least(180, duration*0.1) AND duration - merged_end <= least(180, duration*0.1)
  AND merged_end - first_start >= duration*0.85 AND covered >= duration*0.65
  AND coalesce(max_gap,0) <= least(180, greatest(60, duration*0.03)) AS complete FROM mm""")
def caption_coverage(t):
    return rounded(ops.caption_coverage(ops.with_duration(b.segments(t))))


@job("anchor_coverage", f"""WITH {b.SEGMENTS}, a AS (SELECT item_id, start_s, max(start_s) OVER (PARTITION BY item_id) + 300 AS duration, event_type FROM segments),
m AS (SELECT item_id, min(start_s) AS first_at, max(start_s) AS last_at, max(duration) AS duration FROM a WHERE event_type='view' GROUP BY 1)
SELECT *, first_at <= least(360, duration*0.12) AND last_at >= duration - least(1200, duration*0.25) AS covered FROM m""")
def anchor_coverage(t):
    seg = b.segments(t)
    dur = seg.groupBy("item_id").agg((F.max("start") + 300).alias("duration"))
    anchors = seg.filter(F.col("event_type") == "view").select("item_id", F.col("start").alias("at")).join(dur, "item_id")
    return ops.anchor_coverage(anchors, 0.12, 360.0, 0.25, 1200.0)


@job("turn_chronology", """WITH p AS (SELECT conv_id, turn, length(text) % 50 + turn*20 AS pos, lag(length(text) % 50 + turn*20) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id AS item_id, count(*) AS n, count(*) FILTER (WHERE pos < prev) AS falls, count(*) FILTER (WHERE pos < prev) = 0 AS in_order FROM p GROUP BY 1""")
def turn_chronology(t):
    rows = t.conversations.select(F.col("conv_id").alias("item_id"), "turn", (F.length("text") % 50 + F.col("turn") * 20).alias("evidence"),
                                  F.floor(F.col("turn") / 256).alias("blk"))
    return ops.non_decreasing(rows, ["item_id"], ["blk"], ["turn"], "evidence")


def turns(t):
    return t.conversations.select(F.col("conv_id").alias("session"), "turn", "role", "text",
                                  (b.ts(b.NOW) - F.make_dt_interval(F.lit(0), (F.col("conv_id") * 3).cast("int"))
                                   + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("at"))


TURNS = """turns AS (SELECT conv_id AS session, turn, role, text, TIMESTAMP '2024-01-31' - to_hours(CAST(conv_id*3 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS "at" FROM conversations)"""


@job("recent_turns", f"""WITH {TURNS}, p AS (SELECT *, lag(role) OVER w AS prole, lag(text) OVER w AS ptext FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn)),
q AS (SELECT session, turn, "at", substr(trim(regexp_replace(ptext, '\\s+', ' ', 'g')),1,500) AS "user", substr(trim(text),1,2000) AS assistant FROM p WHERE role='assistant' AND prole='user'),
v AS (SELECT * FROM q WHERE "user" <> '' AND assistant <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS rn, max("at") OVER (PARTITION BY session) AS upd FROM v)
SELECT session, turn, "user", assistant, CAST(rn AS INTEGER) AS age_rank FROM k WHERE rn <= 4 AND TIMESTAMP '2024-01-31' - upd <= INTERVAL 168 HOUR""")
def recent_turns(t):
    return ops.recent_turns(turns(t), b.ts(b.NOW)).select("session", "turn", "user", "assistant", "age_rank")


@job("ready_head", """WITH work AS (SELECT event_id AS rowid, user_id AS session, ts AS created_at, ts + to_minutes(CAST(floor(value) AS INTEGER)*60) AS available_at,
  CASE WHEN event_type IN ('view','click') THEN 'message' WHEN event_type='purchase' THEN 'daily' ELSE 'document' END AS kind,
  CASE WHEN event_type='view' AND value > 320 THEN 'processing' WHEN value > 20 THEN 'pending' ELSE 'done' END AS status, event_id % 2 = 0 AS scheduled FROM events),
m AS (SELECT * FROM work j WHERE kind='message' AND status='pending' AND available_at <= TIMESTAMP '2024-01-31' AND NOT EXISTS (
  SELECT 1 FROM work o WHERE o.kind='message' AND o.session=j.session AND o.rowid<>j.rowid AND (o.status='processing' OR (o.status='pending' AND (o.created_at<j.created_at OR (o.created_at=j.created_at AND o.rowid<j.rowid))))))
SELECT rowid, kind, session, 0 AS kind_class FROM m UNION ALL
SELECT rowid, kind, session, CASE WHEN kind='daily' AND scheduled THEN 1 ELSE 2 END FROM work WHERE kind<>'message' AND status='pending' AND available_at <= TIMESTAMP '2024-01-31'""")
def ready_head(t):
    kind = F.when(F.col("event_type").isin("view", "click"), "message").when(F.col("event_type") == "purchase", "daily").otherwise("document")
    status = F.when((F.col("event_type") == "view") & (F.col("value") > 320), "processing").when(F.col("value") > 20, "pending").otherwise("done")
    work = b.events(t).select(F.col("event_id").alias("rowid"), F.col("user_id").alias("session"), F.col("ts").alias("created_at"),
                              (F.col("ts") + F.make_dt_interval(F.lit(0), F.floor("value").cast("int"))).alias("available_at"),
                              kind.alias("kind"), status.alias("status"), (F.col("event_id") % 2 == 0).alias("scheduled"))
    return ops.ready_head(work, b.ts(b.NOW)).select("rowid", "kind", "session", "kind_class")


@job("previous_task", """SELECT conv_id AS session, max(turn) AS turn, arg_max(substr(text,1,40), turn) AS task, arg_max(role, turn) AS outcome FROM conversations GROUP BY 1""")
def previous_task(t):
    return ops.previous_task(t.conversations.select(F.col("conv_id").alias("session"), "turn", F.substring("text", 1, 40).alias("task"), F.col("role").alias("outcome")))
