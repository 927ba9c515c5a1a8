"""Section 2.2 jobs on the driver tables.

Where the reference reads text the tables do not hold (durations, links, digests), the text is derived from whole tables
by Spark first, in forms whose right answer follows from the columns it was made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.operators import columns as ops
from galleyspark.operators.editorial import reading_advice as advise
from galleyspark.operators.editorial import score_reviews_strict
from galleyspark.plans import bindings as b
from galleyspark.plans.editorial import ADVISED, STRICT
from galleyspark.plans.registry import job

_SPLIT = """p AS (SELECT page_id, url, lower(regexp_extract(url,'^([A-Za-z]+)://',1)) AS scheme, lower(regexp_extract(url,'^[A-Za-z]+://([^/?#]*)',1)) AS host,
 rtrim(regexp_extract(url,'^[A-Za-z]+://[^/?#]*([^?#]*)',1),'/') AS path, string_split(regexp_extract(url,'\\?([^#]*)',1),'&') AS q FROM pages)"""
_FEEDQ = "list_sort(list_filter(q, lambda x: x<>'' AND NOT starts_with(lower(x),'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','igshid','ref','ref_src','si','_hsenc','_hsmi'], lower(split_part(x,'=',1)))))"
URL_KEY = f"CASE WHEN scheme IN ('http','https') AND host<>'' THEN 'https://' || host || path || CASE WHEN len({_FEEDQ})>0 THEN '?' || array_to_string({_FEEDQ},'&') ELSE '' END ELSE '' END"


@job("url_key", f"WITH {_SPLIT} SELECT page_id, {URL_KEY} AS key FROM p")
def url_key(t):
    return t.pages.select("page_id", keys.url_key("url").alias("key"))


@job("media_key", f"""WITH {_SPLIT}, f AS (SELECT *, list_sort(list_filter(q, lambda x: regexp_matches(x,'=.') AND NOT starts_with(x,'utm_') AND NOT list_contains(['fbclid','gclid'], split_part(x,'=',1)))) AS fq FROM p)
SELECT page_id, CASE WHEN scheme IN ('http','https') AND host<>'' THEN regexp_replace(host,'^www\\.','') || path || '?' || coalesce(array_to_string(fq,'&'),'') ELSE '' END AS key FROM f""")
def media_key(t):
    return t.pages.select("page_id", keys.media_key("url").alias("key"))


K11 = "substr(sha256(CAST(o_orderkey AS VARCHAR)),1,11)"


def video_links(t):
    """orders -> links to videos in every known form, and to other things."""
    k = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 11)
    forms = ["https://www.youtube.com/watch?v={}&t=3", "https://youtu.be/{}?si=x", "https://m.youtube.com/shorts/{}", "https://www.youtube.com/embed/{}",
             "http://www.youtube.com/watch?v={}", "https://youtube.com/watch?v=a{}", "https://video.example.org/watch?v={}"]
    url = F.element_at(F.array(*[F.concat(F.lit(f.split("{}")[0]), k, F.lit(f.split("{}")[1])) for f in forms]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    title = F.concat(F.lit("Talk "), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 17 == 0, " #Shorts").otherwise(""))
    return t.orders.select(F.col("o_orderkey").alias("item_id"), url.alias("url"), title.alias("title"), F.lit(None).cast("string").alias("description"), (F.col("o_totalprice") / 100).alias("duration"))


@job("video_id", f"SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 < 4 THEN {K11} END AS video_id FROM orders")
def video_id(t):
    return video_links(t).select("item_id", keys.video_id("url").alias("video_id"))


@job("drop_short_form", "SELECT o_orderkey AS item_id FROM orders WHERE NOT (o_orderkey % 7 IN (0,1,2,3,5) AND (o_orderkey % 7 = 2 OR o_orderkey % 17 = 0 OR o_totalprice/100 < 900))")
def drop_short_form(t):
    return ops.drop_short_form(video_links(t)).select("item_id")


@job("safe_public_url", "SELECT page_id, CASE WHEN starts_with(url,'https://') THEN url END AS safe FROM pages")
def safe_public_url(t):
    return t.pages.select("page_id", keys.safe_public_url("url").alias("safe"))


_W = r"array_to_string(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'),' ')"
_F = "translate(replace(lower({}),'ß','ss'),'ς','σ')"
_NOISE = ",".join(f"'{w}'" for w in keys.NOISE_WORDS)


@job("title_keys", rf"""WITH tt AS (SELECT page_id, replace(regexp_extract(html,'<title>([^<]*)</title>',1), '%', '') AS title FROM pages), f AS (SELECT *, {_F.format('title')} AS f FROM tt)
SELECT page_id, coalesce(array_to_string(regexp_extract_all(f,'[a-z0-9]+'),' '),'') AS ascii_title, coalesce({_W.format('f')},'') AS word_title,
 coalesce({_W.format(r"split_part(regexp_replace(f,'^\s*(?:ep\.?|episode)\s*\d+\s*[-:–—]?\s*',''),'|',1)")},'') AS core_title,
 regexp_replace(coalesce({_W.format('f')},''),'^the ','') AS show_key,
 regexp_replace(trim(regexp_replace(regexp_replace(f,'[^\p{{L}}\p{{N}}\s]',' ','g'),'\s+',' ','g')),'^the ','') AS source_name_key,
 strip_accents(f) AS accent_free,
 coalesce(array_to_string(list_filter(regexp_extract_all(lower(strip_accents(title)),'[a-z0-9]+'), lambda w: NOT list_contains([{_NOISE}],w) AND NOT regexp_full_match(w,'\d+')),' '),'') AS noise_free FROM f""")
def title_keys(t):
    c = t.pages.select("page_id", F.replace(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("%"), F.lit("")).alias("title"))
    return c.select("page_id", keys.ascii_title("title").alias("ascii_title"), keys.word_title("title").alias("word_title"), keys.core_title("title").alias("core_title"),
                    keys.show_key("title").alias("show_key"), keys.source_name_key("title").alias("source_name_key"),
                    keys.accent_free_title("title").alias("accent_free"), keys.noise_free_title("title").alias("noise_free"))


@job("duration_seconds", """WITH s AS (SELECT o_orderkey AS item_id, CAST(floor(o_totalprice/10) AS BIGINT) AS n, o_orderkey % 7 AS f FROM orders)
SELECT item_id, CASE WHEN f < 3 AND n > 0 THEN n::DOUBLE END AS clock_seconds, CASE WHEN f = 3 AND n > 0 THEN n::DOUBLE END AS iso_seconds,
 CASE WHEN f < 2 OR f = 4 THEN CASE WHEN n > 0 THEN CAST(round_even(n/60.0::DOUBLE,0) AS BIGINT) || ' 分钟' ELSE '未提供' END
  WHEN f = 2 THEN CASE WHEN n >= 0 THEN CAST(round_even(n/60.0::DOUBLE,0) AS BIGINT) || ' 分钟' END
  WHEN f = 3 THEN 'PT' || (n//3600) || 'H' || ((n//60)%60) || 'M' || (n%60) || 'S' WHEN f = 5 THEN '1:2:3:4' ELSE '未提供' END AS label FROM s""")
def duration_seconds(t):
    n = F.floor(F.col("o_totalprice") / 10).cast("long")
    p2 = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    f = F.col("o_orderkey") % 7
    text = (F.when(f == 0, n.cast("string")).when(f == 1, F.concat(F.floor(n / 60).cast("string"), F.lit(":"), p2(s)))
            .when(f == 2, F.concat(h.cast("string"), F.lit(":"), p2(m), F.lit(":"), p2(s)))
            .when(f == 3, F.concat(F.lit("PT"), h, F.lit("H"), m, F.lit("M"), s, F.lit("S")))
            .when(f == 4, F.concat(h, F.lit("小时"), m, F.lit("分钟"), s, F.lit("秒"))).when(f == 5, "1:2:3:4").otherwise(""))
    d = t.orders.select(F.col("o_orderkey").alias("item_id"), text.alias("text"))
    return d.select("item_id", keys.duration_seconds("text").alias("clock_seconds"), keys.iso_duration_seconds("text").alias("iso_seconds"), keys.duration_label("text").alias("label"))


@job("published_utc", """SELECT o_orderkey AS item_id, strftime(CASE o_orderkey % 8 WHEN 0 THEN o_orderdate - INTERVAL 2 HOUR WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate - to_minutes(330) WHEN 6 THEN NULL ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS published FROM orders""")
def published_utc(t):
    d = F.col("o_orderdate").cast("timestamp")
    f = F.col("o_orderkey") % 8
    text = (F.when(f == 0, F.concat(F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))).when(f == 1, F.concat(F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(f == 2, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).when(f == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(f == 4, F.date_format(d, "yyyyMMdd"))
            .when(f == 5, F.unix_seconds(d).cast("string")).when(f == 6, "last Tuesday").otherwise(F.date_format(d, "yyyy-MM-dd")))
    return t.orders.select(F.col("o_orderkey").alias("item_id"), text.alias("text")).select("item_id", F.date_format(keys.published_utc("text"), "yyyy-MM-dd HH:mm:ss").alias("published"))


@job("accept_by_keywords", rf"""WITH d AS (SELECT doc_id AS item_id, CAST(substr(source,4) AS INTEGER) % 2 AS plain, {_F.format("split_part(text, chr(10), 1)")} AS title FROM documents)
SELECT item_id FROM d WHERE plain = 1 OR regexp_matches(title,'(^|[^a-z0-9])(und|of the)([^a-z0-9]|$)')""")
def accept_by_keywords(t):
    items = t.documents.select(F.col("doc_id").alias("item_id"), "source", F.lit("https://example.org/").alias("url"), F.substring_index("text", "\n", 1).alias("title"),
                               F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("duration"))
    src = t.documents.select("source").distinct().withColumn("keywords", F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, F.array(F.lit("Und"), F.lit("of the"))).otherwise(F.array().cast("array<string>")))
    return ops.accept_by_keywords(items, src).select("item_id")


@job("in_lookback", f"""WITH {b.ITEMS} SELECT item_id FROM items WHERE item_id % 13 = 0 OR published_at BETWEEN TIMESTAMP '1998-06-15' - to_hours(8760) AND TIMESTAMP '1998-06-15' OR (item_id % 10 = 0 AND published_at <= TIMESTAMP '1998-06-15')""")
def in_lookback(t):
    i = b.items(t).select("item_id", F.when(F.col("item_id") % 13 != 0, F.col("published_at")).alias("published_at"), (F.col("item_id") % 10 == 0).alias("promoted"))
    return ops.in_lookback(i, b.ts(b.ITEM_NOW), 8760).select("item_id")


HASHES = """hashes AS (SELECT doc_id AS item_id, sha256(text) AS content_sha256, substr(sha256(CAST(doc_id AS VARCHAR)),1,8) AS reference,
 sha256('{"episode":{"duration_seconds":' || n_chars || '.0,"duration_string":' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"' || (n_chars//60) || ':00"' END || ',"id":"' || doc_id || '","published_at":null,"show":"' || source || '","title":"Title ' || doc_id || '","url":"https://example.org/' || doc_id || '"},"transcript":{"content_sha256":"' || sha256(text) || '","language":"' || lang || '","source":"archive","source_url":"https://example.org/t/' || doc_id || '"}}') AS revision FROM documents)"""


def archived(t):
    """documents -> archived transcripts."""
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("item_id"), F.concat(F.lit("Title "), d).alias("title"), F.concat(F.lit("https://example.org/"), d).alias("url"), F.col("source").alias("show"),
        F.col("n_chars").cast("double").alias("duration_seconds"), F.when(d % 4 != 0, F.concat(F.floor(F.col("n_chars") / 60), F.lit(":00"))).alias("duration_string"),
        F.lit(None).cast("string").alias("published_at"), "text", F.lit("archive").alias("source"), F.concat(F.lit("https://example.org/t/"), d).alias("source_url"), F.col("lang").alias("language"))


@job("content_hashes", f"WITH {HASHES} SELECT * FROM hashes")
def content_hashes(t):
    return ops.content_hashes(archived(t))


@job("chapter_markers", """WITH i AS (SELECT o_orderkey AS item_id, o_orderkey % 5 AS n, 20 + o_custkey % 50 AS step, o_totalprice/1000 AS duration, o_orderkey % 10 = 3 AS swapped, o_orderkey % 11 = 2 AS late FROM orders),
c AS (SELECT *, unnest(range(0, n)) AS k FROM i), s AS (SELECT item_id, CAST(k AS INTEGER) AS pos, n, duration, k, CAST((CASE WHEN swapped THEN n - 1 - k ELSE k END) * step + CASE WHEN late THEN 90 ELSE 0 END AS INTEGER) AS seconds FROM c),
g AS (SELECT *, max(seconds) OVER (PARTITION BY item_id) AS top, min(seconds) FILTER (WHERE k = 0) OVER (PARTITION BY item_id) AS opening, lag(seconds) OVER (PARTITION BY item_id ORDER BY k) AS prev FROM s),
ok AS (SELECT item_id FROM g GROUP BY 1 HAVING max(top) < max(duration) AND max(opening) <= 60 AND count(*) >= 2 AND bool_and(coalesce(prev < seconds, TRUE)))
SELECT item_id, pos, (seconds//60) || ':' || lpad(CAST(seconds % 60 AS VARCHAR),2,'0') AS stamp, seconds, 'Part ' || pos AS title FROM s WHERE item_id IN (SELECT item_id FROM ok)""")
def chapter_markers(t):
    n, step = (F.col("o_orderkey") % 5).cast("int"), (20 + F.col("o_custkey") % 50).cast("int")

    def cue(k):
        sec = F.when(F.col("o_orderkey") % 10 == 3, n - 1 - k).otherwise(k) * step + F.when(F.col("o_orderkey") % 11 == 2, 90).otherwise(0)
        return F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), F.lpad((sec % 60).cast("string"), 2, "0"), F.lit(" Part "), k.cast("string"))

    cues = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), cue)).otherwise(F.array().cast("array<string>"))
    d = t.orders.select(F.col("o_orderkey").alias("item_id"), F.concat_ws("\n", F.lit("About this talk"), cues).alias("description"), (F.col("o_totalprice") / 1000).alias("duration"))
    return ops.chapter_markers(d)


@job("digest_format", """SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 5 = 4 THEN 'invalid' WHEN o_orderkey % 5 = 3 OR o_orderkey % 7 = 0 THEN 'usable' ELSE ['v4','narrative','legacy'][CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS format FROM orders""")
def digest_format(t):
    k = F.col("o_orderkey")
    glyphs = F.when(k % 7 == 0, "★☆★☆☆").otherwise("★★★☆☆")
    fill = F.repeat(F.lit("plain words "), 8)
    tail = F.concat(F.lit("\n推荐理由：it was worth the hour\n推荐星级："), glyphs)
    v4 = F.concat(F.lit("## Talk number "), k, F.lit("\n节目：Weekly\n时长：50 分钟\n简介："), fill, F.lit("\n要点总结：\n1. first point\n2. second point"), tail)
    narrative = F.concat(F.lit("## Talk number "), k, F.lit("\n节目：Weekly show\n## 内容解读\n"), fill, F.lit("\n\n"), fill, tail)
    legacy = F.concat(F.lit("## Talk number "), k, F.lit("\n推荐理由：it was worth the hour\n"), F.lit("1. first point about "), fill, F.lit("\n### Topic\n2. second point\n推荐星级："), glyphs)
    legacy_bad = F.concat(F.lit("## Talk number "), k, F.lit("\n"), fill)
    f = k % 5
    text = F.when(f == 0, v4).when(f == 1, narrative).when((f == 2) & (k % 7 != 0), legacy).when((f == 2) | (f == 3), legacy_bad).otherwise(F.concat(F.lit("note "), k))
    return ops.digest_format(t.orders.select(k.alias("item_id"), text.alias("markdown")))


ANSWERS = """answers AS (SELECT conv_id AS session, turn, trim(CASE length(text) % 6 WHEN 0 THEN text || ':' WHEN 1 THEN text || chr(10) || '- ' WHEN 2 THEN '好的，我会整理一下。' WHEN 3 THEN '```' || chr(10) || text || chr(10) || 'end' WHEN 4 THEN text || chr(10) || '## Head' ELSE text END) AS v FROM conversations)"""


@job("answer_completeness", rf"""WITH {ANSWERS}, l AS (SELECT *, trim(string_split(v, chr(10))[-1]) AS last FROM answers)
SELECT session, turn, CASE WHEN v='' THEN 'empty' WHEN regexp_matches(last,'[:：]\s*$') THEN 'unfinished_introduction' WHEN regexp_full_match(last,'[-*+]\s*|\d+[.)、]\s*|#{{1,6}}\s*.+') THEN 'unfinished_list'
 WHEN len(regexp_extract_all(v,'(?m)^\s*```')) % 2 = 1 THEN 'unclosed_code'
 WHEN regexp_full_match(v,'(?:好的[，。]?|收到[，。]?|可以[，。]?)?\s*(?:我会|我来|我将|让我).{{0,65}}(?:整理|分析|检查|查询|总结|处理)(?:一下)?[。！!]*') THEN 'promise_only' END AS problem FROM l""")
def answer_completeness(t):
    k = F.length("text") % 6
    text = (F.when(k == 0, F.concat("text", F.lit(":"))).when(k == 1, F.concat("text", F.lit("\n- "))).when(k == 2, "好的，我会整理一下。").when(k == 3, F.concat(F.lit("```\n"), "text", F.lit("\nend")))
            .when(k == 4, F.concat("text", F.lit("\n## Head"))).otherwise(F.col("text")))
    return ops.answer_completeness(t.conversations.select(F.col("conv_id").alias("session"), "turn", text.alias("text")))


@job("valid_targets", """SELECT c_custkey AS seq, 'oc_' || c_custkey AS target FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0 AND c_acctbal > 1000""")
def valid_targets(t):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "chat_id").when(k % 3 == 1, "open_id").otherwise("email")
    targets = t.customer.select(k.alias("seq"), kind.alias("kind"), F.concat(F.when(k % 3 == 1, "ou_").otherwise("oc_"), k, F.when(k % 7 == 0, "!").otherwise("")).alias("target"))
    allow = t.customer.filter("c_acctbal > 1000").select(F.concat(F.lit("oc_"), k).alias("target"))
    return ops.valid_targets(targets, allow).select("seq", "target")


@job("stars_and_level", f"""WITH {b.REVIEWS}, {STRICT}, {ADVISED} SELECT item_id, stars, CASE WHEN item_id % 2 = 0 THEN CASE advice WHEN '值得编译' THEN 2 WHEN '值得看全文' THEN 1 ELSE 0 END WHEN stars=5 THEN 2 WHEN stars=4 THEN 1 ELSE 0 END AS level FROM advised""")
def stars_and_level(t):
    a = advise(score_reviews_strict(b.reviews(t)))
    text = F.concat(F.lit("## Talk\n推荐星级："), F.repeat(F.lit("★"), F.col("stars")), F.repeat(F.lit("☆"), 5 - F.col("stars")),
                    F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("\n阅读建议："), "advice", F.lit("\n"))).otherwise(""))
    return ops.stars_and_level(a.select("item_id", text.alias("markdown")))


@job("glossary_normalise", """SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 AND contains(text,' the ') THEN replace(replace(replace(text,' of ',' 世界-动作模型 '), '世界-动作模型','world action model'),'世界动作模型','world action model') ELSE replace(text,' of ',' 世界-动作模型 ') END AS text FROM documents""")
def glossary_normalise(t):
    src = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" World-Action Model "))).otherwise(F.col("text"))
    return ops.glossary_normalise(t.documents.select(F.col("doc_id").alias("item_id"), src.alias("source_text"), F.replace("text", F.lit(" of "), F.lit(" 世界-动作模型 ")).alias("text")), ops.GLOSSARY)


@job("speaker_labels_reliable", """WITH c AS (SELECT conv_id AS item_id, role, count(*) AS n FROM conversations WHERE regexp_matches(text,'^\\s*\\S') GROUP BY 1,2)
SELECT item_id, count(*) AS labels, count(*) FILTER (WHERE n >= 2) >= 2 AS reliable FROM c GROUP BY 1""")
def speaker_labels_reliable(t):
    return ops.speaker_labels_reliable(t.conversations.select(F.col("conv_id").alias("item_id"), F.concat("role", F.lit(": "), "text").alias("text")))


@job("quote_units", r"""SELECT item_id, CAST(len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]|[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')) AS INTEGER) AS units FROM benchmark""")
def quote_units(t):
    return t.benchmark.select("item_id", ops.quote_units("text").alias("units"))


@job("warning_fingerprints", """WITH w AS (SELECT user_id % 20 AS job_key, event_type AS code, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE strftime(ts,'%Y-%m-%d') END AS day,
 CASE WHEN event_id % 3 = 0 THEN substr(sha256('t' || (user_id % 4)),1,12) END AS target, CASE WHEN event_id % 2 = 0 THEN user_id % 3 END AS used FROM events WHERE event_type IN ('error','view'))
SELECT DISTINCT job_key, code, day, target, sha256('{"code": "' || code || '", "day": "' || day || '"' || CASE WHEN used IS NOT NULL THEN ', "limit": 3' ELSE '' END || CASE WHEN target IS NOT NULL THEN ', "target": "' || target || '"' ELSE '' END || CASE WHEN used IS NOT NULL THEN ', "used": ' || used ELSE '' END || '}') AS identity FROM w""")
def warning_fingerprints(t):
    e = b.events(t).filter(F.col("event_type").isin("error", "view"))
    w = e.select((F.col("user_id") % 20).alias("job_key"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 5 == 0, "someday").otherwise(F.date_format("ts", "yyyy-M-d")).alias("day"),
                 F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("user_id") % 4)).alias("target"), F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 3).alias("used"), F.lit(3).alias("limit_n"))
    return ops.warning_fingerprints(w)
