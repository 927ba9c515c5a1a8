"""Section 2.3 entity-resolution jobs on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.operators import matching as ops
from galleyspark.operators import page_titles
from galleyspark.plans import bindings as b
from galleyspark.plans.columns import _F, _FEEDQ, _NOISE, _SPLIT, URL_KEY
from galleyspark.plans.editorial import scored_copies
from galleyspark.operators.editorial import representation_score
from galleyspark.plans.registry import job
from galleyspark.session import cut_lineage, dealt

_STOPW = ",".join(f"'{w}'" for w in keys.TITLE_STOPWORDS)


def syndicated(t):
    """documents -> feed items titled by their opening words, and videos with changed titles, dates and durations."""
    d = F.col("doc_id")
    words = F.split("text", " ")
    title = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (d % 200).cast("int"))
    rss = t.documents.select("source", d.alias("item_id"), title(1, 8).alias("title"), at.alias("published_at"), F.when(d % 17 != 0, F.col("n_chars").cast("double")).alias("duration"))
    vt = F.when(d % 4 == 0, title(1, 8)).when(d % 4 == 1, title(2, 7)).when(d % 4 == 2, F.concat(title(1, 8), F.lit(" live from town"))).otherwise(title(1, 4))
    video = t.documents.filter(d % 3 != 0).select(
        "source", (d + 1000000000).alias("item_id"), vt.alias("title"), F.when(d % 11 != 0, at + F.make_dt_interval(F.lit(0), ((d % 5) * 15).cast("int"))).alias("published_at"),
        F.when(d % 13 != 0, F.col("n_chars") * (1 - (d % 7) * 0.04)).alias("duration"))
    return rss, video


def _tw(c):
    return f"list_distinct(list_filter(regexp_extract_all({_F.format(c)},'[a-z0-9]+'), lambda w: length(w)>=2 AND NOT list_contains([{_STOPW}],w)))"


def _at(c):
    return f"coalesce(array_to_string(regexp_extract_all({_F.format(c)},'[a-z0-9]+'),' '),'')"


SYND = f"""w AS (SELECT *, string_split(text,' ') AS p, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id%200 AS INTEGER)) AS pub FROM documents),
rss AS (SELECT source, doc_id AS id, array_to_string(p[1:8],' ') AS title, pub AS published_at, CASE WHEN doc_id%17<>0 THEN n_chars::DOUBLE END AS duration FROM w),
vid AS (SELECT source, doc_id + 1000000000 AS id, CASE doc_id%4 WHEN 0 THEN array_to_string(p[1:8],' ') WHEN 1 THEN coalesce(array_to_string(p[2:8],' '),'') WHEN 2 THEN array_to_string(p[1:8],' ') || ' live from town' ELSE array_to_string(p[1:4],' ') END AS title,
 CASE WHEN doc_id%11<>0 THEN pub + to_hours(CAST((doc_id%5)*15 AS INTEGER)) END AS published_at, CASE WHEN doc_id%13<>0 THEN n_chars*(1-(doc_id%7)*0.04::DOUBLE) END AS duration FROM w WHERE doc_id%3<>0),
r AS (SELECT *, {_at('title')} AS t, {_tw('title')} AS w FROM rss), v AS (SELECT *, {_at('title')} AS t, {_tw('title')} AS w FROM vid),
c AS (SELECT r.source, r.id AS rid, v.id AS vid, r.t AS rt, v.t AS vt, len(r.w) AS nr, len(v.w) AS nv, len(list_intersect(r.w,v.w)) AS o, r.published_at AS rp, v.published_at AS vp, r.duration AS rd, v.duration AS vd FROM r JOIN v ON r.source=v.source),
f AS (SELECT *, least(nr,nv) AS small, CASE WHEN nr>0 AND nv>0 THEN o/least(nr,nv)::DOUBLE ELSE 0 END AS cn, CASE WHEN nr>0 AND nv>0 THEN o/(nr+nv-o)::DOUBLE ELSE 0 END AS jc, rt=vt AS ex, nr>=4 AND (contains(vt,rt) OR contains(rt,vt)) AS wi,
 rp IS NOT NULL AND vp IS NOT NULL AS hd, coalesce(rd,0)>0 AND coalesce(vd,0)>0 AS hl FROM c),
g AS (SELECT *, cn*0.65::DOUBLE + jc*0.35::DOUBLE + CASE WHEN hd THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN hl THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN ex THEN 0.1 ELSE 0 END::DOUBLE AS score FROM f
 WHERE (ex OR (o>=4 AND cn>=0.8::DOUBLE AND (jc>=0.5 OR wi))) AND CASE WHEN hd THEN abs(epoch_us(rp)-epoch_us(vp)) <= 172800000000 ELSE ex OR wi END
 AND CASE WHEN hl THEN least(rd,vd)/greatest(rd,vd) >= 0.82::DOUBLE ELSE ex OR (hd AND o>=4) OR (wi AND o>=5) END AND (hd OR hl) AND (small>3 OR (hd AND hl)))"""


@job("syndication_pairs", f"WITH {SYND} SELECT source, rid AS r_item_id, vid AS v_item_id, round(score,6) AS score FROM g")
def syndication_pairs(t):
    return ops.syndication_pairs(*syndicated(t)).withColumn("score", F.round("score", 6))


@job("attach_unique_best", f"""WITH RECURSIVE {SYND}, opts AS (SELECT source, rid, row_number() OVER (PARTITION BY source ORDER BY rid) AS n, list(struct_pack(score := score, vid := vid)) AS o FROM g GROUP BY source, rid),
walk AS (SELECT source, 0 AS n, NULL::BIGINT AS rid, NULL::BIGINT AS vid, []::BIGINT[] AS used FROM (SELECT DISTINCT source FROM g)
 UNION ALL SELECT source, n, rid, vid, CASE WHEN vid IS NULL THEN used ELSE list_append(used, vid) END FROM (SELECT *, CASE WHEN len(f)=1 OR f[1].score - f[2].score >= 0.08::DOUBLE THEN f[1].vid END AS vid
  FROM (SELECT w.source, p.n, p.rid, w.used, list_sort(list_filter(p.o, lambda x: NOT list_contains(w.used, x.vid)), 'DESC') AS f FROM walk w JOIN opts p ON p.source=w.source AND p.n=w.n+1))),
taken AS (SELECT rid, vid FROM walk WHERE vid IS NOT NULL)
SELECT rss.source, coalesce(taken.vid, rss.id) AS item_id, round(coalesce(rss.duration, vid.duration),6) AS duration, CASE WHEN taken.vid IS NULL THEN 'feed' ELSE 'merged' END AS origin FROM rss LEFT JOIN taken ON rid=rss.id LEFT JOIN vid ON vid.id=taken.vid
UNION ALL SELECT source, id, round(duration,6), 'video' FROM vid WHERE id NOT IN (SELECT vid FROM taken)""")
def attach_unique_best(t):
    rss, video = syndicated(t)
    pairs = ops.syndication_pairs(rss, video).select("source", "r_item_id", F.col("r_item_id").alias("r_ord"), "v_item_id", F.col("v_item_id").alias("v_ord"), "score")
    return ops.attach_videos(rss, video, ops.attach_unique_best(pairs)).select("source", "item_id", F.round("duration", 6).alias("duration"), "origin")


@job("merge_metadata", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey%2=0 THEN 'f'||o_orderkey WHEN o_orderkey%3=0 THEN 'f'||o_orderkey ELSE 'e'||o_orderkey END AS item_id,
 CASE WHEN o_orderkey%2=0 OR o_orderkey%5=0 OR o_orderkey%3=0 THEN 'found ' || o_orderstatus ELSE 'better' END AS title,
 CASE WHEN o_orderkey%2=0 AND o_orderkey%7<>0 THEN o_totalprice WHEN o_orderkey%3<>0 THEN 60.0::DOUBLE WHEN o_orderkey%7<>0 THEN o_totalprice END AS duration_seconds,
 'S' || (o_custkey%10) AS source_name, CASE WHEN o_orderkey%3<>0 THEN 'new' ELSE 'old' END AS note FROM orders""")
def merge_metadata(t):
    k = F.col("o_orderkey")
    text = lambda s: F.lit(s).cast("string")
    found = t.orders.select(k.alias("row_id"), (k % 2 == 0).alias("from_feed"), F.concat(F.lit("f"), k).alias("item_id"), F.concat(F.lit("found "), "o_orderstatus").alias("title"), text("u").alias("url"), text("s").alias("show"),
                            F.when(k % 7 != 0, F.col("o_totalprice")).alias("duration_seconds"), text(None).alias("duration_string"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
                            F.create_map(F.lit("source_name"), F.concat(F.lit("S"), F.col("o_custkey") % 10), F.lit("note"), F.lit("old")).alias("extra"))
    rich = t.orders.filter(k % 3 != 0).select(k.alias("row_id"), F.concat(F.lit("e"), k).alias("item_id"), F.when(k % 5 != 0, "better").otherwise("").alias("title"), text("eu").alias("url"), text("es").alias("show"),
                                              F.lit(60.0).alias("duration_seconds"), text("1:00").alias("duration_string"), F.lit(None).cast("timestamp").alias("published_at"),
                                              F.create_map(F.lit("source_name"), F.lit("other"), F.lit("note"), F.lit("new")).alias("extra"))
    return ops.merge_metadata(found, rich).select("row_id", "item_id", "title", "duration_seconds", F.col("extra")["source_name"].alias("source_name"), F.col("extra")["note"].alias("note"))


def assets(t):
    """orders -> items (even keys) and catalogue assets (odd keys)."""
    k = F.col("o_orderkey")
    base = dealt(t.orders).select(k.alias("id"), F.concat(F.lit("https://cdn.example.org/a/"), F.floor(k / 10), F.lit("?utm_source=x")).alias("url"), F.concat(F.lit("Talk: "), "o_orderstatus").alias("title"),
                           F.concat(F.lit("Show "), F.col("o_custkey") % 10).alias("show"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_totalprice")
    items = base.filter(F.col("id") % 2 == 0).select(F.col("id").alias("item_id"), "url", F.lit(None).cast("string").alias("audio_url"), "title", "show", F.col("at").alias("published_at"), F.col("o_totalprice").alias("duration"), F.lit(True).alias("from_feed"))
    other = base.filter(F.col("id") % 2 == 1).select(
        F.col("id").alias("asset_id"), F.when(F.floor(F.col("id") / 10) % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://cdn.example.org/b/"), "id")).alias("link"), F.upper("title").alias("asset_title"),
        F.col("show").alias("asset_show"), F.col("at").alias("asset_at"), F.when(F.col("id") % 9 != 0, F.col("o_totalprice")).alias("asset_duration"))
    return items, other


ASSETS = """i AS (SELECT o_orderkey AS item_id, o_orderkey//10 AS u, o_orderstatus AS t, o_custkey%10 AS s, o_orderdate AS d, o_totalprice AS len FROM orders WHERE o_orderkey%2=0),
a AS (SELECT o_orderkey AS asset_id, o_orderkey//10 AS u, o_orderstatus AS t, o_custkey%10 AS s, o_orderdate AS d, CASE WHEN o_orderkey%9<>0 THEN o_totalprice END AS len FROM orders WHERE o_orderkey%2=1)"""


@job("match_assets", f"""WITH {ASSETS} SELECT item_id, asset_id FROM i JOIN a ON i.u=a.u AND a.u%3=0
UNION SELECT item_id, asset_id FROM i JOIN a ON i.t=a.t AND i.s=a.s AND abs(epoch(i.d)-epoch(a.d))<=86400 AND abs(a.len-i.len)<=greatest(30, i.len*0.05::DOUBLE)""")
def match_assets(t):
    return ops.match_assets(*assets(t))


@job("match_cross_version", f"""WITH {ASSETS} SELECT item_id, asset_id FROM i JOIN a ON i.t=a.t AND i.s=a.s AND abs(epoch(i.d)-epoch(a.d))<=3600 AND (a.len IS NULL OR abs(a.len-i.len)<=greatest(30, i.len*0.05::DOUBLE))""")
def match_cross_version(t):
    items, other = assets(t)
    longer = lambda c: F.concat(F.lit("Ep. 12 - one long talk about many things and "), c, F.lit(" | with guests"))
    plain = lambda c: F.concat(F.lit("One long talk about many things and "), c)
    return ops.match_cross_version(items.withColumn("title", longer(F.col("title"))), other.withColumn("asset_title", plain(F.col("asset_title"))).withColumn("asset_show", F.concat(F.lit("The "), "asset_show")))


@job("resolve_unique_asset", f"""WITH {ASSETS}, m AS (SELECT item_id, asset_id, asset_id%4<>3 AS tr, i.u=a.u AND a.u%3=0 AS own FROM i JOIN a ON (i.u=a.u AND a.u%3=0) OR (i.t=a.t AND i.s=a.s AND abs(epoch(i.d)-epoch(a.d))<=86400 AND abs(a.len-i.len)<=greatest(30, i.len*0.05::DOUBLE))),
g AS (SELECT item_id, count(*) FILTER (WHERE tr AND own) AS own, count(*) FILTER (WHERE tr) AS n, min(asset_id) FILTER (WHERE tr AND own) AS oid, min(asset_id) FILTER (WHERE tr) AS aid FROM m GROUP BY 1),
o AS (SELECT *, CASE WHEN own>0 THEN own=1 ELSE n=1 END AS one FROM g)
SELECT item_id, CASE WHEN one THEN coalesce(oid,aid) END AS asset_id, CASE WHEN n=0 THEN 'none' WHEN one THEN 'resolved' ELSE 'ambiguous' END AS state FROM o""")
def resolve_unique_asset(t):
    items, other = assets(t)
    m = ops.asset_pairs(items, other).withColumn("transcribed", F.col("asset_id") % 4 != 3)
    return ops.resolve_unique_asset(m)


RESOLVE = """src AS (SELECT n_nationkey AS source, 'pod' || (n_nationkey//2) AS id, n_nationkey AS f, n_name AS name FROM nation),
it AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey%4=0 THEN 'pod' || (o_custkey%12) END AS id, CASE WHEN o_orderkey%4 IN (1,2) THEN CAST(o_custkey%40 AS INTEGER) END AS f, 'NATION_' || (o_custkey%30) AS name FROM orders),
h AS (SELECT item_id, 1 AS level, source FROM it JOIN src ON it.id=src.id UNION SELECT item_id, 2, source FROM it JOIN src ON it.f=src.f UNION SELECT item_id, 3, source FROM it JOIN src ON it.name=src.name),
p AS (SELECT item_id, level, count(*) AS n, min(source) AS source FROM h GROUP BY 1,2), q AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY level) AS rn FROM p)"""


@job("resolve_source", f"WITH {RESOLVE} SELECT it.item_id, CASE WHEN n=1 THEN source END AS source, level FROM it LEFT JOIN (SELECT * FROM q WHERE rn=1) q USING (item_id)")
def resolve_source(t):
    s = t.nation.select(F.col("n_nationkey").alias("source"), F.array(F.concat(F.lit("pod"), F.floor(F.col("n_nationkey") / 2))).alias("ids"),
                        F.array(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://feeds.example.org/"), "n_nationkey", F.lit("/?utm_source=a"))).otherwise(
                            F.concat(F.lit("https://api.substack.com/feed/podcast/"), "n_nationkey", F.lit(".rss")))).alias("feeds"), F.array("n_name").alias("names"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    none = F.array().cast("array<string>")
    wants = (k % 4 == 1) | (k % 4 == 2)
    items = t.orders.select(
        k.alias("item_id"), F.when(k % 4 == 0, F.array(F.concat(F.lit(" pod"), c % 12))).otherwise(none).alias("ids"),
        F.when(wants & (c % 40 % 2 == 0), F.array(F.concat(F.lit("http://feeds.example.org:80/"), c % 40))).otherwise(none).alias("feeds"),
        F.when(wants & (c % 40 % 2 == 1), F.concat(F.lit("https://api.substack.com/feed/podcast/"), c % 40, F.lit("/abc.mp3"))).otherwise("https://example.org/x").alias("url"),
        F.array(F.concat(F.lit("The  Nation-"), c % 30)).alias("names"))
    return ops.resolve_source(items, s)


@job("source_key_collisions", r"""WITH k AS (SELECT DISTINCT c_custkey AS source, regexp_replace(lower(c_mktsegment) || ' ' || (c_custkey % 97), '^the ', '') AS key FROM customer)
SELECT key, count(*) AS sources, min(source) AS first_source, max(source) AS last_source FROM k GROUP BY 1 HAVING count(*) > 1""")
def source_key_collisions(t):
    n = F.col("c_custkey")
    name = F.concat(F.when(n % 2 == 0, "The ").otherwise(""), F.when(n % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.when(n % 5 == 0, "–").otherwise("  "), n % 97)
    return ops.source_key_collisions(t.customer.select(n.alias("source"), name.alias("name")))


@job("already_tracked", f"WITH {_SPLIT}, k AS (SELECT page_id, {URL_KEY} AS key FROM p) SELECT page_id FROM k WHERE page_id%3<>0 AND key<>'' AND key IN (SELECT key FROM k WHERE page_id%3=0 AND key<>'') UNION ALL SELECT page_id+100000 FROM k WHERE page_id%3=0 AND key<>''")
def already_tracked(t):
    tracked = t.pages.filter("page_id % 3 = 0").select("url")
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=mail"))
    new = t.pages.filter("page_id % 3 <> 0").select("page_id", "url").union(t.pages.filter("page_id % 3 = 0").select(F.col("page_id") + 100000, again))
    return ops.already_tracked(new, tracked).select("page_id")


@job("history_aliases", f"""WITH {b.ITEMS} SELECT i.item_id, e.item_id AS alias_id FROM items i JOIN items e ON i.title=e.title AND i.source=e.source AND i.published_at=e.published_at WHERE i.item_id%2=0 AND e.item_id%2=1 AND e.item_id%5<>1""")
def history_aliases(t):
    i = b.items(t).select("item_id", "title", F.col("source").alias("show"), "published_at")
    return ops.history_aliases(i.filter("item_id % 2 = 0"), i.filter("item_id % 2 = 1").withColumn("result", F.when(F.col("item_id") % 5 == 1, "discovery_filtered").otherwise("sent")))


IDENT = """ik AS (SELECT item_id, ordinal, score, 'id:'||item_id AS key FROM sc UNION ALL SELECT item_id, ordinal, score, 'cd:'||custkey||':'||CAST(day AS VARCHAR) FROM sc)"""
SC = """sc AS (SELECT *, CASE WHEN custkey%6=0 THEN 40 ELSE 0 END + CASE WHEN custkey%5=0 THEN 30 ELSE 0 END + CASE WHEN custkey%4=0 THEN 20 ELSE 0 END + 2 + CASE WHEN item_id%13<>0 THEN 1 ELSE 0 END - CASE WHEN item_id%9=0 THEN 100 ELSE 0 END AS score,
 'release with a long name ' || (custkey%40) AS long_title FROM items)"""


def identified(t):
    i = dealt(scored_copies(t)).withColumn("is_discovery", F.col("item_id") % 9 == 0)
    i = representation_score(i).drop("title", "published_at").withColumn("title", F.concat(F.lit("Release with a LONG name: "), F.col("custkey") % 40)).withColumn("published_at", F.col("day").cast("timestamp"))
    i = i.select("*", F.concat(F.lit("the Show "), "tier").alias("show"), F.lit("").alias("feed_url"),
                 F.array(F.when(F.col("custkey") % 3 == 0, F.concat(F.lit("https://cdn.example.org/"), F.col("custkey"), F.lit("/"), F.col("day")))).alias("urls"))
    return ops.identity_keys(i)


IDENT_SQL = f"""{b.ITEMS}, {SC}, ik AS (SELECT item_id, ordinal, score, 'id:'||item_id AS key FROM sc
 UNION ALL SELECT item_id, ordinal, score, 'url:'||custkey||'/'||CAST(day AS VARCHAR) FROM sc WHERE custkey%3=0
 UNION ALL SELECT item_id, ordinal, score, 'td:'||long_title||CAST(day AS VARCHAR) FROM sc WHERE item_id%9<>0
 UNION ALL SELECT item_id, ordinal, score, 'std:'||tier||long_title||CAST(day AS VARCHAR) FROM sc)"""


@job("identity_representative", f"""WITH {IDENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ordinal) AS rn FROM ik) SELECT item_id FROM r GROUP BY 1 HAVING bool_and(rn=1)""")
def identity_representative(t):
    return ops.identity_representative(identified(t))


@job("identity_pages", """WITH tt AS (SELECT page_id, url, coalesce(array_to_string(regexp_extract_all(translate(replace(lower(regexp_extract(html,'<title>([^<]*)</title>',1)),'ß','ss'),'ς','σ'),'[a-z0-9]+'),' '),'') AS a,
 coalesce(array_to_string(regexp_extract_all(translate(replace(lower(regexp_extract(html,'<title>([^<]*)</title>',1)),'ß','ss'),'ς','σ'),'[\\p{L}\\p{N}_]+'),' '),'') AS w, length(html) AS score FROM pages),
k AS (SELECT page_id, score, 'u'||trim(url) AS key FROM tt UNION ALL SELECT page_id, score, 'a'||a FROM tt WHERE length(a)>=12 UNION ALL SELECT page_id, score, 's'||w FROM tt WHERE length(w)>=8), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, page_id) AS rn FROM k)
SELECT page_id AS item_id FROM r GROUP BY 1 HAVING bool_and(rn=1)""")
def identity_pages(t):
    p = t.pages.select(F.col("page_id").alias("item_id"), F.col("page_id").alias("ordinal"), F.array("url").alias("urls"), F.lit("").alias("feed_url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                       F.lit("Web").alias("show"), b.ts(b.NOW).alias("published_at"), F.lit(False).alias("is_discovery"), F.length("html").alias("score"))
    return ops.identity_representative(ops.identity_keys(p))


@job("drop_reviewed", f"""WITH {IDENT_SQL}, st AS (SELECT item_id, item_id%3=0 AS known, CASE WHEN item_id%3<>0 THEN 'new' WHEN item_id%12=0 THEN 'retry' END AS state FROM sc),
k AS (SELECT key, bool_or(known AND state IS NULL) AS blocked, bool_or(coalesce(state='retry',FALSE)) AS retry FROM ik JOIN st USING (item_id) GROUP BY 1),
i AS (SELECT item_id, bool_or(blocked) AS blocked, bool_or(retry) AS retry FROM ik JOIN k USING (key) GROUP BY 1) SELECT item_id, CASE WHEN retry THEN 'retry' ELSE 'new' END AS state FROM i WHERE NOT blocked""")
def drop_reviewed(t):
    i = cut_lineage(identified(t).select("item_id", "ids"))  # items and history are one table here
    known = F.col("item_id") % 3 == 0
    states = i.select(F.explode("ids").alias("key"), known.alias("known"), F.when(~known, "new").when(F.col("item_id") % 12 == 0, "retry").alias("state"))
    return ops.drop_reviewed(i, states)


def publisher_pages(t):
    """pages -> releases with page titles, and a site map of links made from changed titles."""
    title = F.replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("%"), F.lit(""))
    pub = F.regexp_extract("url", r"https?://(?:[^/]*\.)?([a-z]+)\.example", 1)
    p = t.pages.select(pub.alias("publisher"), F.col("page_id").alias("item_id"), title.alias("title"), F.concat(F.lit("https://example.org/"), "page_id").alias("url"))
    words = F.split("title", " ")
    slug = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - F.col("item_id").cast("int") % 3, F.lit(1))), "-")
    return p.select("publisher", "item_id", "title"), p.select("publisher", "url", "item_id", F.replace(slug, F.lit("-"), F.lit(" ")).alias("slug"))


def _pieces(a: str, b: str) -> str:
    """For each place of a the longest piece from there that b holds too."""
    return f"list_transform(range(1, length({a})+1), lambda i: list_max(list_prepend(0, list_filter(range(1, length({a})-i+2), lambda k: contains({b}, substr({a},CAST(i AS BIGINT),CAST(k AS BIGINT)))))))"


def _noise_free(c: str) -> str:
    return rf"coalesce(array_to_string(list_filter(regexp_extract_all(lower(strip_accents({c})),'[a-z0-9]+'), lambda w: NOT list_contains([{_NOISE}],w) AND NOT regexp_full_match(w,'\d+')),' '),'')"


def _page_score(rule: str) -> str:
    r = page_titles.PAGE_RULES[rule]
    base = "least(len(tw), len(sw))" if r["by"] == "min" else "len(sw)"
    return f"CAST(2*m AS DOUBLE)/(length(t)+length(s))*{r['ratio']}::DOUBLE + CAST(len(list_intersect(tw,sw)) AS DOUBLE)/{base}*(1-{r['ratio']}::DOUBLE)"


def _matched(rule: str) -> str:
    r = page_titles.PAGE_RULES[rule]
    return f"""SELECT publisher, item_id, url, round(score,6) AS score, '{rule}' AS rule FROM (SELECT *, lead(score) OVER w AS runner_up, row_number() OVER w AS rn FROM scored WHERE rule='{rule}' WINDOW w AS (PARTITION BY publisher, item_id ORDER BY score DESC, url DESC))
 WHERE rn=1 AND score >= {r['floor']}::DOUBLE AND (runner_up IS NULL OR score >= {r['sure']}::DOUBLE OR score - runner_up >= {r['margin']}::DOUBLE)"""


_BY_TITLE = ("sitemap_min", "sitemap_slug", "feed_titles")
#: All pairs of titles of a publisher, matched by the longest common piece, then again left and right of it.
PAGE_SQL = rf"""WITH RECURSIVE p AS (SELECT page_id, replace(regexp_extract(html,'<title>([^<]*)</title>',1),'%','') AS title, regexp_extract(url,'https?://(?:[^/]*\.)?([a-z]+)\.example',1) AS publisher FROM pages),
q AS (SELECT *, replace(array_to_string(string_split(title,' ')[1:greatest(len(string_split(title,' '))-page_id%3,1)],'-'),'-',' ') AS slug FROM p),
n AS (SELECT *, {_noise_free('title')} AS t, {_noise_free('slug')} AS s, coalesce(array_to_string(regexp_extract_all(lower(slug),'[a-z0-9]+'),'-'),'') AS name, 'https://example.org/'||page_id AS url FROM q),
linked AS (SELECT a.publisher, a.page_id AS item_id, 'https://example.org/p/'||b.name AS url, a.t, {_noise_free("replace(b.name,'-',' ')")} AS s FROM n a JOIN n b ON b.page_id IN (a.page_id, a.page_id+1) WHERE b.name<>''),
pairs AS (SELECT i.publisher, i.page_id AS item_id, u.page_id AS page, u.url, i.t, u.s, FALSE AS linked FROM n i JOIN n u USING (publisher) WHERE i.t<>'' AND u.s<>''
 UNION ALL SELECT publisher, item_id, NULL, url, t, s, TRUE FROM linked WHERE t<>'' AND s<>''),
seg AS (SELECT t, s, t AS a, s AS b, {_pieces('t','s')} AS l FROM (SELECT DISTINCT t, s FROM pairs)
 UNION ALL SELECT t, s, c.a, c.b, {_pieces('c.a','c.b')} FROM (SELECT t, s, unnest([{{'a': substr(a,1,i-1), 'b': substr(b,1,j-1)}}, {{'a': substr(a,i+k), 'b': substr(b,j+k)}}]) AS c
  FROM (SELECT *, CAST(instr(b, substr(a,i,k)) AS BIGINT) AS j FROM (SELECT t, s, a, b, CAST(list_max(l) AS BIGINT) AS k, CAST(list_position(l, list_max(l)) AS BIGINT) AS i FROM seg WHERE list_max(l)>0))) WHERE c.a<>'' AND c.b<>''),
common AS (SELECT t, s, sum(list_max(l)) AS m FROM seg GROUP BY 1,2),
rated AS (SELECT *, list_distinct(string_split(t,' ')) AS tw, list_distinct(string_split(s,' ')) AS sw FROM pairs JOIN common USING (t,s)),
scored AS ({" UNION ALL ".join(f"SELECT publisher, item_id, page, url, {_page_score(r)} AS score, '{r}' AS rule FROM rated WHERE NOT linked" for r in (*_BY_TITLE, "video_pages"))}
 UNION ALL SELECT publisher, item_id, page, url, {_page_score("description_links")}, 'description_links' FROM rated WHERE linked
 UNION ALL SELECT publisher, item_id, NULL, url, 0, 'description_links' FROM linked WHERE t='' OR s='')
{" UNION ALL ".join(_matched(r) for r in (*_BY_TITLE, "description_links"))}
UNION ALL SELECT publisher, item_id, arg_min(url, rn), NULL, 'video_pages' FROM (SELECT *, row_number() OVER (PARTITION BY publisher, item_id ORDER BY score DESC, url DESC) AS rn FROM scored WHERE rule='video_pages') WHERE rn<=12 AND item_id%50 = page%50 GROUP BY 1,2"""


@job("match_page_titles", PAGE_SQL)
def match_page_titles(t):
    items, urls = publisher_pages(t)
    found = [page_titles.match_page_titles(page_titles.best_pages(items, urls, r), r).withColumn("rule", F.lit(r)) for r in _BY_TITLE]
    name = F.array_join(F.regexp_extract_all(F.lower("slug"), F.lit("([a-z0-9]+)"), F.lit(1)), "-")
    links = urls.select("item_id", F.when(name != "", F.concat(F.lit("https://example.org/p/"), name)).otherwise("no page").alias("link"))
    after = links.select((F.col("item_id") - 1).alias("item_id"), F.col("link").alias("next"))
    told = items.join(links, "item_id").join(after, "item_id", "left").withColumn("description", F.concat_ws(" ", F.lit("Read"), "link", F.lit("or"), "next"))
    linked = page_titles.match_page_titles(page_titles.description_links(told, r"^https://example\.org/p/([^/?#]+)$"), "description_links")
    found.append(linked.withColumn("rule", F.lit("description_links")))
    videos = items.withColumn("video_id", F.col("item_id") % 50)
    seen = page_titles.match_page_video(page_titles.best_pages(items, urls, "video_pages", top=12), videos, urls.select("url", (F.col("item_id") % 50).alias("video_id")))
    found.append(seen.select("publisher", "item_id", "url", F.lit(None).cast("double").alias("score"), F.lit("video_pages").alias("rule")))
    return reduce(DataFrame.unionByName, found)
