"""Landed feeds, captions, segment payloads, catalogues and chat history, parsed with Spark's own XML and JSON readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.functions.arrow import unescaped
from galleyspark.functions.cutting import merged_captions
from galleyspark.functions.text import stripped
from galleyspark.operators.columns import short_form
from galleyspark.operators.evidence import collapse

_ITEM = """struct<title string, link string, guid struct<_VALUE string, _isPermaLink string>, pubDate string, description string, `content:encoded` string, `itunes:summary` string,
 `itunes:duration` string, enclosure array<struct<_url string, _type string, _length string>>, `podcast:transcript` array<struct<_url string, _type string, _language string>>>"""
RSS = f"channel struct<title string, item array<{_ITEM}>>"
ATOM = """title string, entry array<struct<`yt:videoId` string, title string, published string, link array<struct<_href string, _rel string>>,
 `media:group` struct<`media:description` string, `media:content` struct<_duration string, _url string>>>>, _corrupt_record string"""


#: The prefix of each namespace here, and what its address holds.
NAMESPACES = {"itunes": r"[^\"']*itunes\.com/dtds/podcast-1\.0\.dtd", "podcast": r"[^\"']*podcastindex[^\"']*", "content": r"[^\"']*purl\.org/rss/1\.0/modules/content/?",
              "yt": r"[^\"']*youtube\.com/xml/schemas/2015", "media": r"[^\"']*search\.yahoo\.com/mrss/?"}


def made_once(df: DataFrame) -> DataFrame:
    """``df``, with its columns made before what follows. A filter behind it is not pushed down, where it would repeat their expressions, and no source column goes along."""
    return df.select(F.inline(F.array(F.struct("*"))))


def with_known_prefixes(xml: Column) -> Column:
    """Feeds choose their prefixes; names are rewritten to the ones read here where a namespace is declared under another.

    Declarations are read from the document as it came, so that only documents that need it are rewritten.
    """
    told = F.array_join(F.regexp_extract_all(xml, F.lit(r"xmlns:[\w.-]+\s*=\s*[\"'][^\"']*[\"']"), F.lit(0)), " ")  # a document is searched once
    declared = {known: F.regexp_extract(told, rf"xmlns:([\w.-]+)\s*=\s*[\"']{address}[\"']", 1) for known, address in NAMESPACES.items()}
    other = {known: (own != "") & (own != known) for known, own in declared.items()}
    rewritten = xml
    for known, own in declared.items():
        pattern = F.when(other[known], F.concat(F.lit("<(/?)\\Q"), own, F.lit("\\E:"))).otherwise(r"\A(?!)")  # the latter fails at the first character
        rewritten = F.regexp_replace(rewritten, pattern, F.lit(f"<$1{known}:"))
    return F.when(reduce(lambda x, y: x | y, other.values()), rewritten).otherwise(xml)


def plain_text(markup: Column) -> Column:
    """Texts between tags, trimmed and joined by blanks."""
    parts = F.split(unescaped(F.array_join(F.split(unescaped(markup), "<[^>]*>"), "\u0001")), "\u0001")
    return F.array_join(F.filter(F.transform(parts, stripped), lambda s: s != ""), " ")


def parse_feed_items(raw: DataFrame, limit: int = 0) -> DataFrame:
    """Items of RSS documents in feed order. raw: feed_url, show, xml. Items without title are left out; ids are stable hashes.

    A document that does not parse, or is no feed, is one row with ``error`` and nulls."""
    feed = raw.select("feed_url", "show", F.from_xml(with_known_prefixes(F.col("xml")), RSS).alias("x"))
    entries = made_once(feed.select("feed_url", "show", F.when(F.col("x.channel").isNull(), "unreadable").alias("error"), F.col("x.channel.item").alias("entries")))
    items = entries.select("feed_url", "show", "error", F.posexplode_outer("entries").alias("pos", "i")).filter("error is not null or i is not null")
    if limit:
        items = items.filter((F.col("pos") < limit) | F.col("error").isNotNull())
    trim = lambda c: F.coalesce(F.trim(c), F.lit(""))
    guid = trim(F.col("i.guid._VALUE"))
    link = F.coalesce(keys.safe_public_url(trim(F.col("i.link"))), keys.safe_public_url(guid))
    texts = F.array(trim(F.col("i.description")), trim(F.col("i.`content:encoded`")), trim(F.col("i.`itunes:summary`")))
    longest = F.array_max(F.transform(texts, lambda t, k: F.struct(F.length(t).alias("n"), (-k).alias("k"), t.alias("t"))))["t"]
    links = F.filter(F.transform("i.enclosure", lambda e: keys.safe_public_url(e["_url"])), lambda u: u.isNotNull())
    scripts = F.filter(F.transform(F.coalesce("i.`podcast:transcript`", F.array().cast("array<struct<_url string,_type string,_language string>>")), lambda s: F.struct(
        keys.safe_public_url(s["_url"]).alias("url"), F.coalesce(s["_type"], F.lit("text/plain")).alias("type"), F.coalesce(s["_language"], F.lit("")).alias("language"))), lambda s: s["url"].isNotNull())
    j = items.select("feed_url", "show", "error", "pos", trim(F.col("i.title")).alias("title"), guid.alias("guid"), link.alias("link"), keys.published_utc(trim(F.col("i.pubDate"))).alias("published_at"),
                     trim(F.col("i.`itunes:duration`")).alias("duration_string"), longest.alias("markup"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("audio_url"), scripts.alias("transcripts"))
    undated = F.concat(F.col("title"), F.lit("|"), F.coalesce(F.concat(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), F.lit("")))
    ident = F.when(F.col("guid") != "", F.col("guid")).otherwise(F.coalesce("link", undated))
    sound = lambda c: F.when(F.col("error").isNull(), c)
    return j.filter("title <> '' or error is not null").select(
        sound(F.concat(F.lit("rss:"), F.substring(F.sha2(F.concat("feed_url", F.lit("|"), ident), 256), 1, 32))).alias("item_id"), "feed_url", "show", "pos", sound(F.col("title")).alias("title"),
        F.coalesce("link", keys.safe_public_url("feed_url"), "feed_url").alias("url"), "published_at", keys.duration_seconds("duration_string").alias("duration"), sound(F.col("guid")).alias("guid"),
        sound(F.col("audio_url")).alias("audio_url"), sound(plain_text(F.col("markup"))).alias("description"), sound(F.col("transcripts")).alias("transcripts"), "error")


def unprefixed_atom(xml: Column) -> Column:
    """Atom names of a document whose root has a prefix, without it."""
    own = F.regexp_extract(xml, r"<([\w.-]+):feed[\s>]", 1)
    bound = (own != "") & F.contains(xml, F.concat(F.lit("xmlns:"), own, F.lit("=")))
    return F.when(bound, F.regexp_replace(xml, F.concat(F.lit("(</?)"), own, F.lit(":")), F.lit("$1"))).otherwise(xml)


def parse_atom_items(raw: DataFrame, limit: int = 0) -> DataFrame:
    """Video entries of Atom documents, clips left out. raw: feed_url, show, xml.

    A document that does not parse, or is no Atom feed, is one row with ``error`` and nulls."""
    plain = raw.select("feed_url", "show", unprefixed_atom(F.col("xml")).alias("xml")).select("feed_url", "show", with_known_prefixes(F.col("xml")).alias("xml"))
    feed = plain.select("feed_url", "show", F.coalesce(F.rlike("xml", F.lit(r"<feed[\s>]")), F.lit(False)).alias("is_feed"), F.from_xml("xml", ATOM).alias("x"))
    bad = ~F.col("is_feed") | F.col("x").isNull() | F.col("x._corrupt_record").isNotNull()
    entries = made_once(feed.select("feed_url", "show", F.when(bad, "unreadable").alias("error"), F.when(~bad, F.col("x.entry")).alias("entries")))
    e = entries.select("feed_url", "show", "error", F.posexplode_outer("entries").alias("pos", "e")).filter("error is not null or e is not null")
    if limit:
        e = e.filter((F.col("pos") < limit) | F.col("error").isNotNull())
    vid = F.trim(F.col("e.`yt:videoId`"))
    alternates = F.filter("e.link", lambda n: F.coalesce(n["_rel"], F.lit("alternate")) == "alternate")
    j = e.select("feed_url", "show", "error", "pos", vid.alias("item_id"), F.trim("e.title").alias("title"), keys.safe_public_url(F.get(alternates, F.lit(0))["_href"]).alias("link"),
                 keys.published_utc("e.published").alias("published_at"), keys.duration_seconds(F.col("e.`media:group`.`media:content`._duration")).alias("duration"), F.col("e.`media:group`.`media:description`").alias("description"))
    j = j.filter(F.col("error").isNotNull() | (F.rlike("item_id", F.lit(keys.VIDEO_ID)) & (F.col("title") != "")))
    own = F.concat(F.lit("https://www.youtube.com/watch?v="), "item_id")
    j = j.withColumn("url", F.when(F.col("error").isNotNull(), F.coalesce(keys.safe_public_url("feed_url"), "feed_url")).when(keys.video_id("link") == F.col("item_id"), F.col("link")).otherwise(own))
    j = made_once(j)
    clip = short_form(F.col("url"), F.col("title"), F.col("description"), F.col("duration"))
    return j.filter(F.col("error").isNotNull() | ~clip).drop("link")


VTT_CUE = r"(?m)^((?:\d{2}:)?\d{2}:\d{2}\.\d{3})\s+-->\s+((?:\d{2}:)?\d{2}:\d{2}\.\d{3})[^\n]*+((?:\n(?=[^\n]*\S)(?![^\n]*-->)[^\n]*+)*+)"
CAPTION_JSON = "struct<events array<struct<tStartMs double, dDurationMs double, segs array<struct<utf8 string>>>>>"


def _clipped(start: Column, end: Column) -> tuple[Column, Column]:
    return F.greatest(start, F.lit(0.0)), F.least(end, F.col("duration"))


def parse_caption_cues(raw: DataFrame) -> DataFrame:
    """Timed intervals of caption files (VTT or JSON), clipped to the duration. raw: item_id, format, body, duration."""
    # A file is searched once; the parts of a cue are then cut from the cue alone.
    cues = raw.filter("format = 'vtt'").select("item_id", "duration", F.posexplode(F.regexp_extract_all("body", F.lit(VTT_CUE), F.lit(0))).alias("pos", "cue"))
    vtt = cues.select("item_id", "duration", "pos", F.regexp_extract("cue", r"\A[\d:.]+", 0).alias("a"), F.regexp_extract("cue", r"\A\S+\s+-->\s+([\d:]+\.\d{3})", 1).alias("b"),
                      F.regexp_replace("cue", r"\A\S+\s+-->\s+[^\n]*+", "").alias("t"))
    s, e = _clipped(keys.duration_seconds("a"), keys.duration_seconds("b"))
    first = vtt.select("item_id", "pos", F.coalesce(s, F.lit(0.0)).alias("start"), F.coalesce(e, F.lit(0.0)).alias("end"), collapse(unescaped(F.regexp_replace("t", "<[^>]+>", ""))).alias("text"))
    js = raw.filter("format = 'json'").select("item_id", "duration", F.posexplode(F.from_json("body", CAPTION_JSON)["events"]).alias("pos", "v"))
    text = stripped(F.replace(unescaped(F.array_join(F.transform("v.segs", lambda g: F.coalesce(g["utf8"], F.lit(""))), "")), F.lit("\n"), F.lit(" ")))
    s, e = _clipped(F.col("v.tStartMs") / 1000, F.greatest(F.col("v.tStartMs") / 1000, F.lit(0.0)) + F.coalesce("v.dDurationMs", F.lit(0.0)) / 1000)
    return first.unionByName(js.filter(F.col("v.tStartMs").isNotNull()).select("item_id", "pos", s.alias("start"), e.alias("end"), text.alias("text")).filter("text <> ''"))


def caption_text(raw: DataFrame) -> DataFrame:
    """Running text of VTT files without headers, timings, tags and repeated words. raw: item_id, body."""
    keep = lambda x: (F.trim(x) != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"\A(?:WEBVTT|Kind:|Language:)")
    shown = unescaped(F.regexp_replace(F.array_join(F.filter(F.split("body", "\n"), keep), "\n"), "<[^>\n]+>", ""))
    lines = F.filter(F.transform(F.split(shown, "\n"), stripped), lambda x: x != "")
    return raw.select("item_id", merged_captions(lines).alias("text"))


def parse_segment_payloads(raw: DataFrame) -> DataFrame:
    """Publisher segments with speaker names. raw: item_id, body (JSON array), speakers (map id -> name)."""
    rows = raw.select("item_id", "speakers", F.posexplode(F.from_json("body", "array<struct<start double, end double, speaker string, text string>>")).alias("pos", "s"))
    text = collapse("s.text")
    return rows.select("item_id", "pos", "s.start", "s.end", F.coalesce(F.trim(F.try_element_at("speakers", F.col("s.speaker"))), F.lit("")).alias("speaker"), text.alias("text")).filter(
        F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("text") != "") & (F.col("end") > F.col("start")))


SOURCE = """array<struct<name string, type string, priority string, url string, rss_url string, aliases array<string>, include_keywords array<string>, catalog_ids array<string>, scan_depth string, enabled boolean>>"""


def normalise_sources(rows: DataFrame, text_sources: bool = False) -> DataFrame:
    """One row per enabled source with clean fields. rows: the raw fields of a catalogue entry."""
    trims = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    depth = F.coalesce(F.col("scan_depth").try_cast("int"), F.lit(4))
    pr = F.upper(F.trim(F.coalesce("priority", F.lit("B"))))
    linked = (F.coalesce("url", F.lit("")) != "") | (F.coalesce("rss_url", F.lit("")) != "")
    wanted = (F.col("type").isin("youtube", "rss") & linked) | (F.lit(text_sources) & (F.col("type") == "text"))
    e = F.lit("")
    return rows.filter(F.coalesce("enabled", F.lit(True)) & wanted).select(
        F.coalesce("name", e).alias("name"), "type", F.when(pr.isin("A", "B"), pr).otherwise("B").alias("priority"), F.coalesce("url", e).alias("url"), F.coalesce("rss_url", e).alias("rss_url"),
        trims("aliases").alias("aliases"), trims("include_keywords").alias("include_keywords"), trims("catalog_ids").alias("catalog_ids"), F.least(F.lit(50), F.greatest(F.lit(1), depth)).alias("scan_depth"))


def load_sources(spark: SparkSession, path: str, text_sources: bool = False) -> DataFrame:
    """Source catalogue file -> table."""
    return normalise_sources(spark.read.schema(f"sources {SOURCE}").json(path, multiLine=True).select(F.inline("sources")), text_sources)


DISCOVERY = """seq variant, podcastId string, catalogName string, catalogFeedUrls array<string>, rssUrl string, rssFeedUrl string, feedUrl string, rss string, linkType string, publishTime string, title string, podcastName string, link string, duration double, podcastSeq bigint"""


def discovery_rows_to_items(rows: DataFrame, now: Column, hours: int) -> DataFrame:
    """Validated discovery rows with a verdict: ok, invalid or outside the window. rows: row_id, body (JSON). The times are epoch seconds; ``seq`` must be a
    JSON integer, numbers in quotes are invalid."""
    r = rows.select("row_id", F.from_json("body", DISCOVERY).alias("r")).select("row_id", "r.*")
    seq = F.when(F.schema_of_variant("seq") == "BIGINT", F.try_variant_get("seq", "$", "bigint"))
    when = F.timestamp_seconds(F.when(F.rlike("publishTime", F.lit(r"\A-?\d+(\.\d+)?\z")), F.col("publishTime").cast("double")))
    private = F.rlike(F.lower(F.coalesce("linkType", F.lit(""))), F.lit("upload|private"))
    blank = lambda c: F.coalesce(stripped(F.col(c)), F.lit("")) == ""
    feeds = F.array("rssUrl", "rssFeedUrl", "feedUrl", "rss")
    verdict = (F.when(seq.isNull() | (seq <= 0) | private | when.isNull(), "invalid").when(~when.between(now - F.make_dt_interval(F.lit(0), F.lit(hours)), now), "outside")
               .when(blank("title") | blank("podcastName") | blank("link") | keys.safe_public_url("link").isNull(), "invalid").otherwise("ok"))
    return r.select("row_id", seq.alias("seq"), F.concat(F.lit("podwise:"), seq).alias("item_id"), "podcastId", "podcastSeq", F.col("catalogName").alias("catalog_name"),
                    F.concat(F.coalesce("catalogFeedUrls", F.array().cast("array<string>")), F.array_compact(feeds)).alias("feed_urls"),
                    F.coalesce(F.get(F.filter(feeds, lambda x: x != ""), F.lit(0)), F.lit("")).alias("feed_url"), F.substring("title", 1, 1000).alias("title"), F.substring("podcastName", 1, 300).alias("show"), "link", when.alias("published_at"),
                    F.when(F.col("duration") > 0, F.col("duration")).alias("duration"), verdict.alias("verdict"))


MESSAGE = """struct<message_id string, deleted boolean, msg_type string, create_time string, update_time string, thread_id string, parent_id string, root_id string,
 sender struct<sender_type string, id_type string, id string>, mentions array<struct<key string, id variant>>, body struct<content string>>"""
_POST = "title string, text string, content array<array<struct<tag string, text string, href string>>>"
POST = f"{_POST}, zh_cn struct<{_POST.replace('title string', 'title: string')}>, en_us struct<{_POST.replace('title string', 'title: string')}>"


def mentions_from_history(messages: DataFrame, bot: str, start: Column, end: Column) -> DataFrame:
    """User messages of the window that mention the bot, first row per message. messages: chat, seq, raw (JSON)."""
    m = messages.select("chat", "seq", F.from_json("raw", MESSAGE).alias("m")).select("chat", "seq", "m.*")
    at = lambda c: F.timestamp_millis(F.col(c).try_cast("long"))
    inside = F.coalesce(at("create_time").between(start, end), F.lit(False)) | F.coalesce(at("update_time").between(start, end), F.lit(False))
    ours = F.filter("mentions", lambda x: F.coalesce(F.try_variant_get(x["id"], "$.open_id", "string"), F.try_variant_get(x["id"], "$", "string")) == bot)
    m = m.filter(~F.coalesce("deleted", F.lit(False)) & (F.col("sender.sender_type") == "user") & (F.col("sender.id_type") == "open_id") & inside & (F.size(ours) > 0)).withColumn("ours", ours)
    c = F.from_json("body.content", POST)
    local = F.coalesce(c["zh_cn"], c["en_us"])
    rows = F.transform(F.when(local.isNotNull(), local["content"]).otherwise(c["content"]), lambda row: F.array_join(F.transform(F.filter(row, lambda e: e["tag"].isin("text", "a")), lambda e: F.coalesce(F.nullif(e["text"], F.lit("")), e["href"], F.lit(""))), ""))
    text = F.when(F.col("msg_type") == "text", c["text"]).when(F.col("msg_type") == "post", F.concat_ws("\n", F.coalesce(F.when(local.isNotNull(), local["title"]).otherwise(c["title"]), F.lit("")), rows))
    without = F.aggregate("ours", text, lambda t, x: F.replace(t, F.coalesce(x["key"], F.lit("\u0000")), F.lit("")))
    m = m.select("chat", "seq", "message_id", F.col("sender.id").alias("sender"), "create_time", F.substring(stripped(without), 1, 10000).alias("text"),
                 F.coalesce(F.nullif("parent_id", F.lit("")), "root_id", F.lit("")).alias("parent"))
    m = m.filter((F.col("text") != "") & F.col("message_id").startswith("om_") & (F.coalesce("sender", F.lit("")) != ""))
    order = F.struct(F.coalesce(F.col("create_time").try_cast("long"), F.lit(0)).alias("t"), "seq")
    return m.groupBy("message_id").agg(F.min_by(F.struct("chat", "sender", "text", "parent"), order).alias("v")).select("message_id", "v.*")
