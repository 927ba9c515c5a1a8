"""Filters and column jobs over whole tables (no shuffle unless stated)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.functions.text import EDGE_BLANKS, casefold
from galleyspark.operators.editorial import ADVICE


def accept_by_keywords(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop short-form items; where a source has keywords keep titles with one as a whole word. sources: source, keywords."""
    title = casefold("title")
    word = lambda k: F.rlike(title, F.concat(F.lit(r"(?<![a-z0-9])\Q"), casefold(k), F.lit(r"\E(?![a-z0-9])")))
    j = drop_short_form(items).join(sources.select("source", "keywords"), "source", "left")
    return j.filter((F.coalesce(F.size("keywords"), F.lit(0)) <= 0) | F.exists("keywords", word)).drop("keywords")


def short_form(url: Column, title: Column, description: Column, duration: Column, minimum: float = 900.0) -> Column:
    tagged = F.rlike(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))), F.lit(r"(?i)#shorts\b"))
    return keys.is_video_url(url) & (F.contains(url, F.lit("/shorts/")) | tagged | F.coalesce(duration < minimum, F.lit(False)))


def drop_short_form(items: DataFrame) -> DataFrame:
    """Without clips: short paths, tags, or video under 15 minutes. items: url, title, description, duration."""
    return items.filter(~short_form(F.col("url"), F.col("title"), F.col("description"), F.col("duration")))


def in_lookback(items: DataFrame, now: Column, hours: int) -> DataFrame:
    """Inside the window, undated, or promoted. Null is not old: undated items are dealt with later."""
    p = F.col("published_at")
    inside = p.between(now - F.make_dt_interval(F.lit(0), F.lit(hours)), now)
    return items.filter(p.isNull() | inside | (F.coalesce("promoted", F.lit(False)) & (p <= now)))


def content_hashes(transcripts: DataFrame) -> DataFrame:
    """Text hash, short reference and the hash of the whole record in canonical JSON (sorted keys, nulls kept).

    transcripts: item_id, title, url, show, duration_seconds, duration_string, published_at (text), text, source, source_url, language.
    """
    item = F.struct("duration_seconds", "duration_string", F.col("item_id").cast("string").alias("id"), "published_at", "show", "title", "url")
    body = F.sha2("text", 256)
    record = F.to_json(F.struct(item.alias("episode"), F.struct(body.alias("content_sha256"), "language", "source", "source_url").alias("transcript")),
                       {"ignoreNullFields": "false"})
    return transcripts.select("item_id", body.alias("content_sha256"), F.substring(F.sha2(F.col("item_id").cast("string"), 256), 1, 8).alias("reference"),
                              F.sha2(record, 256).alias("revision"))


# The shape of a chapter cue in a description.
CUE = r"(?:^|\n|\()(\d{1,2}:\d{2}(?::\d{2})?)\)?\s+"


def chapter_markers(items: DataFrame) -> DataFrame:
    """Chapters from the cues of a description; all or nothing. items: item_id, description, duration. One array per row."""
    stamps = F.regexp_extract_all("description", F.lit(CUE), F.lit(1))
    parts = F.split("description", CUE)
    texts = F.slice(parts, F.lit(2), F.size(parts))
    secs = lambda s: F.aggregate(F.split(s, ":"), F.lit(0), lambda a, p: a * 60 + p.cast("int"))
    low = lambda s: F.forall(F.slice(F.split(s, ":"), 2, 2), lambda p: p.cast("int") < 60)
    marks = F.transform(F.arrays_zip(stamps.alias("stamp"), texts.alias("text")), lambda z: F.struct(
        z["stamp"].alias("stamp"), secs(z["stamp"]).alias("seconds"), F.substring(F.trim(F.substring_index(z["text"], "\n", 1)), 1, 180).alias("title"), low(z["stamp"]).alias("fits")))
    d = items.select("item_id", "duration", marks.alias("m"))
    second = lambda a: F.transform(a, lambda x: x["seconds"])
    rising = F.forall(F.zip_with(second(F.col("m")), F.slice(second(F.col("m")), F.lit(2), F.size("m")), lambda a, n: n.isNull() | (n > a)), lambda x: x)
    good = (F.forall("m", lambda x: x["fits"] & (x["title"] != "") & (F.col("duration").isNull() | (F.col("duration") == 0) | (x["seconds"] < F.col("duration"))))
            & rising & (F.size("m") >= 2) & (F.get("m", F.lit(0))["seconds"] <= 60))
    return d.filter(good).select("item_id", F.posexplode("m").alias("pos", "c")).select("item_id", "pos", "c.stamp", "c.seconds", "c.title")


# Field names, layouts and glyphs of stored digests.
STARS = "([★☆]{5})"
TAKEAWAY = r"(?m)^[ \t]*(\d+)\.[ \t]+([^\r\n]*\S)[ \t]*$"
SEPARATOR = r"^(?:[ \t]{0,3}#{1,6}[ \t]+\S.*|【[^】\r\n]{1,40}】|\*\*[^*\r\n]{1,40}\*\*|-{3,})$"
V4 = (r"(?s)\A## [^\r\n]{3,100}\n节目：\S[^\r\n]+\n(?:链接：[^\r\n]+\n)?(?:时长：[^\r\n]+\n)?\n*简介：[^\r\n]+\n\n*要点总结：\n(.*?)"
      r"\n推荐理由：[^\r\n]{8,160}\n推荐星级：([★☆]{5})[ \t]*\z")
NARRATIVE = r"(?s)\A(.*?)\n推荐理由：([^\r\n]{8,160})\s*\n推荐星级：([★☆]{5})[ \t]*\z"
LEGACY_RATING = r"\n推荐星级：([★☆]{5})(?:（([1-5])/5，编辑推荐）)?[ \t]*$"


def _visible(c: Column) -> Column:
    plain = F.regexp_replace(c, r"\[([^\]]+)\]\((https?://[^\s)]+)\)", "$1")
    return F.replace(F.replace(plain, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))


def _consistent(glyphs: Column, score: Column | None = None) -> Column:
    n = F.regexp_count(glyphs, F.lit("★")) if score is None else score
    return n.between(1, 5) & (glyphs == F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n)))


def _filled(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.trim(x) != "")


def digest_format(digests: DataFrame, banned: str = r"\[新\]|【新】|RSI[（(]") -> DataFrame:
    """Classify digests by structure: v4, narrative, legacy, usable or invalid. digests: item_id, markdown."""
    m = F.col("markdown")
    # v4: header fields, then 1 to 10 points numbered in order, then reason and rating.
    pts = _filled(F.split(F.regexp_extract(m, V4, 1), "\n"))
    in_order = F.forall(F.transform(pts, lambda x, i: x.rlike(r"\A\d+\. \S[^\r\n]*\z") & (F.substring_index(x, ".", 1) == (i + 1).cast("string"))), lambda b: b)
    v4 = m.rlike(V4) & F.size(pts).between(1, 10) & in_order & _consistent(F.regexp_extract(m, V4, 2)) & ~m.rlike(banned)
    # narrative: two or three readable paragraphs.
    head = F.substring_index(m, "\n## 内容解读\n", 1)
    rest = F.substring_index(m, "\n## 内容解读\n", -1)
    once = (F.length(m) - F.length(F.replace(m, F.lit("\n## 内容解读\n"), F.lit("")))) == F.length(F.lit("\n## 内容解读\n"))
    paras = F.split(F.trim(F.regexp_replace(F.regexp_extract(rest, NARRATIVE, 1), r"\A\s+|\s+\z", "")), r"\n\s*\n")
    para_ok = lambda p: (F.length(_visible(p)).between(40, 400) & ~p.rlike(r"(?m)^\s*(?:\d+[.、)]\s*|[-*>]\s+|#{1,6}\s+|【)")
                         & ~p.rlike(r"(?:嘉宾观点|嘉宾预测|公司主张|模型估算)\s*[:：]|https?://"))
    total = F.aggregate(paras, F.lit(0), lambda a, p: a + F.length(_visible(p)))
    one_reason = F.regexp_count(m, F.lit(r"(?m)^推荐理由：")) == 1
    narrative = (m.rlike(r"\A## [^\r\n]{3,100}\n") & once & head.rlike(r"(?m)^节目：\S.+$") & one_reason & rest.rlike(NARRATIVE)
                 & _consistent(F.regexp_extract(rest, NARRATIVE, 3)) & F.size(paras).between(2, 3) & total.between(160, 1000) & F.forall(paras, para_ok))
    # legacy: reason first, then numbered takeaways with nothing but headings between them.
    body = F.substring_index(m, "\n推荐星级：", 1)
    lines = F.split(body, "\n")
    is_point = lambda x: x.rlike(TAKEAWAY)
    points = F.filter(lines, is_point)
    before = F.get(F.split(body, TAKEAWAY, 2), F.lit(0))
    after = _filled(F.split(F.substring(body, F.length(before) + 1, F.length(body)), "\n"))
    numbered = F.forall(F.transform(points, lambda x, i: F.regexp_extract(x, TAKEAWAY, 1) == (i + 1).cast("string")), lambda b: b)
    takeaways = (F.size(points).between(1, 10) & numbered & F.forall(points, lambda x: F.length(_visible(F.trim(F.regexp_extract(x, TAKEAWAY, 2)))) <= 120)
                 & F.forall(after, lambda x: is_point(x) | F.trim(x).rlike(SEPARATOR)))
    shown, said = F.regexp_extract(m, LEGACY_RATING, 1), F.regexp_extract(m, LEGACY_RATING, 2)
    score = F.when(said != "", said.cast("int")).otherwise(F.regexp_count(shown, F.lit("★")))
    one_rating = (F.length(m) - F.length(F.replace(m, F.lit("\n推荐星级："), F.lit("")))) == F.length(F.lit("\n推荐星级："))
    legacy = one_rating & one_reason & m.rlike(LEGACY_RATING) & takeaways & before.rlike(r"(?m)^推荐理由：[^\r\n]{8,160}$") & _consistent(shown, score)
    # usable: enough substance although the layout is wrong.
    prose = F.filter(F.split(m, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"\A(?:#|节目：|链接：|时长：|推荐理由：|推荐星级：|要点总结：)"))
    usable = m.rlike(r"(?m)^(?:## |节目：)") & (F.aggregate(prose, F.lit(0), lambda a, x: a + F.length(F.trim(x))) >= 40)
    kind = F.when(v4, "v4").when(narrative, "narrative").when(legacy, "legacy").when(usable, "usable").otherwise("invalid")
    return digests.select("item_id", kind.alias("format"))


def answer_completeness(answers: DataFrame) -> DataFrame:
    """First rule an answer breaks. answers: item_id, text."""
    v = F.regexp_replace("text", EDGE_BLANKS, "")
    last = F.trim(F.element_at(F.split(v, "\n"), -1))
    promise = r"\A(?:好的[，。]?|收到[，。]?|可以[，。]?)?\s*(?:我会|我来|我将|让我).{0,65}(?:整理|分析|检查|查询|总结|处理)(?:一下)?[。！!]*\z"
    problem = (F.when(v == "", "empty").when(last.rlike(r"[:：]\s*$"), "unfinished_introduction")
               .when(last.rlike(r"\A(?:[-*+]\s*|\d+[.)、]\s*|#{1,6}\s*.+)\z"), "unfinished_list")
               .when(F.regexp_count(v, F.lit(r"(?m)^\s*```")) % 2 == 1, "unclosed_code").when(v.rlike(promise), "promise_only"))
    return answers.select(*[c for c in answers.columns if c != "text"], problem.alias("problem"))


# Id prefixes per kind of recipient.
TARGET_PREFIX = {"chat_id": "oc_", "open_id": "ou_"}


def well_formed_target() -> Column:
    shape = F.create_map(*[F.lit(x) for kv in TARGET_PREFIX.items() for x in kv])
    prefix = F.try_element_at(shape, F.col("kind"))
    return prefix.isNotNull() & F.col("target").startswith(prefix) & F.rlike(F.substring("target", 4, 200), F.lit(r"\A[A-Za-z0-9_-]{1,125}\z"))


def valid_targets(targets: DataFrame, allowlist: DataFrame | None = None, require: bool = False) -> DataFrame:
    """Well-formed recipients; when restricted, only allow-listed chats. ``require`` with no list keeps nothing. targets: seq, kind, target."""
    good = targets.filter(well_formed_target())
    if allowlist is None and not require:
        return good
    if allowlist is None:
        return good.filter(F.lit(False))
    return good.filter(F.col("kind") == "chat_id").join(allowlist.select("target").distinct(), "target", "left_semi").select(*targets.columns)


def stars_and_level(digests: DataFrame) -> DataFrame:
    """Stars of the rating line and the reading level. digests: item_id, markdown."""
    m = F.col("markdown")
    stars = F.regexp_count(F.regexp_extract(m, r"(?m)^推荐星级：([★☆]{5})", 1), F.lit("★"))
    loose = F.regexp_count(F.regexp_extract(m, r"推荐星级：([★☆]{5})", 1), F.lit("★"))
    has = m.rlike(r"阅读建议：[ \t]*[^\n]+")
    said = F.trim(F.regexp_extract(m, r"阅读建议：[ \t]*([^\n]+)", 1))
    explicit = F.when(said == ADVICE[0], 2).when(said == ADVICE[1], 1).otherwise(0)
    return digests.select("item_id", stars.alias("stars"), F.when(has, explicit).when(loose == 5, 2).when(loose == 4, 1).otherwise(0).alias("level"))


def glossary_normalise(texts: DataFrame, glossary: list[tuple[str, str, str]]) -> DataFrame:
    """Replace an alias by its term only where the source supports the term. texts: item_id, source_text, text. glossary: (source pattern, alias pattern, term)."""
    out = F.col("text")
    for supported, alias, term in glossary:
        out = F.when(F.rlike("source_text", F.lit(supported)), F.regexp_replace(out, alias, term)).otherwise(out)
    return texts.select("item_id", out.alias("text"))


# The glossary and the shape of a speaker label at a line start.
GLOSSARY = [(r"(?i)\bworld[ -]action models?\b", "世界[—-]?动作模型|world-action model", "world action model")]
SPEAKER_LINE = r"(?m)^\s*([A-Za-z][A-Za-z0-9 .,'’\-]{0,59}|[\x{3400}-\x{9fff}]{2,16})\s*:\s+\S"


def speaker_labels_reliable(transcripts: DataFrame) -> DataFrame:
    """At least two labels that occur at least twice each. transcripts: item_id, text (one or more rows per item); counts combine map-side."""
    labels = transcripts.select("item_id", F.explode_outer(F.regexp_extract_all("text", F.lit(SPEAKER_LINE), F.lit(1))).alias("raw"))
    named = labels.select("item_id", casefold(F.trim(F.regexp_replace("raw", r"\s+", " "))).alias("label"))
    per = named.groupBy("item_id", "label").agg(F.count("label").alias("n"))
    return per.groupBy("item_id").agg(F.count_if(F.col("n") >= 1).alias("labels"), (F.count_if(F.col("n") >= 2) >= 2).alias("reliable"))


def quote_units(text: Column | str) -> Column:
    """Han characters one by one, any other word once."""
    return F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}]|[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*+"))


def warning_fingerprints(warnings: DataFrame) -> DataFrame:
    """Distinct warnings by a hash over safe fields only. warnings: job_key, code, day (text), target, used, limit_n."""
    y, mo, d = (F.regexp_extract("day", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i) for i in (1, 2, 3))
    date = F.concat(y, F.lit("-"), F.lpad(mo, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")
    day = F.coalesce(date.cast("string"), F.lit("unknown"))
    target = F.substring(F.sha2("target", 256), 1, 12)
    fields = F.concat(F.lit('{"code": "'), "code", F.lit('", "day": "'), day, F.lit('"'),
                      F.when(F.col("used").isNotNull(), F.concat(F.lit(', "limit": '), "limit_n")).otherwise(""),
                      F.when(F.col("target").isNotNull(), F.concat(F.lit(', "target": "'), target, F.lit('"'))).otherwise(""),
                      F.when(F.col("used").isNotNull(), F.concat(F.lit(', "used": '), "used")).otherwise(""), F.lit("}"))
    return warnings.select("job_key", "code", day.alias("day"), target.alias("target"), F.sha2(fields, 256).alias("identity")).distinct()
