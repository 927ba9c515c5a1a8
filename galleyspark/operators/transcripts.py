"""Transcripts as tables of lines, blocks and chunks: parsing, cleaning, cutting and checks.

A text is exploded once; later steps are column rules, windows over an item's lines and joins of the few rows that open an
advertisement. An item's lines come from one row, so a window per item is bounded by that row, and all windows, joins and
counts share one partitioning by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galleyspark.functions import arrow, cutting
from galleyspark.functions.text import BLANKS, EDGE_BLANKS, casefold, stripped
from galleyspark.operators.ordered import Running, dense_position, prefix_scan
from galleyspark.session import cut_lineage

BLOCK = 512

# Line shapes, stage directions, evidence markers, fillers.
TIMESTAMP_LINE = r"\A\s*(?:\[|\()?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:\]|\))?\s*\z"
CUE_TIMING = r"\A\s*(?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3}\s+-->\s+(?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3}(?:\s+.*)?\z"
BRACKET_LABEL = r"(?s)\A\[([^\]\n]{1,80})\]\s*(.*)\z"
COLON_LABEL = r"(?s)\A([A-Za-z][A-Za-z0-9 .,'’\-]{0,79}|[\x{3400}-\x{9fff}]{2,20})[:：]\s*(.*)\z"
STAGE = ["music", "applause", "laughter", "laughs", "音乐", "掌声", "笑声"]
MARKERS = ["inaudible", "crosstalk", "听不清"]
FILLERS = ["um", "uh", "erm", "呃"]
NOT_SPEAKERS = ["kind", "language", "note", "region", "style"]


def looks_like_speaker(label: Column) -> Column:
    clean = F.trim(F.regexp_replace(label, r"\s+", " "))
    plain = F.regexp_replace(casefold(clean), r"\A[ .:：—_\[\]()-]+|[ .:：—_\[\]()-]+\z", "")
    return ((plain != "") & ~plain.isin(STAGE + MARKERS + NOT_SPEAKERS) & ~clean.rlike(TIMESTAMP_LINE) & (F.size(F.split(clean, " ")) <= 8)
            & clean.rlike(r"\A[A-Za-z0-9\x{3400}-\x{9fff} .,'’\-]{1,80}\z"))


def split_inline_speakers(line: Column) -> Column:
    """A line that starts with a bracketed speaker is cut before every further bracketed speaker."""
    label = lambda p: F.regexp_extract(p, r"\A\[([^\]\n]{1,80})\]", 1)
    is_turn = lambda p: p.rlike(r"\A\[[^\]\n]{1,80}\]") & looks_like_speaker(label(p))
    parts = F.split(line, r"(?=\[[^\]\n]{1,80}\])")
    none = F.array().cast("array<string>")
    joined = F.aggregate(parts, none, lambda acc, p: F.when((F.size(acc) == 0) | is_turn(p), F.concat(acc, F.array(p))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))))
    turns = F.filter(F.transform(joined, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.contains(line, F.lit("[")) & is_turn(F.get(parts, F.lit(0))), turns).otherwise(F.array(line))


def transcript_lines(docs: DataFrame) -> DataFrame:
    """Evidence lines in order: plain lines, or the payload of caption files. docs: item_id, text. Returns item_id, pos, blk, line.

    Caption files are taken apart group by group (groups are separated by blank lines): headers before the first cue, control
    groups, cue ids and timings go; everything inside a cue stays. Steps are separate columns so that none is computed twice.
    """
    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), "[\ufeff\u200b]", ""), "\u00a0", " ")
    norm = F.regexp_replace(norm, r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n")
    trim = lambda x: F.trim(F.regexp_replace(x, EDGE_BLANKS, ""))
    filled = lambda a: F.filter(F.transform(F.split(a, "\n"), trim), lambda x: x != "")
    d = docs.select("item_id", norm.alias("t")).withColumn("web", F.lower(F.regexp_replace("t", r"\A\s+", "")).startswith("webvtt"))
    d = d.withColumn("captions", F.col("web") | F.rlike("t", F.lit(CUE_TIMING.replace(r"\A", "(?m)^").replace(r"\z", "$"))))
    groups = F.transform(F.split("t", r"\n(?:[^\S\n]*\n)++|\A(?:[^\S\n]*\n)++"), filled)
    c = d.withColumn("groups", F.when(F.col("captions"), F.filter(groups, lambda g: F.size(g) > 0)))
    c = c.withColumn("timing", F.transform("groups", lambda g: F.array_position(F.transform(g, lambda x: x.rlike(CUE_TIMING)), F.lit(True)).cast("int")))
    c = c.withColumn("first_cue", F.array_position(F.transform("timing", lambda x: x > 0), F.lit(True)).cast("int"))
    header = lambda x: (F.lower(x) == "webvtt") | x.startswith("Kind:") | x.startswith("Language:")
    leading = lambda g: F.coalesce(
        F.nullif(F.array_position(F.transform(g, lambda x: ~header(x)), F.lit(True)).cast("int"), F.lit(0)) - 1, F.size(g))
    c = c.withColumn("heads", F.transform("groups", lambda g, i: F.when(F.col("web") & ((F.col("first_cue") == 0) | (i < F.col("first_cue"))), leading(g)).otherwise(0)))
    z = F.arrays_zip("groups", "timing", "heads")
    none = F.array().cast("array<string>")

    def payload(g):
        lines, h, at = g["groups"], g["heads"], g["timing"] - g["heads"]
        control = F.col("web") & F.coalesce(F.get(lines, h).rlike(r"\A(?:NOTE(?:\s.*|\z)|STYLE\z|REGION\z)"), F.lit(False))
        before = F.when(at > 2, F.slice(lines, h + 1, at - 1)).otherwise(none)
        return F.when(control, none).when(at <= 0, F.slice(lines, h + 1, F.size(lines) + 1)).otherwise(F.concat(before, F.slice(lines, g["timing"] + 1, F.size(lines) + 1)))

    c = c.withColumn("raw", F.when(F.col("captions"), F.flatten(F.transform(z, payload))).otherwise(filled("t")))
    lines = F.flatten(F.transform("raw", split_inline_speakers))
    return c.select("item_id", F.posexplode(lines).alias("pos", "line")).withColumn("blk", F.floor(F.col("pos") / BLOCK))


def _direction(line: Column) -> Column:
    inner = casefold(F.trim(F.regexp_replace(F.regexp_extract(line, r"\A(?:\[(.*)\]|\((.*)\))\z", 0), r"\s+", " ")))
    inner = F.trim(F.substring(inner, 2, 78))
    inner = F.trim(F.regexp_replace(inner, r"[\])]\z", ""))
    inner = F.regexp_replace(inner, r"\s+\d{1,2}:\d{2}(?::\d{2})?\z", "")
    return F.when((F.length(line) <= 80) & line.rlike(r"\A(?:\[.*\]|\(.*\))\z") & inner.isin(STAGE + MARKERS), inner).otherwise("")


def _is_heading(line: Column) -> Column:
    upper = line.rlike("[A-Za-z]") & (F.upper(line) == line) & (F.lower(line) != line)
    return (F.length(line) <= 100) & ~line.rlike("[?!？！]") & (upper | line.rlike(r"(?i)\A(?:PART|CHAPTER)\s+\d+(?:\s*[:|—-].*)?\z"))


def classify_blocks(lines: DataFrame) -> DataFrame:
    """Kind, speaker and text of each line: stage, marker, heading, speech or text. lines: item_id, blk, pos, line.

    The last label, heading or marker before a line decides who speaks; one scan finds it.
    """
    line = F.trim("line")
    direction = _direction(line)
    b_ok = line.rlike(BRACKET_LABEL) & looks_like_speaker(F.regexp_extract(line, BRACKET_LABEL, 1))
    c_ok = line.rlike(COLON_LABEL) & looks_like_speaker(F.regexp_extract(line, COLON_LABEL, 1))
    own = F.when(direction != "", "").when(b_ok, F.trim(F.regexp_extract(line, BRACKET_LABEL, 1))).when(c_ok, F.trim(F.regexp_extract(line, COLON_LABEL, 1))).otherwise("")
    body = F.when(own == "", line).when(b_ok, F.trim(F.regexp_extract(line, BRACKET_LABEL, 2))).otherwise(F.trim(F.regexp_extract(line, COLON_LABEL, 2)))
    first = (F.when(direction.isin(STAGE), "stage").when(direction != "", "marker").when(own != "", "label").when(_is_heading(line), "heading").otherwise("plain"))
    marked = lines.select("item_id", "blk", "pos", first.alias("first"), own.alias("own"), body.alias("text"))
    event = F.when(F.col("first") == "label", F.col("own")).when(F.col("first").isin("marker", "heading"), F.lit(""))
    ran = prefix_scan(marked, ["item_id"], [], ["pos"], who=Running("last", event))
    who = F.coalesce("who", F.lit(""))
    talks = F.col("first").isin("label", "plain") & (who != "")
    kind = F.when(talks, "speech").when(F.col("first") == "plain", "text").otherwise(F.col("first"))
    return ran.filter(~((F.col("first") == "label") & (F.col("text") == ""))).select("item_id", "blk", "pos", kind.alias("kind"), F.when(talks, who).otherwise("").alias("speaker"), "text")


def is_filler(text: Column) -> Column:
    """Nothing but hesitation, and no digit or currency."""
    plain = F.trim(F.regexp_replace(casefold(text), r"[^a-z\x{3400}-\x{9fff}'-]+", " "))
    return ~text.rlike(r"\p{Nd}|[$€£¥%]") & F.regexp_replace(plain, r"\s+", " ").isin(FILLERS)


def drop_fillers(blocks: DataFrame) -> DataFrame:
    """Blocks without speech that only hesitates."""
    return blocks.filter(~((F.col("kind") == "speech") & is_filler(F.col("text"))))


def mark_caption_repeats(blocks: DataFrame) -> DataFrame:
    """Flags text blocks equal to the block before them. Equality is transitive, so the previous block stands for the last kept one."""
    form = F.struct(F.col("kind"), F.col("speaker"), F.sha2(casefold(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("h"))
    ran = prefix_scan(blocks.withColumn("form", form), ["item_id"], [], ["pos"], prev=Running("last", "form", before=True))
    return ran.withColumn("repeat", (F.col("kind") == "text") & F.coalesce(F.col("prev") == F.col("form"), F.lit(False))).drop("prev", "form")


def drop_caption_repeats(blocks: DataFrame) -> DataFrame:
    return mark_caption_repeats(blocks).filter(~F.col("repeat")).drop("repeat")


# Advertisements ---------------------------------------------------------------------------------

# Patterns that open, end, excuse and protect sponsor reads, and their limits.
AD_MAX_BLOCKS, AD_MAX_CHARS = 18, 12000
DOMAIN = r"(?i)\b(?:https?://)?(?:www\.)?[a-z0-9][a-z0-9.-]*\.(?:com|ai|io|co|fm)(?:/[a-z0-9_./?=&%+~-]*)?"
AD_START = (r"(?i)(?:presenting (?:sponsor|partner)|thank (?:our|the) (?:brand new )?(?:presenting )?(?:sponsor|partner|friends)(?: at)?|"
            r"thank you to (?:our|the) (?:sponsors|partners|friends)|this (?:episode|podcast|show) is (?:brought to you|sponsored) by|"
            r"(?:a )?(?:quick|brief) word from (?:our|the) sponsor|support for this (?:episode|podcast|show) comes from|"
            r"brought to you by our|paid partnership with|感谢本期(?:赞助商|合作伙伴)|本期(?:节目)?由.+赞助)")
AD_CTA = (r"(?i)(?:go(?:ing)? to|head to|visit|sign up|start (?:your )?free trial|use (?:the )?(?:code|promo)|learn more at|link in (?:the )?show notes|"
          r"tell (?:them|’em|'em) that|访问|优惠码|免费试用|点击节目简介)")
AD_RETURN = r"(?i)\b(?:now |so,? )?(?:let(?:'s| us) )?(?:go|get|come)?\s*back to\b|\bbefore we go back to\b|回到(?:节目|对谈|正题)"
AFTER_CTA = r"(?i)\b(?:okay|all right),\s*(?:[A-Z][A-Za-z'’.-]{0,30},\s*)?(?:so\s+)?(?=(?:how|what|why|where|when|back|let(?:'s| us)))"
AD_CONFLICT = (r"(?i)(?:audit|audited|bias|biased|disclos|conflict|contract|investigat|did not influence|funded the study|reported revenue|"
               r"审计|偏见|利益冲突|赞助披露|合同|未影响)")
DISCLAIMER = r"(?i)\b(?:this (?:show|podcast) is not (?:financial|investment) advice|for informational and entertainment purposes only)\b"
HOUSEKEEPING = (r"(?i)(?:companion pdf|join (?:the|our) email list|join the slack|behind-the-scenes photos|vote on future episode topics|"
                r"come discuss it with|节目资料包|加入邮件列表|加入社群)")
FOOTER = r"(?i)(?:a huge thank you to our partners|感谢本季(?:所有)?合作伙伴)"
AD_EVIDENCE = (r"(?i)(?:\p{Nd}|[$€£¥%]|[?？]|\b(?:but|could|guest|however|may|might|not|only|said|told)\b|"
               r"\b(?:accord|audit|bias|claim|conflict|contract|declin|estimate|investigat|margin|report|revenue|risk|study)\w*\b|"
               r"收入|营收|利润|毛利|增长|下降|审计|报告|声称|合同|调查|偏见|冲突|风险|但是|但|尚未|未经|可能|嘉宾|数据显示)")
CODE_OR_RETURN = r"(?i)(?:use (?:the )?(?:code|promo)|tell (?:them|’em|'em) that|sent you|回到(?:节目|对谈|正题)|优惠码)"
OUTRO = (r"(?i)\A\s*(?:i hope you enjoyed (?:this|the) episode(?:\s+(?:and\s+)?please (?:remember to )?subscribe)?|"
         r"thanks for listening(?:\s+(?:and\s+)?please (?:remember to )?subscribe)?|"
         r"please (?:remember to )?subscribe(?:\s+to\s+(?:this|the|our)\s+(?:show|podcast|channel))?(?:\s*,?\s*(?:rate(?:\s+and\s+review)?|review))?|"
         r"please (?:remember to )?rate\s+and\s+review(?:\s+(?:this|the|our)\s+(?:show|podcast|episode))?|"
         r"please (?:remember to )?(?:rate|review)\s+(?:this|the|our)\s+(?:show|podcast|episode)|"
         r"join (?:the|our) email list|check out our companion pdf|a huge thank you to our partners|"
         r"感谢收听(?:\s*[，,]\s*(?:欢迎订阅|点赞并订阅))?|欢迎订阅|点赞并订阅)(?=\s*(?:[.!?。！？]|\z))")
SENTENCE = r"(?s)(.+?(?:[.!?。！？]+(?:[\"'’”)]*)|\z)(?:\s+|\z))"
BRAND_STOPWORDS = ["and", "at", "by", "for", "from", "our", "partner", "sponsor", "the", "this", "with"]


def _start(text: Column, pattern: str) -> Column:
    """Offset of the first match; null if there is none."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def _after(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def _sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _evidence_of(text: Column, opens: Column) -> Column:
    """Sentences of a sponsor read worth keeping. ``opens``: the text starts with the opening phrase, whose sentence keeps only its rest."""
    def keep(s, i):
        v = F.trim(s)
        phrase = F.regexp_extract(v, AD_START, 0)
        at = _start(v, AD_START)
        tail = F.regexp_replace(_after(v, at + F.length(phrase)), r"\A[ ,;:—-]+|[ ,;:—-]+\z", "")
        head = F.trim(F.substring(v, F.lit(1), at))
        opened = F.concat_ws(" ", F.when(head != "", head), F.when((tail != "") & tail.rlike(AD_EVIDENCE), tail))
        return F.when(opens & (i == 0) & at.isNotNull(), opened).when(v.rlike(AD_EVIDENCE) | v.rlike(AD_CONFLICT), v).otherwise("")

    return F.trim(F.array_join(F.filter(F.transform(_sentences(text), keep), lambda s: s != ""), " "))


def _cta_span(text: Column) -> tuple[Column, Column]:
    """Where the call to action of a block starts and where the talk goes on; null if it has no call with a domain."""
    domains = _matches(text, DOMAIN)
    cta_at, dom_at = _start(text, AD_CTA), _start(text, DOMAIN)
    cta_end = cta_at + F.length(F.regexp_extract(text, AD_CTA, 0))
    last = F.element_at(domains, -1)
    dom_end = F.length(text) - F.length(F.call_function("substring_index", text, last, F.lit(-1)))
    has = cta_at.isNotNull() & (F.size(domains) > 0)
    mark = F.greatest(cta_end, dom_end)
    rest = _after(text, dom_end)
    turn = dom_end + F.least(_start(rest, AFTER_CTA), _start(rest, AD_RETURN))
    ends = F.aggregate(_sentences(text), F.struct(F.lit(0).alias("at"), F.lit(-1).alias("hit")), lambda a, s: F.struct(
        (a["at"] + F.length(s)).alias("at"), F.when((a["hit"] < 0) & (a["at"] + F.length(s) >= mark), a["at"] + F.length(s)).otherwise(a["hit"]).alias("hit")))["hit"]
    sentence_end = F.when(ends < 0, F.length(text)).otherwise(ends)
    return F.when(has, F.least(cta_at, dom_at)), F.when(has, F.when(turn >= mark, turn).otherwise(sentence_end))


def _brands(text: Column) -> Column:
    """Proper names of the opening sentence after its opening phrase."""
    phrase = F.regexp_extract(text, AD_START, 0)
    rest = _after(text, _start(text, AD_START) + F.length(phrase))
    first = F.coalesce(F.get(_sentences(rest), F.lit(0)), rest)
    names = F.filter(F.transform(F.regexp_extract_all(first, F.lit(r"(\b[A-Z][A-Za-z0-9'-]{1,39}\b)"), F.lit(1)), lambda w: F.lower(w)), lambda w: ~w.isin(BRAND_STOPWORDS))
    zh = casefold(F.regexp_extract(phrase, r"由\s*([^\s，。！？]{2,30}?)\s*赞助", 1))
    return F.when(zh != "", F.concat(names, F.array(zh))).otherwise(names)


def ad_spans(placed: DataFrame) -> DataFrame:
    """Confirmed sponsor reads: opening index, last index and how the last block splits. placed: blocks with a dense index ``n`` per item.

    Only opening blocks are joined with the at most 18 blocks after them; overlapping reads are resolved first come first served.
    """
    opens = placed.filter(F.col("text").rlike(AD_START) & ~F.col("text").rlike(AD_CONFLICT)).select(
        "item_id", F.col("n").alias("o"), casefold(F.trim("speaker")).alias("o_speaker"), _start(F.col("text"), AD_START).alias("o_at"), _brands(F.col("text")).alias("brands"))
    near = opens.withColumn("n", F.explode(F.sequence(F.col("o"), F.col("o") + AD_MAX_BLOCKS - 1)))
    c = near.join(placed.select("item_id", "n", "kind", casefold(F.trim("speaker")).alias("speaker"), "text"), ["item_id", "n"])
    later = F.col("n") > F.col("o")
    text = F.when(later, F.col("text")).otherwise(_after(F.col("text"), F.col("o_at")))
    c = c.withColumn("chars", F.sum(F.length("text")).over(Window.partitionBy("item_id", "o").orderBy("n"))).withColumn("t", text)
    stops = (later & (F.col("o_speaker") != "") & (F.col("speaker") != "") & (F.col("speaker") != F.col("o_speaker"))) | (F.col("chars") > AD_MAX_CHARS) | (
        later & F.col("kind").isin("boundary", "heading", "marker", "stage"))
    t = F.col("t")
    cut, resume = _cta_span(t)
    domains = F.transform(_matches(t, DOMAIN), casefold)
    named = F.exists(domains, lambda d: F.exists("brands", lambda b: F.contains(d, b)))
    ours = named | t.rlike(CODE_OR_RETURN) | t.rlike(AD_RETURN) | t.rlike(AFTER_CTA)
    by_cta = cut.isNotNull() & ours
    said = _start(t, DISCLAIMER)
    c = c.select("item_id", "o", "n", stops.alias("stops"), (by_cta | said.isNotNull()).alias("ends"),
                 F.struct(F.trim(F.substring(t, F.lit(1), F.when(by_cta, cut).otherwise(said))).alias("head"), F.trim(_after(t, F.when(by_cta, resume).otherwise(said))).alias("tail")).alias("parts"))
    g = c.groupBy("item_id", "o").agg(F.min(F.when(F.col("stops"), F.col("n"))).alias("stop"), F.min(F.when(F.col("ends"), F.struct("n", "parts"))).alias("e"))
    g = g.filter(F.col("e").isNotNull() & (F.col("stop").isNull() | (F.col("e.n") < F.col("stop")))).select("item_id", "o", F.col("e.n").alias("last"), "e.parts.head", "e.parts.tail")
    # An opening inside an earlier confirmed read is part of it. Reads of a text are few; fold them in order.
    spans = g.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("o", "last", "head", "tail"))).alias("s"))
    none = F.slice("s", 1, 0)
    chosen = F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) == 0) | (x["o"] > F.element_at(acc, -1)["last"]), F.concat(acc, F.array(x))).otherwise(acc))
    return spans.select("item_id", F.explode(chosen).alias("x")).select("item_id", "x.o", "x.last", "x.head", "x.tail")


def remove_ads(blocks: DataFrame) -> DataFrame:
    """Sponsor reads removed except for sentences that carry evidence; ``ad`` marks each block of a confirmed read.

    blocks: item_id, blk, pos, kind, speaker, text. Returns the rows in order of (pos, sub); removed text leaves boundaries.
    """
    placed = dense_position(blocks, ["item_id"], [], ["pos"], "n")
    spans = ad_spans(placed)
    inside = spans.withColumn("n", F.explode(F.sequence("o", "last")))
    j = placed.join(inside, ["item_id", "n"], "left")
    in_ad, first, final = F.col("o").isNotNull(), F.col("n") == F.col("o"), F.col("n") == F.col("last")
    at = _start(F.col("text"), AD_START)
    segment = F.when(final, F.col("head")).when(first, _after(F.col("text"), at)).otherwise(F.col("text"))
    kept = _evidence_of(segment, first)
    piece = lambda kind, text: F.struct(kind.alias("kind"), F.when(kind == "boundary", "").otherwise(F.col("speaker")).alias("speaker"), text.alias("text"))
    cut = piece(F.lit("boundary"), F.lit(""))
    same = lambda text: piece(F.col("kind"), text)
    lead = F.trim(F.substring(F.col("text"), F.lit(1), at))
    parts = F.array(F.when(first & (lead != ""), same(lead)), F.when(first, cut), F.when(kept != "", same(kept)),
                    F.when(final & (F.col("tail") != ""), same(F.col("tail"))), F.when((kept != "") | final, cut))
    rows = F.when(in_ad, F.filter(parts, lambda p: p.isNotNull())).otherwise(F.array(same(F.col("text"))))
    marked = j.select("item_id", "blk", "pos", in_ad.alias("ad"), F.when(F.size(rows) > 0, rows).otherwise(F.array(piece(F.lit("gone"), F.lit("")))).alias("rows"))
    out = marked.select("item_id", "blk", "pos", "ad", F.posexplode("rows").alias("sub", "r")).select("item_id", "blk", "pos", "sub", (F.col("ad") & (F.col("sub") == 0)).alias("ad"), "r.kind", "r.speaker", "r.text")
    return out


def drop_edge_promos(blocks: DataFrame) -> DataFrame:
    """Show logistics near both ends and closing phrases in the last blocks. Adds ``promo``; removed blocks become boundaries.

    blocks: item_id, blk, pos, sub, kind, speaker, text.
    """
    placed = dense_position(blocks, ["item_id"], [], ["pos", "sub"], "n").withColumn("size", F.count("*").over(Window.partitionBy("item_id")))
    i, size, text = F.col("n") - 1, F.col("size"), F.col("text")
    domains = F.regexp_count(text, F.lit(DOMAIN))
    house = ((i < 40) | (i >= size - 40)) & (domains >= 2) & text.rlike(HOUSEKEEPING) & ~text.rlike(AD_EVIDENCE)
    closing = i >= size - 12
    footer = closing & (domains >= 2) & text.rlike(FOOTER)
    lead = F.trim(F.substring(text, F.lit(1), _start(text, FOOTER)))
    polite = F.regexp_replace(casefold(lead), r"\A[ .,!?:;—-]+|[ .,!?:;—-]+\z", "").isin("yes", "yep", "right", "okay", "ok")

    def trimmed(s):
        rest = F.trim(F.regexp_replace(_after(s, F.length(F.regexp_extract(s, OUTRO, 0))), r"(?i)\A[\s,;:—-]*(?:and\s+)?", ""))
        return F.when(s.rlike(OUTRO), F.when(rest.rlike(r"[A-Za-z0-9㐀-鿿]"), rest).otherwise("")).otherwise(F.trim(s))

    cleaned = F.trim(F.array_join(F.filter(F.transform(_sentences(text), trimmed), lambda s: s != ""), " "))
    changed = closing & ~footer & (F.col("kind") != "boundary") & F.exists(_sentences(text), lambda s: s.rlike(OUTRO))
    kept = F.when(house, "").when(footer, F.when(polite, "").otherwise(lead)).when(changed, cleaned).otherwise(text)
    promo = house | footer | changed
    piece = lambda kind, t: F.struct(kind.alias("kind"), F.when(kind == "boundary", "").otherwise(F.col("speaker")).alias("speaker"), t.alias("text"))
    rows = F.when(promo, F.filter(F.array(F.when(kept != "", piece(F.col("kind"), kept)), piece(F.lit("boundary"), F.lit(""))), lambda p: p.isNotNull())).otherwise(F.array(piece(F.col("kind"), text)))
    extra = [c for c in blocks.columns if c not in ("item_id", "blk", "pos", "sub", "kind", "speaker", "text")]
    return placed.select("item_id", "blk", "pos", F.col("sub").alias("sub0"), *extra, promo.alias("promo"), F.posexplode(rows).alias("sub1", "r")).select(
        "item_id", "blk", "pos", (F.col("sub0") * 4 + F.col("sub1")).alias("sub"), *extra, (F.col("promo") & (F.col("sub1") == 0)).alias("promo"), "r.kind", "r.speaker", "r.text")


def clean_transcripts(docs: DataFrame) -> DataFrame:
    """The whole chain per item: stage directions, fillers, caption repeats, ads, promos, then adjacent turns merged.

    docs: item_id, text, is_caption. Returns the blocks left, with the item's removal counters; an item that would end up empty
    keeps its unfiltered blocks.
    """
    from galleyspark.operators.windows import merge_turns

    parsed = classify_blocks(transcript_lines(docs)).join(docs.select("item_id", "is_caption"), "item_id")
    gone = F.when(F.col("kind") == "stage", "stage").when((F.col("kind") == "speech") & is_filler(F.col("text")), "filler")
    soft = parsed.withColumn("gone", gone).select(
        "item_id", "blk", "pos", "is_caption", "gone", F.struct("kind", "speaker", "text").alias("was"), F.when(F.col("gone").isNotNull(), "boundary").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("gone").isNotNull(), "").otherwise(F.col("speaker")).alias("speaker"), F.when(F.col("gone").isNotNull(), "").otherwise(F.col("text")).alias("text"))
    # The two tables that several later steps read are kept as checkpoints.
    rep = cut_lineage(mark_caption_repeats(soft).withColumn("repeat", F.col("repeat") & F.col("is_caption")))
    ads = cut_lineage(remove_ads(rep.filter(~F.col("repeat")).select("item_id", "blk", "pos", "kind", "speaker", "text")))
    promos = drop_edge_promos(ads.filter("kind <> 'gone'"))
    early = rep.groupBy("item_id").agg(F.count_if(F.col("gone") == "stage").alias("stages"), F.count_if(F.col("gone") == "filler").alias("fillers"), F.count_if("repeat").alias("repeats"))
    late = promos.groupBy("item_id").agg(F.count_if("promo").alias("promos"), F.count_if((F.col("kind") != "boundary") & (F.trim("text") != "")).alias("left"))
    counts = early.join(ads.groupBy("item_id").agg(F.count_if("ad").alias("ads")), "item_id", "left").join(late, "item_id", "left")
    zero = F.lit(0).cast("long")
    counts = counts.select("item_id", "stages", "fillers", "repeats", (F.coalesce("ads", zero) + F.coalesce("promos", zero)).alias("ads"), (F.coalesce("left", zero) == 0).alias("lost"))
    merged = merge_turns(promos.select("item_id", "pos", "sub", "kind", "speaker", "text", (F.col("kind") == "boundary").alias("removed")), ["item_id"], [], ["pos", "sub"])
    raw = rep.filter(F.col("was.kind") != "stage").join(counts.filter("lost").select("item_id"), "item_id", "left_semi")
    fallback = merge_turns(raw.select("item_id", "pos", F.lit(0).alias("sub"), "was.kind", "was.speaker", "was.text", F.lit(False).alias("removed")), ["item_id"], [], ["pos", "sub"])
    return merged.unionByName(fallback).join(counts.drop("lost"), "item_id")


# Cutting ----------------------------------------------------------------------------------------


def _chunks(docs: DataFrame, pieces: Column) -> DataFrame:
    return docs.select("item_id", F.posexplode(pieces).alias("pos", "text")).select(
        "item_id", F.concat(F.lit("C"), F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(4), F.length((F.col("pos") + 1).cast("string"))), F.lit("0"))).alias("chunk_id"), "pos", "text")


def chunk_citations(docs: DataFrame) -> DataFrame:
    """Lossless citation chunks. docs: item_id, text."""
    return _chunks(docs, cutting.citation_chunks("text"))


def chunk_evidence(docs: DataFrame) -> DataFrame:
    """Lossless evidence blocks."""
    return _chunks(docs, cutting.evidence_chunks("text"))


# Cue stamps that are removed before translation.
CUE = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{3})?"
BRACKET_CUE = r"[\[(]" + CUE + r"[\])]"
LEADING_CUE = r"(?m)^[ \t]*" + CUE + r"(?:[ \t]*-->[ \t]*" + CUE + r")?[ \t]*(?:\n|(?=\S)|$)"


def without_stamps(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BRACKET_CUE, ""), LEADING_CUE, ""), EDGE_BLANKS, "")


def chunk_translation(docs: DataFrame) -> DataFrame:
    """Segments for translation: stamps removed, cut at sentence ends."""
    return _chunks(docs.select("item_id", without_stamps(F.col("text")).alias("text")), cutting.sentence_chunks("text"))


STAMP_SPLIT = r"(?m)(?=^\[\d{1,3}:\d{2}(?::\d{2})?\])"
STAMPED_SPEAKER = r"\A\[\d{1,3}:\d{2}(?::\d{2})?\]\s*([^:\n：]{1,80})[:：]"


def stamped_bodies(docs: DataFrame) -> DataFrame:
    """Pieces at line-start stamps; texts without stamps become citation chunks. Returns item_id, pos, blk, text."""
    cut = F.filter(F.split("text", STAMP_SPLIT), lambda x: x != "")
    pieces = F.when(F.rlike("text", F.lit(r"(?m)^\[\d{1,3}:\d{2}(?::\d{2})?\]")), cut)
    plain = cutting.citation_chunks(F.when(pieces.isNull(), F.col("text")))
    return docs.select("item_id", F.posexplode(F.coalesce(pieces, plain)).alias("pos", "text")).withColumn("blk", F.floor(F.col("pos") / BLOCK))


def time_anchor(bodies: DataFrame) -> DataFrame:
    """First stamp in a piece, else the last stamp before it. bodies: item_id, blk, pos, text."""
    stamps = F.regexp_extract_all("text", F.lit(r"\[(\d{1,3}:\d{2}(?::\d{2})?)\]"), F.lit(1))
    b = bodies.withColumn("first", F.get(stamps, F.lit(0))).withColumn("last", F.when(F.size(stamps) > 0, F.element_at(stamps, -1)))
    ran = prefix_scan(b, ["item_id"], ["blk"], ["pos"], prev=Running("last", "last", before=True))
    return ran.select("item_id", "pos", F.coalesce("first", "prev", F.lit("")).alias("time"))


def speaker_units(docs: DataFrame, high: int = 2400) -> DataFrame:
    """Adjacent pieces of one named speaker joined, then cut to ``high`` characters. Every character stays."""
    b = stamped_bodies(docs).withColumn("speaker", F.regexp_extract("text", STAMPED_SPEAKER, 1)).withColumn("speaker", F.trim("speaker"))
    seen = prefix_scan(b, ["item_id"], [], ["pos"], prev=Running("last", "speaker", before=True))
    starts = seen.withColumn("starts", F.when((F.col("speaker") != "") & (F.col("prev") == F.col("speaker")), 0).otherwise(1).cast("long")).drop("prev")
    isl = prefix_scan(starts, ["item_id"], [], ["pos"], island=Running("sum", "starts"))
    joined = isl.groupBy("item_id", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "").alias("text"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / high).cast("int")), lambda i: F.substring(F.col("text"), i * high + 1, F.lit(high)))
    return joined.select("item_id", "island", F.posexplode(parts).alias("part", "text"))


def pack_batches(docs: DataFrame) -> DataFrame:
    """Greedy batches of a text's paragraphs. docs: item_id, units (array). Returns item_id, pos, chars, batch."""
    sizes = F.transform("units", lambda u: F.length(u))
    return docs.select("item_id", sizes.alias("sizes"), arrow.batch_numbers(sizes).alias("b")).select(
        "item_id", F.posexplode(F.arrays_zip("sizes", "b")).alias("pos", "z")).select("item_id", "pos", F.col("z.sizes").alias("chars"), F.col("z.b").alias("batch"))


def merge_rolling_captions(captions: DataFrame) -> DataFrame:
    """One running text per caption file. captions: item_id, chunks (array in order)."""
    return captions.select("item_id", cutting.merged_captions("chunks").alias("text"))


# Compaction and checks --------------------------------------------------------------------------

# Sentence shape and the words that protect a sentence.
ZH_SENTENCE = r"([^。！？]+[。！？]?(?:[”’」』])?)"
DURATION = "(?:数|几|多|[0-9]+|[一二三四五六七八九十两]+)(?:天|周|月|年)"
CLIPPABLE = "降低|提高|减少|增加|推动|削弱|建立|完成|保持|解决|发展|进行"
RESULT_WORDS, MODAL = "，|则|那么|就|才", "能(?!力)"
PROTECTED = "认为|可能|若|如果|否则|只有|除非|则|称|不认同|仅"
HEDGES = ["认为", "可能", "若", "称", "不认同"]
CONNECTORS = ["若", "如果", "否则", "只有", "除非"]


def extractive_compact(docs: DataFrame, ratio: float = 0.4) -> DataFrame:
    """First sentence, every sentence with numbers, names or hedges, then as many others as the ratio allows; always two paragraphs if possible.

    docs: item_id, paragraphs (array). An unprotected sentence is taken while protected text plus the unprotected text before it
    is short of the target, which is the same as filling sentence by sentence.
    """
    from galleyspark.operators.rollups import number_tokens

    sents = lambda p: F.regexp_extract_all(p, F.lit(ZH_SENTENCE), F.lit(1))

    protected = lambda x, i: (i == 0) | (F.size(number_tokens(x)) > 0) | x.rlike("[A-Z]") | x.rlike(PROTECTED)
    row = lambda x, i: F.struct(x.alias("s"), i.alias("i"), F.length(x).alias("n"), protected(x, i).alias("keep"))
    size = lambda rs: F.aggregate(rs, F.lit(0), lambda a, r: a + r["n"])
    c = docs.select("item_id", F.transform("paragraphs", lambda p: F.struct(F.transform(sents(p), row).alias("rows"), (F.length(p) * ratio).alias("goal"))).alias("ps"))
    c = c.withColumn("ps", F.transform("ps", lambda p: F.struct(p["rows"].alias("rows"), p["goal"].alias("goal"), size(F.filter(p["rows"], lambda r: r["keep"])).alias("fixed"))))
    # Unprotected text before a sentence only grows, so one pass finds the last one that is taken.
    begin = F.struct(F.lit(0).alias("before"), F.lit(-1).alias("last"))
    step = lambda p: lambda a, r: F.when(r["keep"], a).otherwise(F.struct((a["before"] + r["n"]).alias("before"), F.when(p["fixed"] + a["before"] < p["goal"], r["i"]).otherwise(a["last"]).alias("last")))
    c = c.withColumn("ps", F.transform("ps", lambda p: F.struct(p["rows"].alias("rows"), F.aggregate(p["rows"], begin, step(p), lambda a: a["last"]).alias("last"))))
    take = lambda p: lambda r: r["keep"] | (r["i"] <= p["last"])
    c = c.select("item_id", F.transform("ps", lambda p: F.array_join(F.transform(F.filter(p["rows"], take(p)), lambda r: r["s"]), "")).alias("ps"))
    glue = lambda a, b: F.concat(a, F.when(a.rlike(r"[A-Za-z0-9]\z") & b.rlike(r"\A[A-Za-z0-9]"), " ").otherwise(""), b)
    rest = F.aggregate(F.slice("ps", 3, F.greatest(F.size("ps"), F.lit(1))), F.trim(F.get("ps", F.lit(1))), lambda a, p: glue(a, F.trim(p)))
    one = sents(F.get("ps", F.lit(0)))
    half = F.greatest(F.lit(1), F.floor(F.size(one) / 2).cast("int"))
    split = F.array(F.array_join(F.slice(one, 1, half), ""), F.array_join(F.slice(one, half + 1, F.greatest(F.size(one), F.lit(1))), ""))
    two = F.when(F.size("ps") >= 2, F.array(F.get("ps", F.lit(0)), rest)).when(F.size(one) >= 2, split).otherwise(F.col("ps"))
    return c.select("item_id", two.alias("paragraphs"))


def _digit_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])(\d++(?:[,.]\d++(?![A-Za-z0-9]))*+)(?![A-Za-z0-9])"), F.lit(1)))


def translation_checks(source: DataFrame, target: DataFrame) -> DataFrame:
    """First rule each translated segment breaks. Both: item_id, seg, text. Segments missing on either side are errors too."""
    j = source.select("item_id", "seg", F.col("text").alias("s")).join(target.select("item_id", "seg", stripped("text").alias("d")), ["item_id", "seg"], "full")
    han, letters = F.regexp_count("d", F.lit(r"[\x{3400}-\x{9fff}]")), F.regexp_count("s", F.lit(r"[A-Za-z\x{3400}-\x{9fff}]"))
    idiom = F.when(F.col("d").rlike("两难|困境|悖论|第二十二条军规"), F.regexp_replace("s", r"(?i)\bcatch[- ]22\b", "")).otherwise(F.col("s"))
    problem = (F.when(F.col("s").isNull() | F.col("d").isNull(), "segment_mismatch").when((F.col("d") == "") | (without_stamps(F.col("d")) != F.col("d")), "empty_or_stamped")
               .when((letters > 40) & ((han < 8) | (F.length("d") < letters * 0.22)), "untranslated_or_shortened")
               .when(F.size(F.array_except(_digit_tokens(idiom), _digit_tokens(F.col("d")))) > 0, "numbers_missing"))
    return j.select("item_id", "seg", problem.alias("problem"))


# What a speaker label may look like, and the label for a speaker nobody knows.
LABEL_LINE, LABEL = r"(?m)^[ \t]*([^\n:：]{1,60})[:：]", r"^[A-Za-z\x{3400}-\x{9fff}][A-Za-z\x{3400}-\x{9fff}\d .’'-]{0,59}$"
NO_LABELS, UNKNOWN_SPEAKER = ["http", "https", "ftp"], ("未知说话人", "Unknown Speaker")


def speaker_labels(text: Column) -> Column:
    """Labels at line starts, in order."""
    found = F.transform(F.regexp_extract_all(without_stamps(text), F.lit(LABEL_LINE), F.lit(1)), stripped)
    return F.filter(found, lambda v: v.rlike(LABEL) & ~F.lower(v).isin(NO_LABELS))


def _collapsed(labels: Column) -> Column:
    """Without those that repeat the one before."""
    return F.filter(labels, lambda v, i: (i == 0) | (v != F.get(labels, i - 1)))


def speaker_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Translated segments in which speakers do not take turns as in the source. Both: item_id, seg, text. Returns item_id, seg, expected, seen.

    A translation may call a speaker by the first name if no other speaker of the item has it; other labels are no speakers.
    """
    s = source.select("item_id", "seg", speaker_labels(F.col("text")).alias("labels"))
    names = s.select("item_id", F.explode("labels").alias("name")).distinct().withColumn("first", F.substring_index("name", " ", 1))
    alone = names.groupBy("item_id", "first").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    alias = names.select("item_id", F.col("name").alias("alias"), "name").unionByName(alone.filter((F.col("n") == 1) & (F.col("first") != F.col("name"))).select("item_id", F.col("first").alias("alias"), "name"))
    alias = alias.unionByName(names.filter(F.col("name") == UNKNOWN_SPEAKER[1]).select("item_id", F.lit(UNKNOWN_SPEAKER[0]).alias("alias"), "name"))
    # A full name wins over a first name of the same form.
    alias = alias.groupBy("item_id", "alias").agg(F.max_by("name", F.col("alias") == F.col("name")).alias("name"))
    said = target.select("item_id", "seg", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(LABEL_LINE), F.lit(1)), stripped)).alias("pos", "alias"))
    heard = said.join(alias, ["item_id", "alias"]).groupBy("item_id", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("heard"))
    j = s.join(heard, ["item_id", "seg"], "left").select("item_id", "seg", _collapsed(F.col("labels")).alias("expected"), F.coalesce("heard", F.array().cast("array<string>")).alias("heard"))
    return j.select("item_id", "seg", "expected", _collapsed(F.col("heard")).alias("seen")).filter("expected <> seen")


def required_names(text: Column) -> Column:
    """Names that must survive: numbered names, the opening name, and names that claim something."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z0-9]*(?:[ -][A-Za-z0-9]+)*+)"), F.lit(1))
    opening = F.filter(F.slice(names, 1, 1), lambda n: text.startswith(n))
    owners = F.regexp_extract_all(text, F.lit(r"([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)?)\s*(?:认为|称|说|表示|主张|提醒|建议)"), F.lit(1))
    return F.array_distinct(F.concat(F.filter(names, lambda n: n.rlike(r"\d")), opening, owners))


def compression_checks(pairs: DataFrame, ratio: float = 0.4) -> DataFrame:
    """What a shortened paragraph lost or invented, as a list. pairs: item_id, source_text, short_text.

    Among the losses: a phrase clipped to its ends (verb and object without their middle), the modal of a condition, taken by the order
    of conditions in both texts, and the particle between a duration and what it qualifies in a condition.
    Nothing has the right length for an empty source.
    """
    from galleyspark.operators.rollups import OWNER, number_tokens

    s, d = F.col("source_text"), F.col("short_text")
    owners = lambda t: F.regexp_extract_all(t, F.lit(OWNER), F.lit(1))
    pairs = pairs.select("item_id", s, d, number_tokens(s).alias("sn"), number_tokens(d).alias("dn"), owners(s).alias("so"), owners(d).alias("do"), F.regexp_replace(d, BLANKS, "").alias("compact"))
    size = F.length(d) / F.nullif(F.length(s), F.lit(0))
    only = lambda t: t.rlike(r"(?<!不)仅")
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    clauses = lambda t: F.regexp_count(t, F.lit(r"(?:若|如果)[^。！？；]+"))
    heads = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"((?:若|如果)[^。！？；]+)"), F.lit(1)), lambda c: F.split(c, RESULT_WORDS)[0])
    lost_modal = F.exists(F.arrays_zip(F.slice(heads(s), 1, F.greatest(F.size(heads(d)), F.lit(1))).alias("a"), heads(d).alias("b")), lambda z: z["a"].rlike(MODAL) & ~z["b"].rlike(MODAL))
    clipped = F.transform(F.regexp_extract_all(s, F.lit(rf"((?:{CLIPPABLE})[\x{{4e00}}-\x{{9fff}}]{{2}})"), F.lit(1)), lambda p: F.concat(F.left(p, F.lit(1)), F.right(p, F.lit(1))))
    modified = F.regexp_extract_all(d, F.lit(rf"{DURATION}(?:或{DURATION})?([\x{{4e00}}-\x{{9fff}}]{{2,4}})(?=若|如果)"), F.lit(1))
    gone = F.filter(F.array_except("sn", "dn"), lambda v: v.rlike(r"\A[\x00-\x7F]*\z") | ~F.contains(F.col("compact"), v))
    rules = [
        ("length", F.coalesce(~size.between(ratio * 0.85, ratio * 1.15), F.length(s) == 0)),
        ("layout", (F.trim(d) == "") | F.contains(d, F.lit("\n")) | d.rlike(r"\A\s*(?:[-•#*]|\d+[.、)])")),
        ("connectors", F.exists(F.array(*[F.lit(c) for c in CONNECTORS]), lambda c: F.contains(s, c) & ~F.contains(d, c))),
        ("conditionals", clauses(d) < clauses(s)),
        ("conditional_result", F.exists(F.regexp_extract_all(d, F.lit(r"((?:若|如果)[^。！？；]+)"), F.lit(1)), lambda c: ~c.rlike("则|那么|才|就|，"))),
        ("conditional_modal", F.coalesce(lost_modal, F.lit(False))),
        ("duration_modifier", F.exists(modified, lambda m: ~m.startswith("的"))),
        ("clipped_phrase", F.exists(clipped, lambda c: F.contains(d, c) & ~F.contains(s, c))),
        ("numbers_missing", F.size(gone) > 0),
        ("numbers_new", F.size(F.array_except("dn", "sn")) > 0),
        ("owners", F.exists(F.array_distinct("so"), lambda o: count("do", o) < count("so", o))),
        ("names", F.exists(required_names(s), lambda n: ~F.contains(d, n))),
        ("hedges", F.exists(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.contains(s, h) & ~F.contains(d, h)) | (only(s) & ~only(d))),
    ]
    return pairs.select("item_id", F.array_join(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules])), ",").alias("problems"))


def document_structure_checks(notes: DataFrame) -> DataFrame:
    """First structural rule a reading document breaks, and the sizes its source calls for.

    notes: item_id, source_chars, speakers array<string>, core array<string>, chapters array<struct<title, turns array<struct<speaker, paragraphs array<string>>>>>.
    """
    progress = F.least(F.lit(24000), F.greatest(F.lit(0), F.col("source_chars") - 6000))
    min_core, min_ch = (4 + F.floor(progress * 6 / 24000)).cast("int"), (2 + F.floor(progress * 3 / 24000)).cast("int")
    turns = F.flatten(F.transform("chapters", lambda c: c["turns"]))
    paragraphs = F.flatten(F.transform(turns, lambda t: t["paragraphs"]))
    problem = (F.when(F.size(F.array_distinct("speakers")) < F.size("speakers"), "duplicate_speaker")
               .when(F.exists("core", lambda c: (F.trim(c) == "") | ~c.rlike(r"\A\*\*.+?\*\*")), "core_without_label")
               .when(F.exists("chapters", lambda c: F.trim(c["title"]) == ""), "empty_chapter_title")
               .when(F.exists(turns, lambda t: ~F.array_contains("speakers", t["speaker"])), "unknown_speaker")
               .when(F.exists(paragraphs, lambda p: (F.trim(p) == "") | p.rlike(r"\[\d{1,3}:\d{2}(?::\d{2})?\]")), "empty_or_stamped_paragraph")
               .when((F.size("core") < min_core) | (F.size("chapters") < min_ch), "too_small"))
    return notes.select("item_id", min_core.alias("min_core"), min_ch.alias("min_chapters"), problem.alias("problem"))


def timing_checks(segments: DataFrame, items: DataFrame) -> DataFrame:
    """Unit of the numbers, order and bounds of timed segments, and whether they cover the item.

    segments: item_id, pos, start, end (raw numbers, nullable), stamp (seconds from the readable stamp), text. items: item_id, duration, completed.
    The unit is the only one of seconds and milliseconds that agrees with every readable stamp.
    """
    from galleyspark.operators.windows import strict_coverage

    agrees = lambda f: F.bool_and(F.when(F.col("start").isNotNull(), F.abs(F.col("start") * f - F.col("stamp")) <= 1.01))
    facts = segments.groupBy("item_id").agg(
        F.bool_and(F.col("stamp").isNotNull()).alias("stamped"), F.count("start").alias("starts"), F.count("end").alias("ends"), F.count("*").alias("rows"),
        agrees(1.0).alias("sec"), agrees(0.001).alias("ms"), F.max("end").alias("max_end"))
    scale = F.when(~F.col("stamped"), None).when(F.col("starts") == 0, F.when(F.col("ends") == 0, 1.0)).when(F.col("sec") & ~F.col("ms"), 1.0).when(F.col("ms") & ~F.col("sec"), 0.001)
    f = facts.join(items, "item_id").withColumn("scale", scale)
    d, tol = F.col("duration"), F.greatest(F.lit(30.0), F.col("duration") * 0.01)
    timed = F.col("ends") == F.col("rows")
    final = F.col("max_end") * F.col("scale")
    over = timed & (final > d + tol)
    f = f.select("item_id", "scale", timed.alias("timed"), F.coalesce(over & ((final > d * 1.05) | ~F.col("completed")), F.lit(False)).alias("overrun"),
                 F.when(over, final).otherwise(d).alias("limit"), F.when(over, F.lit(0.0)).otherwise(tol).alias("tol"))
    rows = segments.join(f.filter("scale is not null"), "item_id").select(
        "item_id", "pos", F.floor(F.col("pos") / BLOCK).alias("blk"), F.when(F.col("start").isNull(), F.col("stamp")).otherwise(F.col("start") * F.col("scale")).alias("at"), (F.col("end") * F.col("scale")).alias("to"), "text", "limit", "tol", "timed")
    seen = prefix_scan(rows, ["item_id"], ["blk"], ["pos"], prev=Running("last", "at", before=True))
    bad = ((stripped("text") == "") | F.col("at").isNull() | (F.col("at") < 0) | (F.col("at") > F.col("limit") + F.col("tol")) | (F.col("at") < F.coalesce("prev", "at"))
           | (F.col("to").isNotNull() & ((F.col("to") <= F.col("at")) | (F.col("to") > F.col("limit") + F.col("tol")))))
    gap = F.col("at") - F.col("prev")
    r = seen.groupBy("item_id").agg(F.count_if(bad).alias("bad_rows"), F.min_by("at", "pos").alias("first_at"), F.max_by("at", "pos").alias("last_at"), F.bool_and(F.coalesce((gap > 0) & (gap <= 60), F.lit(True))).alias("dense"))
    cover = strict_coverage(rows.filter("timed").select("item_id", F.col("at").alias("start"), F.col("to").alias("end"), F.col("limit").alias("duration"))).select("item_id", F.col("complete").alias("covered"))
    j = f.join(r, "item_id", "left").join(cover, "item_id", "left")
    by_starts = (F.col("first_at") <= 30) & (F.col("last_at") >= F.col("limit") - 45) & F.col("dense")
    ok = F.col("scale").isNotNull() & ~F.col("overrun") & (F.col("bad_rows") == 0) & F.when(F.col("timed"), F.coalesce("covered", F.lit(False))).otherwise(by_starts)
    return j.select("item_id", "scale", "overrun", F.coalesce("bad_rows", F.lit(0).cast("long")).alias("bad_rows"), F.coalesce(ok, F.lit(False)).alias("complete"))
