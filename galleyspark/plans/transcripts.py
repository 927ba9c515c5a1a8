"""Section 2.8 jobs, and the line jobs of 2.5, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyspark.functions.text import BLANKS
from galleyspark.functions import arrow
from galleyspark.operators import transcripts as ops
from galleyspark.plans import bindings as b
from galleyspark.plans.registry import job


def docs(t):
    return t.documents.select(F.col("doc_id").alias("item_id"), "text")


_SEPS = ["chr(10)||chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'. '", "'! '", "'? '", "'; '"]
_CUT = "coalesce(" + ", ".join(f"CASE WHEN strpos(reverse(seg), reverse({s})) > 0 THEN 1200 + length(seg) - strpos(reverse(seg), reverse({s})) + 1 END" for s in _SEPS) + ", 2200)"


@job("chunk_citations", f"""WITH RECURSIVE c AS (SELECT doc_id, text AS rest, 0 AS n, CAST(NULL AS VARCHAR) AS piece FROM documents UNION ALL
 SELECT doc_id, substr(rest, cut+1), n+1, substr(rest, 1, cut) FROM (SELECT doc_id, rest, n, CASE WHEN length(rest) <= 2200 THEN length(rest) ELSE {_CUT} END AS cut FROM (SELECT *, substr(rest,1201,1000) AS seg FROM c WHERE length(rest)>0)))
SELECT doc_id AS item_id, 'C' || lpad(CAST(n AS VARCHAR),4,'0') AS chunk_id, n-1 AS pos, length(piece) AS chars, sha256(piece) AS sha FROM c WHERE n>0""")
def chunk_citations(t):
    return ops.chunk_citations(docs(t)).select("item_id", "chunk_id", "pos", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


@job("chunk_evidence", """WITH RECURSIVE c AS (SELECT doc_id, text AS rest, 0 AS n, CAST(NULL AS VARCHAR) AS piece FROM documents UNION ALL
 SELECT doc_id, substr(rest, cut+1), n+1, substr(rest, 1, cut) FROM (SELECT doc_id, rest, n, CASE WHEN length(rest) <= 450 THEN length(rest) WHEN strpos(reverse(substr(rest,201,250)),' ')>0 THEN 200 + 250 - strpos(reverse(substr(rest,201,250)),' ') + 1 ELSE 450 END AS cut FROM c WHERE length(rest)>0))
SELECT doc_id AS item_id, n-1 AS pos, length(piece) AS chars, sha256(piece) AS sha FROM c WHERE n>0""")
def chunk_evidence(t):
    return ops.chunk_evidence(docs(t)).select("item_id", "pos", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


@job("chunk_translation", f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\\s\\x{{a0}}]+', ''), '[\\s\\x{{a0}}]+$', '') AS text FROM documents),
c AS (SELECT doc_id, text AS rest, 0 AS n, CAST(NULL AS VARCHAR) AS piece FROM d UNION ALL
 SELECT doc_id, substr(rest, cut+1), n+1, substr(rest,1,cut) FROM (SELECT doc_id, rest, n, CASE WHEN length(rest)<=1200 THEN length(rest) WHEN m > 600 THEN m ELSE 1200 END AS cut FROM (SELECT *,
  greatest({", ".join(f"CASE WHEN strpos(reverse(substr(rest,1,1200)), reverse({s}))>0 THEN 1200 - strpos(reverse(substr(rest,1,1200)), reverse({s})) - length({s}) + 2 ELSE 0 END + 1 - 1" for s in ("chr(10)", "'. '", "'。'", "'? '", "'! '"))}) AS m FROM c WHERE length(rest)>0)))
SELECT doc_id AS item_id, count(*) AS segments, CAST(sum(length(piece)) AS BIGINT) AS chars, sha256(string_agg(piece,'' ORDER BY n)) AS sha FROM c WHERE n>0 AND trim(piece, ' ' || chr(10) || chr(9)) <> '' GROUP BY 1""")
def chunk_translation(t):
    # Clock stamps in front of the first line of each text must leave no trace.
    stamped = t.documents.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("[00:00] "), "text", F.lit(" (01:02:03)")).alias("text"))
    c = ops.chunk_translation(stamped)
    return c.groupBy("item_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).cast("long").alias("chars"),
                                    F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), ""), 256).alias("sha"))


STAMPED = """st AS (SELECT doc_id, array_to_string(list_transform(string_split(text,chr(10)), lambda x, i: '[' || lpad(CAST(i//60 AS VARCHAR),2,'0') || ':' || lpad(CAST(i%60 AS VARCHAR),2,'0') || '] ' || (CASE WHEN (i//2)%2=0 THEN 'Ada: ' WHEN i%7=0 THEN '' ELSE 'Ben: ' END) || x), chr(10)) AS text FROM documents)"""


def stamped_docs(t):
    """documents with a stamp before each line and two alternating speakers; a few lines name nobody."""
    def line(x, i):
        k = i + 1
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        who = F.when(F.floor(k / 2) % 2 == 0, "Ada: ").when(k % 7 == 0, "").otherwise("Ben: ")
        return F.concat(F.lit("["), two(F.floor(k / 60)), F.lit(":"), two(k % 60), F.lit("] "), who, x)
    return t.documents.select(F.col("doc_id").alias("item_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@job("speaker_units", rf"""WITH {STAMPED}, l AS (SELECT doc_id, string_split(text,chr(10)) AS p, unnest(range(1,len(string_split(text,chr(10)))+1)) AS i FROM st),
x AS (SELECT doc_id, i, p[i] || CASE WHEN i < len(p) THEN chr(10) ELSE '' END AS body, trim(regexp_extract(p[i], '^\[\d{{1,3}}:\d{{2}}(?::\d{{2}})?\]\s*([^:\n：]{{1,80}})[:：]', 1)) AS who FROM l),
s AS (SELECT *, CASE WHEN who<>'' AND who = lag(who) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS st FROM x), g AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS island FROM s),
u AS (SELECT doc_id, island, string_agg(body,'' ORDER BY i) AS text FROM g GROUP BY 1,2), k AS (SELECT doc_id, island, text, unnest(range(0, (length(text)-1)//2400+1)) AS part FROM u)
SELECT doc_id AS item_id, island, CAST(part AS INTEGER) AS part, sha256(substr(text, part*2400+1, 2400)) AS sha FROM k""")
def speaker_units(t):
    return ops.speaker_units(stamped_docs(t)).select("item_id", "island", "part", F.sha2("text", 256).alias("sha"))


@job("time_anchor", r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn%2=1 THEN text ELSE text || ' [0' || turn || ':10] and [0' || turn || ':45]' END AS text FROM conversations),
f AS (SELECT *, regexp_extract_all(text,'\[(\d{1,3}:\d{2}(?::\d{2})?)\]',1) AS st FROM c)
SELECT conv_id AS item_id, turn AS pos, coalesce(st[1], last_value(st[-1] IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS time FROM f""")
def time_anchor(t):
    text = F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" [0"), "turn", F.lit(":10] and [0"), "turn", F.lit(":45]")))
    return ops.time_anchor(t.conversations.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"), F.floor(F.col("turn") / 256).alias("blk"), text.alias("text")))


@job("transcript_lines", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,'[\x{feff}\x{200b}]','','g'),'\x{a0}',' ','g'),chr(10)), lambda x: trim(regexp_replace(regexp_replace(x,'^\s+',''),'\s+$',''))), lambda x: x<>'') AS p FROM documents)
SELECT doc_id AS item_id, CAST(i-1 AS INTEGER) AS pos, p[i] AS line FROM (SELECT *, unnest(range(1,len(p)+1)) AS i FROM l)""")
def transcript_lines(t):
    return ops.transcript_lines(docs(t)).select("item_id", "pos", "line")


CAPTIONED = """lines AS (SELECT doc_id, list_filter(list_transform(string_split(text,chr(10)), lambda x: trim(x)), lambda x: x<>'') AS p FROM documents)"""


@job("caption_lines", f"""WITH {CAPTIONED} SELECT doc_id AS item_id, CAST(i-1 AS INTEGER) AS pos, p[i] AS line FROM (SELECT *, unnest(range(1,len(p)+1)) AS i FROM lines)""")
def caption_lines(t):
    """documents wrapped as caption files with headers, notes, cue ids and timings; the payload must come back."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cue = lambda x, i: F.concat(F.when(i % 3 == 0, F.concat(F.lit("cue-"), i, F.lit("\n"))).otherwise(""), F.lit("00:00:01.000 --> 00:00:02.500 align:start\n"), x, F.lit("\n"))
    text = F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: en\n\nNOTE made by hand\nsecond note line\n\nSTYLE\n::cue { color: red }\n\n"), F.array_join(F.transform(lines, cue), "\n"))
    return ops.transcript_lines(t.documents.select(F.col("doc_id").alias("item_id"), text.alias("text"))).select("item_id", "pos", "line")


def spoken(t):
    """conversations as transcripts: a label at each turn, and now and then a stage direction, a marker, a heading or a filler."""
    k = F.length("text") % 9
    lead = F.when(k == 0, "[Music]\n").when(k == 1, "(inaudible)\n").when(k == 2, "PART TWO\n").when(k == 3, "Um, uh\n").otherwise("")
    body = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", "[\n:：\\[\\]]", " "), F.when(k == 4, "\n[Guest Two] Uh.").otherwise(""))
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.concat(lead, body).alias("text"))


SPOKEN = """sp AS (SELECT conv_id*100+turn AS item_id, length(text)%9 AS k, upper(role[1]) || role[2:] AS who, trim(regexp_replace(text,'[\n:：\\[\\]]',' ','g')) AS body FROM conversations),
bl AS (SELECT item_id, k, 0 AS pos, CASE k WHEN 0 THEN 'stage' WHEN 1 THEN 'marker' WHEN 2 THEN 'heading' WHEN 3 THEN 'text' END AS kind, '' AS speaker, CASE k WHEN 0 THEN '[Music]' WHEN 1 THEN '(inaudible)' WHEN 2 THEN 'PART TWO' WHEN 3 THEN 'Um, uh' END AS text FROM sp WHERE k<4
 UNION ALL SELECT item_id, k, CASE WHEN k<4 THEN 1 ELSE 0 END, 'speech', who, body FROM sp WHERE body<>'' UNION ALL SELECT item_id, k, 1, 'speech', 'Guest Two', 'Uh.' FROM sp WHERE k=4)"""


@job("classify_blocks", f"WITH {SPOKEN} SELECT item_id, pos, kind, speaker, text FROM bl")
def classify_blocks(t):
    return ops.classify_blocks(ops.transcript_lines(spoken(t))).select("item_id", "pos", "kind", "speaker", "text")


@job("drop_fillers", f"WITH {SPOKEN} SELECT item_id, pos, kind FROM bl WHERE NOT (kind='speech' AND text='Uh.')")
def drop_fillers(t):
    return ops.drop_fillers(ops.classify_blocks(ops.transcript_lines(spoken(t)))).select("item_id", "pos", "kind")


@job("drop_caption_repeats", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text,'[\x{feff}\x{200b}]','','g'),'\x{a0}',' ','g'),chr(10)), lambda x: trim(x)), lambda x: x<>'') AS p FROM documents),
x AS (SELECT doc_id AS item_id, CAST(i-1 AS INTEGER) AS pos, translate(replace(lower(trim(regexp_replace(p[i],'\s+',' ','g'))),'ß','ss'),'ς','σ') AS f FROM (SELECT *, unnest(range(1,len(p)+1)) AS i FROM l)),
g AS (SELECT *, lag(f) OVER (PARTITION BY item_id ORDER BY pos) AS prev FROM x) SELECT item_id, pos FROM g WHERE prev IS NULL OR prev<>f""")
def drop_caption_repeats(t):
    lines = ops.transcript_lines(docs(t)).select("item_id", "blk", "pos", F.lit("text").alias("kind"), F.lit("").alias("speaker"), F.col("line").alias("text"))
    return ops.drop_caption_repeats(lines).select("item_id", "pos")


# An invented sponsor read in five blocks; only its evidence sentence may stay.
AD = ["And now a quick word from our sponsor Acmeware for this hour.", "Acmeware builds tools you will like.", "Users told us it works.", "Go to acmeware.com and sign up today.", "Back in the studio we talk on."]


def with_ads(t):
    """Each document's first line, a sponsor read in two of three documents, and the first line again; a read without an end stays."""
    d = F.col("doc_id")
    line = F.concat(F.lit("Topic "), d)
    read = F.when(d % 3 == 0, F.array(*[F.lit(x) for x in AD])).when(d % 3 == 1, F.array(*[F.lit(x) for x in AD[:2]])).otherwise(F.array().cast("array<string>"))
    rows = F.concat(F.transform(F.split("text", "\n"), lambda x, i: F.concat(line, F.lit(" line "), i)), read, F.array(F.concat(line, F.lit(" end"))))
    return t.documents.select(d.alias("item_id"), F.posexplode(rows).alias("pos", "text")).select(
        "item_id", F.floor(F.col("pos") / ops.BLOCK).alias("blk"), "pos", F.lit("speech").alias("kind"), F.lit("Ada").alias("speaker"), "text")


@job("remove_ads", """WITH n AS (SELECT doc_id, len(string_split(text,chr(10))) AS n FROM documents), r AS (SELECT doc_id, n, unnest(range(0,n)) AS pos FROM n)
SELECT doc_id AS item_id, CAST(pos AS INTEGER) AS pos, 'Topic ' || doc_id || ' line ' || pos AS text FROM r UNION ALL
SELECT doc_id, CAST(n+2 AS INTEGER), 'Users told us it works.' FROM n WHERE doc_id%3=0 UNION ALL SELECT doc_id, CAST(n+4 AS INTEGER), 'Back in the studio we talk on.' FROM n WHERE doc_id%3=0 UNION ALL
SELECT doc_id, CAST(n AS INTEGER), 'And now a quick word from our sponsor Acmeware for this hour.' FROM n WHERE doc_id%3=1 UNION ALL SELECT doc_id, CAST(n+1 AS INTEGER), 'Acmeware builds tools you will like.' FROM n WHERE doc_id%3=1 UNION ALL
SELECT doc_id, CAST(n + CASE doc_id%3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS INTEGER), 'Topic ' || doc_id || ' end' FROM n UNION ALL SELECT doc_id, CAST(n AS INTEGER), 'And now' FROM n WHERE doc_id%3=0""")
def remove_ads(t):
    return ops.remove_ads(with_ads(t)).filter("kind not in ('boundary', 'gone')").select("item_id", "pos", "text")


@job("drop_edge_promos", """WITH n AS (SELECT doc_id, len(string_split(text,chr(10))) AS n FROM documents), r AS (SELECT doc_id, n, unnest(range(0,n)) AS pos FROM n)
SELECT doc_id AS item_id, CAST(pos+1 AS INTEGER) AS pos, 'Topic ' || doc_id || ' line ' || pos AS text FROM r UNION ALL SELECT doc_id, CAST(n+1 AS INTEGER), 'It was good. See the notes.' FROM n UNION ALL SELECT doc_id, CAST(n+2 AS INTEGER), 'Okay then.' FROM n WHERE doc_id%2=1""")
def drop_edge_promos(t):
    d = F.col("doc_id")
    rows = F.concat(F.array(F.lit("Join the Slack at a.com and get the companion pdf at b.io today")), F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Topic "), d, F.lit(" line "), i)),
                    F.array(F.lit("It was good. Thanks for listening! See the notes.")),
                    F.array(F.when(d % 2 == 1, "Okay then. A huge thank you to our partners a.com and b.ai").otherwise("Okay, a huge thank you to our partners a.com and b.ai")))
    blocks = t.documents.select(d.alias("item_id"), F.posexplode(rows).alias("pos", "text")).select("item_id", F.floor(F.col("pos") / ops.BLOCK).alias("blk"), "pos", F.lit(0).alias("sub"), F.lit("speech").alias("kind"), F.lit("Ada").alias("speaker"), "text")
    return ops.drop_edge_promos(blocks).filter("kind <> 'boundary'").select("item_id", "pos", "text")


@job("clean_transcripts", f"""WITH {SPOKEN} SELECT item_id, CAST(count(*) FILTER (WHERE kind='stage') AS BIGINT) AS stages, CAST(count(*) FILTER (WHERE text='Uh.') AS BIGINT) AS fillers,
 string_agg(trim(regexp_replace(CASE WHEN text='Uh.' THEN NULL ELSE text END,'\\s+',' ','g')), '|' ORDER BY pos) FILTER (WHERE kind<>'stage') AS text FROM bl GROUP BY 1""")
def clean_transcripts(t):
    c = ops.clean_transcripts(spoken(t).withColumn("is_caption", F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("island", "text")))
    return c.groupBy("item_id", "stages", "fillers").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "|").alias("text"))


@job("merge_rolling_captions", r"""WITH f AS (SELECT doc_id AS item_id, trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS flat FROM documents),
w AS (SELECT item_id, string_split(flat,' ') AS p, unnest(range(1,len(string_split(flat,' '))+1)) AS i FROM f) SELECT item_id, CAST(sum(length(p[i] || '-' || (i-1))+1)-1 AS INTEGER) AS chars, sha256(string_agg(p[i] || '-' || (i-1),' ' ORDER BY i)) AS sha FROM w GROUP BY 1""")
def merge_rolling_captions(t):
    """documents as rolling captions: windows of 15 words every 10 words. Words carry their number, so only true overlaps agree."""
    d = t.documents.select(F.col("doc_id").alias("item_id"), F.split(F.trim(F.regexp_replace("text", BLANKS, " ")), " ").alias("words"))
    d = d.select("item_id", F.transform("words", lambda w, i: F.concat(w, F.lit("-"), i)).alias("words"))
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 10).cast("int")), lambda i: F.array_join(F.slice("words", i * 10 + 1, 15), " "))
    return ops.merge_rolling_captions(d.select("item_id", windows.alias("chunks"))).select("item_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@job("pack_batches", """WITH RECURSIVE u AS (SELECT doc_id, i-1 AS pos, length(p[i]) AS chars FROM (SELECT doc_id, string_split(text,chr(10)) AS p, unnest(range(1,len(string_split(text,chr(10)))+1)) AS i FROM documents)),
w AS (SELECT doc_id, pos, chars, 0 AS batch, 1 AS n, chars AS used FROM u WHERE pos=0 UNION ALL
 SELECT u.doc_id, u.pos, u.chars, CASE WHEN w.n>=5 OR w.used+u.chars>3000 THEN w.batch+1 ELSE w.batch END, CASE WHEN w.n>=5 OR w.used+u.chars>3000 THEN 1 ELSE w.n+1 END, CASE WHEN w.n>=5 OR w.used+u.chars>3000 THEN u.chars ELSE w.used+u.chars END
 FROM w JOIN u ON u.doc_id=w.doc_id AND u.pos=w.pos+1)
SELECT doc_id AS item_id, CAST(pos AS INTEGER) AS pos, CAST(chars AS INTEGER) AS chars, CAST(batch AS INTEGER) AS batch FROM w""")
def pack_batches(t):
    return ops.pack_batches(t.documents.select(F.col("doc_id").alias("item_id"), F.split("text", "\n").alias("units")))


def chinese_like(t):
    """documents with their sentence ends written as full-width stops, as two to three paragraphs."""
    text = F.regexp_replace(F.regexp_replace("text", r"\. ?", "。"), r"\n", "")
    n = F.length(text)
    third = F.greatest(F.floor(n / 3).cast("int"), F.lit(1))
    paras = F.when(F.col("doc_id") % 3 == 0, F.array(text)).when(F.col("doc_id") % 3 == 1, F.array(F.substring(text, F.lit(1), third), F.substring(text, third + 1, n))).otherwise(
        F.array(F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, third * 2 + 1, n)))
    return t.documents.select(F.col("doc_id").alias("item_id"), paras.alias("paragraphs"))


@job("extractive_compact")
def extractive_compact(t):
    d = ops.extractive_compact(chinese_like(t))
    return d.select("item_id", F.size("paragraphs").alias("paragraphs"), F.length(F.array_join("paragraphs", "")).alias("chars"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("sha"))


@job("compression_checks")
def compression_checks(t):
    src = chinese_like(t).select("item_id", F.array_join("paragraphs", "").alias("source_text"))
    return ops.compression_checks(src.join(ops.extractive_compact(chinese_like(t)).select("item_id", F.array_join("paragraphs", "").alias("short_text")), "item_id"))


@job("translation_checks", """SELECT conv_id*100 + turn AS item_id, CAST(0 AS INTEGER) AS seg, CASE WHEN turn%5=1 THEN 'segment_mismatch' WHEN turn%5=2 THEN 'empty_or_stamped' WHEN turn%5=3 AND len(regexp_extract_all(text,'[A-Za-z]'))>40 THEN 'untranslated_or_shortened' WHEN turn%5=4 THEN 'numbers_missing' END AS problem FROM conversations""")
def translation_checks(t):
    """Turns with numbers as sources, which the translations keep, lose or spell out; those that stay untranslated get no letters beside their own."""
    k = F.col("turn") % 5
    key = F.struct("conv_id", "turn").alias("item_id")
    letters = F.regexp_replace("text", r"[0-9\x{3400}-\x{9fff}]", "")
    src = t.conversations.select(key, F.lit(0).alias("seg"), F.concat(letters, F.when(k == 3, " 17, 3,5").otherwise(" 17 or 3,5 Catch-22")).alias("text"))
    good = F.concat(F.repeat(F.lit("译文内容"), F.length("text")), F.lit(" 17 和 3,5，两难"))
    out = F.when(k == 2, F.concat(F.lit("[01:02] "), good)).when(k == 3, "译文 17 3,5 两难").when(k == 4, F.replace(good, F.lit("17"), F.lit("十七"))).otherwise(good)
    dst = t.conversations.filter(k != 1).select(key, F.lit(0).alias("seg"), out.alias("text"))
    return ops.translation_checks(src, dst).select((F.col("item_id.conv_id") * 100 + F.col("item_id.turn")).alias("item_id"), "seg", "problem")


@job("document_structure_checks", """SELECT doc_id AS item_id, CAST(4 + floor(least(24000, greatest(0, n_chars-6000))*6/24000) AS INTEGER) AS min_core, CAST(2 + floor(least(24000, greatest(0, n_chars-6000))*3/24000) AS INTEGER) AS min_chapters,
 CASE doc_id%7 WHEN 0 THEN 'duplicate_speaker' WHEN 1 THEN 'core_without_label' WHEN 2 THEN 'empty_chapter_title' WHEN 3 THEN 'unknown_speaker' WHEN 4 THEN 'empty_or_stamped_paragraph' ELSE CASE WHEN 4 + floor(least(24000, greatest(0, n_chars-6000))*6/24000) > 6 OR 2 + floor(least(24000, greatest(0, n_chars-6000))*3/24000) > 3 THEN 'too_small' END END AS problem FROM documents""")
def document_structure_checks(t):
    k = F.col("doc_id") % 7
    turn = F.struct(F.when(k == 3, "Cy").otherwise("Ada").alias("speaker"), F.array(F.when(k == 4, F.concat(F.lit("at [00:10] "), "text")).otherwise(F.concat(F.lit("- "), "text"))).alias("paragraphs"))
    chapter = F.struct(F.when(k == 2, " ").otherwise("Chapter").alias("title"), F.array(turn).alias("turns"))
    notes = t.documents.select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("source_chars"), F.when(k == 0, F.array(F.lit("Ada"), F.lit("Ada"))).otherwise(F.array(F.lit("Ada"), F.lit("Ben"))).alias("speakers"),
                               F.array_repeat(F.when(k == 1, "no label").otherwise("**Label** text"), 6).alias("core"), F.array_repeat(chapter, 3).alias("chapters"))
    return ops.document_structure_checks(notes)


@job("timing_checks", f"""WITH {b.SEGMENTS}, c AS (SELECT item_id, count(*) AS n, max(end_s) AS top, max(n) FILTER (WHERE event_type='error') AS e FROM segments GROUP BY 1)
SELECT item_id, CASE WHEN item_id%5=4 THEN NULL WHEN item_id%2=0 THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END AS scale, item_id%5<>4 AND FALSE AS overrun FROM c""")
def timing_checks(t):
    seg = b.segments(t)
    item = F.col("item_id")
    unit = F.when(item % 2 == 0, 1.0).otherwise(1000.0)
    raw = seg.select("item_id", F.col("n").alias("pos"), (F.col("start") * unit).alias("start"), F.when(item % 3 != 0, F.least(F.col("end"), F.col("start") + 60.0) * unit).alias("end"),
                     (F.floor("start") + F.when((item % 5 == 4) & (F.col("n") == 2), 30).otherwise(0)).cast("double").alias("stamp"), F.concat(F.lit("said "), "event_id").alias("text"))
    dur = seg.groupBy("item_id").agg((F.max("start") + 40.0).alias("duration"), F.lit(True).alias("completed"))
    return ops.timing_checks(raw, dur).select("item_id", "scale", "overrun")


@job("speaker_mismatches", """SELECT conv_id AS item_id, turn AS seg, 'Ada Lovelace|Ben Ray' AS expected, CASE turn%4 WHEN 1 THEN 'Ben Ray|Ada Lovelace' ELSE 'Ada Lovelace' END AS seen FROM conversations WHERE turn%4 IN (1,2)""")
def speaker_mismatches(t):
    """conversations -> segments of two speakers, and translations that call them by first or full names, swap them or lose one."""
    body, k = F.regexp_replace("text", r"[\n:：]", " "), F.col("turn") % 4
    said = lambda *labels: F.concat(*[x for n, label in enumerate(labels) for x in (F.lit(("\n" if n else "") + label + ": "), body)])
    short = F.when(k == 0, said("Ada", "Ben")).when(k == 1, said("Ben", "Ada")).when(k == 2, said("Ada")).otherwise(said("Ada Lovelace", "note", "Ben Ray", "Ben"))
    key = (F.col("conv_id").alias("item_id"), F.col("turn").alias("seg"))
    found = ops.speaker_mismatches(t.conversations.select(*key, said("Ada Lovelace", "Ben Ray", "Ben Ray").alias("text")), t.conversations.select(*key, short.alias("text")))
    return found.select("item_id", "seg", F.array_join("expected", "|").alias("expected"), F.array_join("seen", "|").alias("seen"))
