"""Patterns in texts, the inverted index, patterns under load, compression rules and transcript gates."""

import random
import re

import pytest
from pyspark.sql import functions as F

from galleyspark.operators import containment, editorial, evidence, ranking, transcripts
from galleyspark.sources import feeds, pages


def texts_and_patterns(rng):
    alphabet = ["a", "b", " ", "é", "公", "司", "1"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for i in range(80)}
    patterns = {"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 4))).strip() for _ in range(60)} | {t[3:14].strip() for t in list(texts.values())[:20]}
    return texts | {900: None}, {p for p in patterns if len(p) >= 2} | {"a", ""}


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("limit", [10**6, 0])
def test_contained_equals_loop(spark, whole, limit):
    texts, patterns = texts_and_patterns(random.Random(4))
    want = set()
    for i, body in texts.items():
        for p in patterns:
            found = re.findall(f"(?={re.escape(p)})" if not whole else rf"(?<![a-z0-9])(?={re.escape(p)}(?![a-z0-9]))", body or "")
            if len(p) >= 2 and found:
                want.add((i, p, len(found)))
    got = containment.contained(spark.createDataFrame(list(texts.items()), "item_id long, body string"), spark.createDataFrame([(p,) for p in patterns] * 2, "pattern string"), whole, limit)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_names_of_another_script_form_no_pairs_of_everything(spark):
    rng = random.Random(1)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(n))
    names = {i: han(3) for i in range(100)}
    docs = {i: han(40) + (names[i % 100] if i % 7 == 0 else "") + han(5) for i in range(2000)}
    found = editorial.focus_mentions(spark.createDataFrame(list(docs.items()), "item_id long, text string"), spark.createDataFrame(list(names.items()), "focus_id long, name string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    assert {tuple(r) for r in found.collect()} == {(i, k) for i, t in docs.items() for k, n in names.items() if n in t}


def test_quotes_are_found_in_any_document(spark):
    docs = spark.createDataFrame([(1, "He said:  Markets\nwill clear eventually."), (2, "nothing"), (3, "WILL CLEAR EVENTUALLY")], "item_id long, text string")
    quotes = spark.createDataFrame([(1, "will clear Eventually"), (2, "short"), (3, "not in any of them")], "quote_id long, text string")
    assert {tuple(r) for r in evidence.quote_sources(quotes, docs).collect()} == {(1, 1), (1, 3)}


def test_search_of_many_queries_equals_loop(spark):
    rng = random.Random(6)
    words = ["ation", "nation", "the", "a", "公司", "公司法", "42", "ab", "abab", "ababab"]
    chunks = {f"C{i:03}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for i in range(60)} | {"C900": None}
    queries = {f"q{i}": " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for i in range(300)} | {"none": "?!", "rare": "zzz", "one": "司"}
    index = ranking.chunk_index(spark.createDataFrame(list(chunks.items()), "chunk_id string, text string"))
    found = ranking.search_chunks(index, spark.createDataFrame(list(queries.items()), "query_id string, query string"), top=5)
    want = set()
    for q, text in queries.items():
        terms = re.findall(r"[a-z0-9]+|[㐀-鿿]{2,}", text)
        scores = sorted(((-sum(min((c or "").count(w), 5) for w in terms), i) for i, c in chunks.items()))
        hits = [(i, -s) for s, i in scores if s]
        want |= {(q, i, s, place + 1, len(hits)) for place, (i, s) in enumerate(hits[:5])}
    assert {(r.query_id, r.chunk_id, r.score, r.place, r.matching) for r in found.collect()} == want


MB = 1_000_000


def test_worst_repeats_do_not_stop_the_session(spark):
    """A megabyte of what a pattern repeats: results as of a plain loop."""
    numbers = ",".join(["12"] * (MB // 3))
    row = spark.range(1).select(transcripts._digit_tokens(F.lit("x " + numbers)).alias("n"), transcripts._digit_tokens(F.lit("1,2,3a 4.5b 6")).alias("m")).first()
    assert row.n == [numbers] and row.m == ["1,2", "4", "6"]
    cue = "00:01.000 --> 00:02.000\n" + "line\n" * (MB // 5) + "\n00:03.000 --> 00:04.000\nlast"
    raw = spark.createDataFrame([(1, "vtt", "WEBVTT\n\n" + cue, 9.0)], "item_id int, format string, body string, duration double")
    got = sorted(feeds.parse_caption_cues(raw).collect(), key=lambda r: r.pos)
    assert [(r.start, r.end) for r in got] == [(1.0, 2.0), (3.0, 4.0)] and got[0].text == " ".join(["line"] * (MB // 5))


def problems(spark, source, short):
    return set(transcripts.compression_checks(spark.createDataFrame([(1, source, short)], "item_id int, source_text string, short_text string"), 0.9).first().problems.split(","))


def test_compression_loses_no_condition_and_clips_no_phrase(spark):
    assert "clipped_phrase" in problems(spark, "团队需要降低成本。", "团队需要降本。") and "clipped_phrase" in problems(spark, "团队需要提高质量。", "团队需要提量。")
    assert "clipped_phrase" not in problems(spark, "团队需要提高质量。", "团队能提高质量。")
    assert "clipped_phrase" not in problems(spark, "降本即降低成本。", "降本即可。")
    modal = "conditional_modal"
    assert modal in problems(spark, "测试若能降低风险则合理。", "测试若降低风险则合理。") and modal not in problems(spark, "测试若能降低风险则合理。", "测试若能减风险则合理。")
    assert modal not in problems(spark, "若能力提高则合理。", "若提高则合理。") and modal not in problems(spark, "若降低风险，就能完成。", "若降低风险，则完成。")
    assert modal in problems(spark, "若甲则乙。如果能丙就丁。", "若甲则乙。如果丙就丁。")
    assert "connectors" in problems(spark, "测试若能降低风险则合理。", "测试能降低风险则合理。") and "conditional_result" in problems(spark, "测试若能降低风险则合理。", "测试若降低风险合理。")
    assert "duration_modifier" in problems(spark, "在两到四天的等待若出现则停。", "两天或四天等待若出现则停。") and "duration_modifier" not in problems(spark, "在四天的等待若出现则停。", "四天的等待若出现则停。")


def test_transcripts_pass_the_gates_of_their_layout(spark):
    schema = "page_id int, layout string, text string, n_blocks int, speakers int, labelled int, first_label int, last_label int, blocked boolean, names array<string>, first_time int, last_time int"
    words = lambda n: "word " * n
    host = ["david senra", "guest"]
    rows = [(1, "article", words(9000), 9, 2, 0, None, None, False, [], 100, 3500), (2, "article", words(9000), 9, 2, 0, None, None, False, [], 500, 3500), (3, "article", words(900), 9, 2, 0, None, None, False, [], None, None),
            (4, "article", words(20000), 9, 2, 0, None, None, False, [], None, None), (5, "heading", words(3000), 9, 0, 0, None, None, False, [], 10, 3000), (6, "heading", words(3000), 9, 0, 0, None, None, False, [], 10, 2000),
            (7, "heading", words(1000), 9, 0, 0, None, None, False, [], None, None), (8, "heading", words(3000), 9, 0, 0, None, None, True, [], None, None), (9, "wrapper", words(4000), 40, 2, 10, 1, 38, False, host, None, None),
            (10, "wrapper", words(9000), 40, 2, 10, 1, 20, False, host, None, None), (11, "wrapper", words(9000), 40, 2, 10, 1, 38, False, ["a", "b"], None, None), (12, "wrapper", words(2000), 40, 2, 10, 1, 38, False, host, None, None),
            (13, "anchor", words(9000), 5, 2, 0, None, None, False, [], None, None), (14, "anchor", words(9000), 5, 1, 0, None, None, False, [], None, None), (15, "anchor", words(9000), 5, 2, 0, None, None, False, [], None, None), (16, "heading", "", 0, 0, 0, None, None, False, [], None, None)]
    items = spark.createDataFrame([(i, None if i in (9, 12, 15) else 3600.0) for i in range(1, 17)], "page_id int, duration double")
    got = {r.page_id: r.problem for r in pages.accept_publisher_transcripts(spark.createDataFrame(rows, schema), items).collect()}
    assert got == {1: None, 2: "stamps_off", 3: "too_short", 4: "pace", 5: None, 6: "stamps_off", 7: "too_short", 8: "blocked", 9: None, 10: "labels_not_spread", 11: "no_host", 12: "too_short",
                   13: None, 14: "few_speakers", 15: "no_duration", 16: "no_transcript"}


def test_show_notes_give_the_stamps_of_an_article(spark):
    html = '<div class="show-notes-container"><p>[00:59:30] end</p><ul><li>(1:10) start</li></ul></div><div class="transcript__content"><h2>Part 9:99</h2><p>Ada 3:33 hi</p></div>'
    got = pages.extract_publisher_transcripts(spark.createDataFrame([(1, "article", html)], "page_id int, layout string, html string")).first()
    assert (got.first_time, got.last_time, got.text) == (70, 3570, "Part 9:99\nAda 3:33 hi")


def test_whole_texts_reach_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("some words of a text").alias("body"))
    patterns = spark.createDataFrame([("words of",)], "pattern string")
    assert containment.contained(texts, patterns).count() == 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= containment.BATCH


def test_search_ranks_in_the_tasks_and_moves_only_the_best(spark):
    """Every chunk matches: pairs of a query and a chunk are neither shuffled nor written, and equal scores stay in the order of chunk_id over batches and parts."""
    texts = spark.range(3000).select(F.concat(F.lit("C"), F.lpad(F.pmod(F.col("id") * 7, F.lit(3000)).cast("string"), 4, "0")).alias("chunk_id"), F.lit("the anana 9").alias("text"))
    asked = spark.createDataFrame([(f"q{i}", f"ana the {i}") for i in range(40)], "query_id string, query string")
    rows = ranking.batch_best(ranking.chunk_index(texts.repartition(3)), asked.select("query_id", F.lit("ana").alias("word"), F.lit(1).cast("long").alias("times")), 5, 5)
    assert rows.count() <= 40 * 5 * 9 and rows.agg(F.sum("matching")).first()[0] == 40 * 3000
    for part in (ranking.PART, 100):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ranking, "PART", part)
            got = {tuple(r) for r in ranking.search_chunks(ranking.chunk_index(texts), asked, top=2).select("query_id", "chunk_id", "score", "place", "matching").collect()}
        assert got == {(f"q{i}", f"C{k:04}", 2 + (i == 9), k + 1, 3000) for i in range(40) for k in range(2)}


def test_search_adds_up_texts_of_a_repeated_chunk(spark):
    """As the check SQL does: each text counts a word five times at most."""
    rows = [(1, "a " * 9), (1, "a a b"), (2, "b"), (3, None), (None, "a")]
    found = ranking.search_chunks(ranking.chunk_index(spark.createDataFrame(rows, "chunk_id long, text string")), spark.createDataFrame([("q", "a b"), ("none", "?")], "query_id string, query string"))
    assert {(r.chunk_id, r.score, r.matching) for r in found.collect()} == {(1, 8, 3), (2, 1, 3), (None, 1, 3)}
    for query in ("?", "zzz"):
        nothing = spark.createDataFrame([(1, query)], "query_id int, query string")
        assert ranking.search_chunks(ranking.chunk_index(spark.createDataFrame(rows[1:], "chunk_id long, text string")), nothing).count() == 0
