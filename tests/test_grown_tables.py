"""Jobs on tables shaped as larger copies are: folders of files, long conversations, cut texts. Each must equal its check SQL."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from galleyspark.operators.editorial import last_in_run
from galleyspark.operators.rollups import speech_density
from galleyspark.operators.transcripts import compression_checks, extractive_compact
from galleyspark.plans.catalogue import JOBS

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def same(spark, tmp_path):
    """Compare a job with its SQL over the given tables, each a folder of files."""

    def compare(name, **tables):
        con = duckdb.connect()
        con.execute("set TimeZone='UTC'")
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        state, count, _, note = check.compare(spark, con, name, str(tmp_path))
        assert state == "OK" and not note, note
        return count

    return compare


def turns(spark, rows):
    return spark.createDataFrame(rows, TURNS).repartition(3, "conv_id")


def test_conversation_window_reads_a_folder_of_files(spark, same):
    rows = [(c, t, ("user", "assistant")[t % 2], f"words of {c} {t}") for c in range(7) for t in range(12)]
    assert same("conversation_window", conversations=turns(spark, rows)) == 7


def test_conversation_window_of_no_turns(spark, tmp_path):
    turns(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert JOBS["conversation_window"](spark, str(tmp_path)).collect() == []


def test_articles_keep_references_without_a_semicolon(spark, same):
    html = [f"<html><body><article><h1>R&amp;D {x}</h1><p>{x} and &quot;more&quot; &amp;quot; a & b</p></article></body></html>" for x in ("&amp", "&am", "&quot", "&", "plain")]
    pages = spark.createDataFrame([(i, f"https://example.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert same("extract_articles", pages=pages) == 5


def test_translation_checks_of_long_conversations_and_short_turns(spark, same):
    rows = [(c, t, "user", "ab " * (t % 25) + "9") for c in range(3) for t in list(range(45)) + [103, 203, 204]]
    assert same("translation_checks", conversations=turns(spark, rows)) == len(rows)


def test_last_review_of_each_item_in_each_run_equals_loop(spark):
    rng = random.Random(4)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000))
    reviews = sorted({(i, at()) for i in range(6) for _ in range(60)})
    runs = [(k, t, t + timedelta(minutes=rng.randrange(300))) for k, t in ((k, at()) for k in range(40))]
    want = {(k, i, max(t for j, t in reviews if j == i and a <= t <= z)) for k, a, z in runs for i in range(6) if any(j == i and a <= t <= z for j, t in reviews)}
    marks = spark.createDataFrame([(i, t, t) for i, t in reviews], "item_id int, created_at timestamp, review timestamp")
    got = last_in_run(spark.createDataFrame(runs + runs[:3], "run_id int, created_at timestamp, updated_at timestamp"), marks).select("run_id", "item_id", "review").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_catalogue_references_equal_loop(spark):
    from galleyspark.operators import rollups, state

    rng = random.Random(6)
    words = ["红色机器", "blue", "ring", "ringer", "bolt", "no1", "no12", "no123", "abc", "the"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    items = [(i, some(5), some(3)) for i in range(60)]
    asks = [(k, rng.choice(("", "不是 ", "please ", "不要")) + " ".join(x for x in rng.sample(items, 2)[0][1:]) + rng.choice(("", " 排除") ) + some(3)) for k in range(80)]
    c = spark.createDataFrame(items, "ref int, title string, show string")
    both = [rollups.selector_aliases(F.col(x)).alias(x + "_a") for x in ("title", "show")] + [rollups.selector_compact(F.col(x)).alias(x + "_c") for x in ("title", "show")]
    rows = c.select("ref", *both).collect()
    uses = Counter(a for r in rows for a in [*r.title_a, *r.show_a])
    want = set()
    for k, q in spark.createDataFrame(asks, "k int, q string").select("k", rollups.selector_compact(F.col("q"))).collect():
        found = {}
        for r in rows:
            kinds, out = set(), False
            for kind, own, whole in (("title", r.title_a, r.title_c), ("show", r.show_a, r.show_c)):
                for a in {*own, *([whole] if len(whole) >= 3 else [])}:
                    if a in q:
                        kinds |= {kind} if a == whole or uses[a] == 1 else set()
                        out = out or any(m + a in q for m in state.NEGATIONS)
            if kinds and not out:
                found[r.ref] = kinds
        two = any(len(v) == 2 for v in found.values())
        want |= {(k, ref) for ref, v in found.items() if not two or len(v) == 2}
    got = state.resolve_catalog_refs(spark.createDataFrame(asks, "query_id int, query string"), c).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(want) > 50


def test_queries_meet_aliases_not_items(spark):
    """Items that share their words and show do not multiply the queries that hold them."""
    from galleyspark.operators import state

    aliases = spark.createDataFrame([(f"largeringno{i}",) for i in range(1000, 1400)] + [("largering",)], "alias string")
    said = state._aliases_said(spark.createDataFrame([(i, f"pleaselargeringno{i}now") for i in range(1000, 1400)], "query_id int, q string"), aliases)
    assert said.count() == 800


def test_compaction_of_a_long_paragraph_equals_loop(spark):
    """Twenty thousand sentences in one paragraph: each is decided from one running sum, not from all before it."""
    rng = random.Random(8)
    one = [rng.choice(("短句。", "这句话比较长而已。", "他有3个人。", "可能吧！")) for _ in range(20000)]
    keep = lambda i, s: i == 0 or s in ("他有3个人。", "可能吧！")
    goal, fixed, before, want = len("".join(one)) * 0.8, sum(len(s) for i, s in enumerate(one) if keep(i, s)), 0, []
    for i, s in enumerate(one):
        if keep(i, s):
            want.append(s)
        else:
            want += [s] if fixed + before < goal else []
            before += len(s)
    got = extractive_compact(spark.createDataFrame([(1, ["".join(one), "尾。"])], "item_id int, paragraphs array<string>"), 0.8).first().paragraphs
    assert got == ["".join(want), "尾。"] and len(want) < len(one)


def test_density_of_texts_without_characters(spark, same):
    """No words in no minutes are no number, and words in none are infinitely many."""
    rows = [(1, "", 0), (2, "word " * 1200, 6000), (3, " \n", 2), (5, "a b", None), (6, None, 0)]
    assert same("speech_density", documents=spark.createDataFrame(rows, "doc_id long, text string, n_chars long")) == 5
    many = speech_density(spark.createDataFrame([(4, "words " * 1100, 0.0)], "item_id long, text string, minutes double")).first()
    want = duckdb.sql("select 1100 / 0.0::double as wpm, 1100 / 0.0::double between 80 and 280 as ok").fetchall()[0]
    assert (many.words, many.wpm, many.plain_ok) == (1100, *want) and not (many.publisher_a_ok or many.publisher_c_ok or many.captions_ok) and many.official_ok


def test_compression_of_empty_texts(spark, tmp_path):
    """An empty source, or one of line breaks, has no length to hold; other problems and texts stay as they are."""
    spark.createDataFrame([(1, ""), (2, "\n"), (3, None), (4, "Ada said 7. " * 20), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_id: r.problems for r in JOBS["compression_checks"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == got[5] == "length,layout" and set(got) == {1, 2, 3, 4, 5}
    pairs = spark.createDataFrame([(1, "", "x"), (2, "", None), (3, None, "x"), (4, "ab", None), (5, "abcde", "ab")], "item_id int, source_text string, short_text string")
    assert {r.item_id: r.problems for r in compression_checks(pairs).collect()} == {1: "length", 2: "length", 3: "", 4: "", 5: ""}
