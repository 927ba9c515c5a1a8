"""Plans that must hold at scale: no pairs of everything, no row-at-a-time Python, filters and columns pushed to the scan."""

import pytest
from pyspark.sql import functions as F

from galleyspark.plans.catalogue import JOBS

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return JOBS[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["syndication_pairs", "quote_sources", "focus_mentions", "reviews_in_run", "review_as_of", "resolve_source", "match_assets", "drop_reviewed", "reconcile_deliveries", "first_claim"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert not any(bad in text for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Exchange SinglePartition"))


def test_top_n_is_limited_before_the_shuffle(spark):
    assert plan(spark, "select_edition").count("WindowGroupLimit") == 2


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "latest_fetch_status")
    assert "PushedFilters" in text and "props" not in text


@pytest.mark.parametrize("name", ["carry_speaker", "backlog_state", "reconcile_deliveries"])
def test_ordered_scans_shuffle_their_rows_once(spark, name):
    """Without broadcasts, the scan's window and its join use one partitioning: each exchange by block is either the rows' or the carried summary's."""
    import re

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name).split("== Initial Plan ==")[0]
        assert re.search(r"SortMergeJoin \[__at", text) and len(re.findall(r"Exchange hashpartitioning\(__at", text)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["reviews_in_run", "review_as_of", "backtest"])
def test_runs_and_their_items_are_not_shuffled(spark, name):
    """Their rows grow with the product of runs and reviews at a time: nothing is exchanged above the join that makes them."""
    text = plan(spark, name).split("== Initial Plan ==")[0]
    at = next(i for i, line in enumerate(text.splitlines()) if "Join [" in line)
    assert "hour" in text.splitlines()[at] and not any("Exchange" in line for line in text.splitlines()[:at])


def test_captions_are_joined_by_plain_lists(spark):
    text = plan(spark, "merge_rolling_captions")
    assert "ArrowEvalPython" in text and "aggregate(" not in text


def test_numbers_are_found_without_the_slow_unicode_flag(spark):
    from galleyspark.operators import rollups

    rows = [(1, "\u0662\u0660a3,5", "\u0662\u0660b4"), (2, "三到五年", "x"), (3, "一至二", "二")]
    df = rollups.number_preservation(spark.createDataFrame(rows, "item_id int, source_text string, derived_text string"))
    assert "(?U)" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.item_id: (r.numbers, r.missing, r.introduced) for r in df.collect()} == {1: (2, "3,5", "4"), 2: (2, "三 五", ""), 3: (2, "一", "")}


def test_caption_files_are_searched_once(spark):
    from galleyspark.sources import feeds

    raw = spark.createDataFrame([(1, "vtt", "WEBVTT\n\n00:01.000\n-->\t00:02.000 align:start\n<b>a --</b>\nb\n", 9.0)], "item_id int, format string, body string, duration double")
    cues = feeds.parse_caption_cues(raw)
    assert cues._jdf.queryExecution().optimizedPlan().toString().count(feeds.VTT_CUE) == 1
    assert [tuple(r) for r in cues.collect()] == [(1, 0, 1.0, 2.0, "a -- b")]


@pytest.mark.parametrize("name", ["parse_atom_items", "parse_feed_items"])
def test_items_of_a_feed_are_made_once(spark, name):
    """No filter repeats the expressions of links, and no item carries its whole document along."""
    import re

    text = plan(spark, name)
    carried = re.findall(r"Generate posexplode\(.*\), \[(.*?)\], true", text)
    assert carried and not any("x#" in c for c in carried)
    assert all(line.count("regexp_extract(") < 10 for line in text.split("\n") if re.match(r"[\s+:-]*Filter ", line))


def test_candidates_of_titles_are_judged_before_they_are_shuffled(spark):
    """They grow with the square of the titles that share a word: words and dates of a pair do not enter an exchange."""
    text = plan(spark, "syndication_pairs")
    assert "first(r_w" not in text and "first(v_t" not in text


def test_matches_of_titles_are_made_once(spark):
    """The fold reads its pairs twice; candidates of titles are joined in an earlier job."""
    from galleyspark.operators import matching

    pairs = spark.range(8).selectExpr("'s' as source", "id as r_item_id", "id as r_ord", "id + 100 as v_item_id", "id + 100 as v_ord", "uuid() as salt", "1.0d as score")
    taken = matching.attach_unique_best(pairs)
    assert taken.count() == 8 and "uuid" not in taken._jdf.queryExecution().toString()
    items = spark.range(8).selectExpr("'s' as source", "id as item_id", "'t' as title", "timestamp'2024-01-01' as published_at", "1d as duration")
    assert "MapInPandas" not in matching.attach_videos(items, items.withColumn("item_id", F.col("item_id") + 100), taken)._jdf.queryExecution().executedPlan().toString()


def test_matches_of_an_item_are_combined_before_the_shuffle(spark):
    """Pairs of items and assets are neither made distinct nor joined again: what is shuffled behind the joins is one row an item and task."""
    text = plan(spark, "resolve_unique_asset").split("== Initial Plan ==")[0]
    assert "keys=[item_id" in text and not any(f"hashpartitioning({k}" in text for k in ("asset_id", "item_id#0L, asset_id")) and text.count("partial_min") >= 1
    assert "Join [asset_id" not in text and "Join [item_id" not in text
