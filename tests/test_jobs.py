"""A sample of registered jobs of every section against DuckDB at the smallest scale; check.py runs all of them."""

import duckdb
import pytest

import check
from galleyspark.plans.catalogue import CHECKS, JOBS

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["select_edition", "backtest", "merge_turns", "strict_coverage", "identity_representative", "syndication_pairs", "match_assets", "chunk_citations", "remove_ads", "clean_transcripts",
          "transcript_lines", "caption_lines", "url_key", "digest_format", "parse_feed_items", "extract_articles", "extract_publisher_transcripts", "first_seen", "first_seen_stream", "backlog_stream",
          "conversation_window", "search_chunks", "quote_sources", "reconcile_deliveries", "resolve_catalog_refs", "review_as_of", "match_page_titles", "attach_unique_best", "daily_quota",
          "archive_files", "run_health", "parse_atom_items", "focus_mentions", "speaker_mismatches", "promote_late", "drop_reviewed"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_job_matches_sql(spark, con, name):
    state, _, _, note = check.compare(spark, con, name, FOLDER)
    assert state in ("OK", "EMPTY") and not note, note


def test_registry():
    assert len(JOBS) >= 150 and set(CHECKS) <= set(JOBS)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
