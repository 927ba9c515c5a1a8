"""Headline jobs timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from galleyspark.plans.catalogue import JOBS
from galleyspark.session import build_session

HEADLINE = [
    "select_edition", "fair_candidate_order", "backtest", "identity_representative", "drop_reviewed", "match_assets", "syndication_pairs",
    "assign_status", "latest_fetch_status", "strict_coverage", "caption_coverage", "merge_turns", "carry_speaker", "speech_density", "turn_distribution",
    "chunk_citations", "search_chunks", "quote_sources", "focus_mentions", "remove_ads", "backlog_state", "first_seen", "reconcile_deliveries",
    "request_status", "url_key", "extract_links", "extract_articles", "parse_feed_items", "archive_upsert", "delivery_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    names = list(JOBS) if names == ["all"] else names
    spark = build_session("bench", cores, int(cores))
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in names:
        begin = time.perf_counter()
        JOBS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        if len(sys.argv) > 1:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_jobs_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
