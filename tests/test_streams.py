"""Streams that keep keyed state: expiry, timers, and the same result however rows arrive."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from galleyspark.streaming import jobs as streams


def landed(spark, folder, parts, schema):
    """A stream that takes one file a trigger; each part is one file."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_window_of_a_session_equals_loop(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, t, rng.choice(("user", "assistant")), rng.choice(("hi  there", " ", "x" * 3000, "ok"))) for s in range(5) for t in range(20)]
    schema = "session long, turn long, role string, text string"
    parts = [[r for r in rows if r[1] // 7 == k] for k in range(3)]
    for p in parts:
        rng.shuffle(p)
    got = streams.run_available(streams.conversation_window(landed(spark, str(tmp_path / "in"), parts, schema)), "update", ["session"])
    want = {}
    for s in range(5):
        own, kept = sorted(r for r in rows if r[0] == s), []
        for a, b in zip(own, own[1:], strict=False):
            u, x = " ".join(a[3].split())[:500], b[3].strip()[:2000]
            if a[2] == "user" and b[2] == "assistant" and u and x:
                kept.append((b[1], len(u) + len(x)))
        if kept:
            want[s] = (len(kept[-4:]), kept[-4:][0][0], kept[-1][0], sum(n for _, n in kept[-4:]))
    assert {r.session: (r.exchanges, r.first_turn, r.last_turn, r.chars) for r in got.collect()} == want


def test_latest_status_is_forgotten_when_it_expires(spark, tmp_path):
    schema = "source string, url string, run_at timestamp, rowid long, source_type string, status string, reason string"
    at = datetime(2024, 1, 5)
    parts = [[("a", "u", at, 5, "rss", "ok", "")], [("b", "u", at, 1, "rss", "failed", "x")], [("a", "u", at - timedelta(days=1), 9, "rss", "failed", "late")]]
    keep = streams.run_available(streams.latest_status_stream(landed(spark, str(tmp_path / "keep"), parts, schema)), "update", ["source", "url"])
    assert {(r.source, r.rowid) for r in keep.collect()} == {("a", 5), ("b", 1)}
    short = streams.latest_status_stream(landed(spark, str(tmp_path / "short"), parts, schema), keep_days=2e-8)  # gone by the next trigger
    assert {(r.source, r.rowid) for r in streams.run_available(short, "update", ["source", "url"]).collect()} == {("a", 9), ("b", 1)}


def test_backlog_reports_when_a_check_is_due(spark, tmp_path):
    day = 86_400_000_000
    schema = "item_id long, seq long, at long, counted boolean"
    parts = [[(1, 1, 0, True), (1, 2, day, True), (2, 1, 0, False)], [(1, 3, 4 * day, True)], [(3, 1, 0, True)]]
    got = streams.run_available(streams.backlog_stream(landed(spark, str(tmp_path / "in"), parts, schema)), "update")
    rows = {(r.item_id, r.attempts, r.final, r.due) for r in got.collect()}
    assert {(1, 2, False, False), (1, 3, True, False), (2, 0, False, False), (2, 0, False, True), (3, 1, False, False)} <= rows
    assert not any(due and item == 1 and final for item, _, final, due in rows)  # a final item is never due
    assert got.filter("item_id = 1").agg(F.max("attempts")).first()[0] == 3


def test_rows_that_arrive_in_steps_are_made_once(spark):
    from galleyspark.plans.bindings import arriving

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    arriving(spark.range(40).mapInPandas(seen, "id long"), "id", "id")
    assert made.value == 40


def test_latest_statuses_of_a_bucket_are_one_call(spark, tmp_path):
    """Many keys over several triggers, late and undated rows among them, equal a loop; a call of the processor serves a bucket, not a key."""
    import random

    rng = random.Random(4)
    schema = "source long, url string, run_at timestamp, rowid long, source_type string, status string, reason string"
    start = datetime(2024, 1, 5)
    rows = [(rng.randrange(300), f"u{rng.randrange(3)}", None if rng.random() < 0.1 else start + timedelta(hours=rng.randrange(50)), i, "rss", rng.choice(["ok", "failed"]), None) for i in range(3000)]
    parts = [rows[i::3] for i in range(3)]
    stream = streams.latest_status_stream(landed(spark, str(tmp_path / "in"), parts, schema))
    assert "bucket" in stream._jdf.queryExecution().logical().toString()
    want = {}
    for r in rows:
        held = want.get(r[:2])
        if held is None or (r[2] is not None, r[2] or start, r[3]) > (held[2] is not None, held[2] or start, held[3]):
            want[r[:2]] = r
    got = streams.run_available(stream, "update", ["source", "url"])
    assert {(r.source, r.url): r.rowid for r in got.collect()} == {k: v[3] for k, v in want.items()}
