"""Rules in which each row depends on earlier ones, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from galleyspark.operators import matching, rollups, state
from galleyspark.operators.ordered import fold_in_order, independent_runs
from galleyspark.streaming import jobs as streams

T0 = datetime(2024, 1, 1)
OBSERVED = "feed int, scan_no long, scan_at timestamp, ordinal int, keys array<string>, published_at timestamp"


def ledger_by_loop(observations, lookback=24, limit=3):
    """Each scan of a feed in turn, as one reads it."""
    ledger = {}
    scans = {}
    for o in sorted(observations, key=lambda o: (o[0], o[1], o[3])):
        scans.setdefault((o[0], o[1]), []).append(o)
    for (feed, _), rows in scans.items():
        own = ledger.setdefault(feed, {})
        initial, late = not own, []
        for _, _, at, _, keys, published in rows:
            keys = [k for k in keys if k]
            had = [own[k] for k in keys if k in own]
            if keys and not had and not initial and published and published < at - timedelta(hours=lookback):
                late.append(keys)
            entry = (min([f for f, _ in had], default=at), initial or any(s for _, s in had))
            own.update({k: entry for k in keys})
        if len(late) > limit:
            own.update({k: (own[k][0], True) for keys in late for k in keys})
    return {(feed, k): v for feed, own in ledger.items() for k, v in own.items()}


def scan_log(seed):
    rng = random.Random(seed)
    rows = []
    for feed in range(4):
        for scan in range(30):
            at = T0 + timedelta(hours=6 * scan)
            for ordinal in range(rng.randint(0, 7)):
                g, x = rng.randint(0, 12 + scan), rng.randint(0, 25)
                keys = [k for k in (f"g{g}" if rng.random() < 0.9 else None, f"e{g if rng.random() < 0.8 else x}" if rng.random() < 0.8 else None) if k]
                rows.append((feed, scan, at, ordinal, keys, rng.choice([None, T0 - timedelta(days=9), at, T0 - timedelta(days=3)])))
    return rows


def cases():
    """Lists of (hours after the start, keys, published days before the start or None) of one feed, each a behaviour to keep."""
    seed = [(0, ["g:seed", "e:seed"], 9)]
    new = (6, ["g:new", "e:new"], 9)
    yield seed + [new, (31, ["g:new", "e:other"], 9)]  # earliest time stays
    yield seed + [new, (31, ["g:changed", "e:new"], 9)]
    yield seed + [(6, ["g:seed", "e:changed"], 9), (12, ["g:again", "e:changed"], 9)]  # seeding is handed on
    yield seed + [(6, [f"g:{i}"], 9) for i in range(3)]  # up to the limit
    yield seed + [(6, [f"g:{i}"], 9) for i in range(4)] + [(12, ["g:0", "e:late"], 9)]  # beyond it, for good
    yield seed + [(6, ["g:a"], 9), (12, ["e:b"], 9), (18, ["g:a", "e:b"], 9), (24, ["e:b", "g:c"], 9), (24, ["g:d", "e:x"], 9)]  # a link changes no past
    yield seed + [(6, ["g:a"], 9), (6, ["g:a", "e:b"], 9), (6, ["g:1"], 9), (6, ["g:2"], 9), (6, ["g:3"], 9), (12, ["g:a", "e:b"], 9)]  # a burst marks the keys it saw new
    yield [(0, [], 9), (6, ["g:first"], 9), (12, ["g:next"], None)]  # a scan without keys seeds nothing


def of_case(case):
    return [(1, h // 6, T0 + timedelta(hours=h), i, keys, None if d is None else T0 - timedelta(days=d)) for i, (h, keys, d) in enumerate(case)]


def entries(df):
    return {(r.feed, r.key): (r.first_seen_at, r.seeded) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_seen_equals_loop(spark, seed):
    rows = scan_log(seed)
    assert entries(state.first_seen(spark.createDataFrame(rows, OBSERVED), 24)) == ledger_by_loop(rows)


def test_first_seen_keeps_every_behaviour(spark):
    log = [(n, *r[1:]) for n, case in enumerate(cases()) for r in of_case(case)]
    got = entries(state.first_seen(spark.createDataFrame(log, OBSERVED), 24))
    assert got == ledger_by_loop(log)
    assert got[0, "e:other"] == (T0 + timedelta(hours=6), False) and got[2, "g:again"] == (T0, True)
    assert not got[3, "g:1"][1] and all(got[4, f"g:{i}"][1] for i in range(4)) and got[4, "e:late"][1]
    assert got[5, "e:b"] == (T0 + timedelta(hours=6), False) and got[5, "g:d"][0] == T0 + timedelta(hours=24)


def test_first_seen_stream_equals_loop(spark, tmp_path):
    """Scans arrive in several files and triggers."""
    rows = scan_log(3)
    df = spark.createDataFrame(rows, OBSERVED)
    documents = df.groupBy("feed", "scan_no", "scan_at").agg(F.sort_array(F.collect_list(F.struct("ordinal", "keys", "published_at"))).alias("items"))
    for low in (0, 9, 20):
        documents.filter(F.col("scan_no").between(low, {0: 8, 9: 19, 20: 99}[low])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert entries(streams.run_available(streams.first_seen_stream(stream, 24), "update", ["feed", "key"])) == ledger_by_loop(rows)


def test_promote_late_reads_all_keys_of_an_item(spark):
    ledger = spark.createDataFrame([(1, "a", T0, False), (1, "b", T0, True), (1, "c", T0 - timedelta(days=2), False)], "feed int, key string, first_seen_at timestamp, seeded boolean")
    old = T0 - timedelta(days=10)
    rows = [(1, 1, ["a"], old), (1, 2, ["a", "b"], old), (1, 3, ["a", "c"], old), (1, 4, ["a"], T0 - timedelta(days=50)), (1, 5, ["a"], T0), (1, 6, ["zz"], old), (1, 7, [], old)]
    items = spark.createDataFrame(rows, "feed int, item_id int, keys array<string>, published_at timestamp")
    assert [r.item_id for r in state.promote_late(items, ledger, F.lit("2024-01-01 06:00:00").cast("timestamp"), 24).collect()] == [1]


def best_by_loop(pairs):
    used, out = set(), []
    options = {}
    for source, r, v, score in pairs:
        options.setdefault((source, r), []).append((score, v))
    for (source, r), found in sorted(options.items()):
        free = sorted((s, v) for s, v in found if (source, v) not in used)
        if free and (len(free) == 1 or free[-1][0] - free[-2][0] >= 0.08):
            used.add((source, free[-1][1]))
            out.append((source, r, free[-1][1]))
    return out


def as_pairs(spark, pairs):
    return spark.createDataFrame([(s, r, r, v, v, x) for s, r, v, x in pairs], "source string, r_item_id int, r_ord int, v_item_id int, v_ord int, score double")


def jobs_of(spark, fn):
    """Result rows, and the number of Spark jobs that they took."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    rows = fn()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return rows, n


def test_unique_best_of_a_long_chain_takes_few_jobs(spark):
    rng = random.Random(2)
    count = {}
    for length in (50, 5000):
        pairs = [("daily", i, v, rng.choice((0.7, 0.75, 0.8, 0.9))) for i in range(length) for v in (i, i + 1)]
        got, count[length] = jobs_of(spark, lambda p=pairs: matching.attach_unique_best(as_pairs(spark, p)).collect())
        assert sorted(map(tuple, got)) == best_by_loop(pairs)
    assert count[5000] <= count[50] + 5


def test_unique_best_of_separate_runs(spark):
    rng = random.Random(8)
    pairs = sorted({(s, i, i // 5 * 4 + rng.randint(0, 3)): rng.choice((0.7, 0.75, 0.8, 0.9)) for s in "abc" for i in range(60) for _ in range(3)}.items())
    pairs = [(*k, x) for k, x in pairs]
    assert sorted(map(tuple, matching.attach_unique_best(as_pairs(spark, pairs)).collect())) == best_by_loop(pairs)


@pytest.mark.parametrize("assets", [6, 40, 4000])
def test_quota_of_a_hot_stream_equals_loop(spark, assets):
    rng = random.Random(assets)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("ab"), T0 + timedelta(minutes=rng.randint(0, 20 * 1440)), i, rng.randint(0, assets)) for i in range(3000)]
    df = spark.createDataFrame(rows, "stream string, at timestamp, seq int, asset long").withColumn("day", F.to_date("at"))
    held, given, want = set(), {}, []
    for stream, at, _, asset in sorted(rows, key=lambda r: (r[1], r[2])):
        if given.get((stream, at.date()), 0) < 3 and (stream, asset) not in held:
            held.add((stream, asset))
            given[stream, at.date()] = given.get((stream, at.date()), 0) + 1
            want.append((stream, at.date(), asset, given[stream, at.date()]))
    assert sorted(map(tuple, rollups.daily_quota(df, 3).collect())) == sorted(want)


def test_runs_end_where_nothing_reaches_on(spark):
    rows = [("k", 1, 1), ("k", 2, 4), ("k", 3, 3), ("k", 4, 4), ("k", 5, 9), ("k", 9, 9), ("j", 7, 7)]
    df = spark.createDataFrame(rows, "key string, at int, reach int").withColumn("blk", F.floor(F.col("at") / 2))
    runs = independent_runs(df, ["key"], ["blk"], "at", "reach")
    assert sorted((r.key, r["at"], r.run) for r in runs.collect()) == [("j", 7, 7), ("k", 1, 1), ("k", 2, 2), ("k", 3, 2), ("k", 4, 2), ("k", 5, 5), ("k", 9, 5)]


def test_a_fold_goes_on_over_batches(spark):
    df = spark.range(25_000).select((F.col("id") % 3).alias("g"), "id")

    def step(state, row):
        state["sum"] = state.get("sum", 0) + row.id
        state["g"] = row.g
        return ()

    got = fold_in_order(df.coalesce(1), ["g"], ["id"], dict, step, "g long, total long", lambda s: [(s["g"], s["sum"])]).collect()
    assert {r.g: r.total for r in got} == {g: sum(range(g, 25_000, 3)) for g in range(3)}
