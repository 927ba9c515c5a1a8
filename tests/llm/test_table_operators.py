"""Operators that compare rows with each other, against brute force on small fixtures; and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleyspark.llm import importance, near_dups, pfair, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def components(sets, similar):
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def word_shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def copies(rng, count):
    """Groups of near copies round a base, some of them beyond the similarity, all with one shared passage; and short texts."""
    words = [f"w{i}" for i in range(500)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(count):
        base = [rng.choice(words) for _ in range(rng.randint(4, 80))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice((1, 2, 12))):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    return texts + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rng = random.Random(size)
    texts = copies(rng, 40)
    rng.shuffle(texts)
    rows = [(10 + i, t, "s") for i, t in enumerate(texts)] + [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, texts[0].upper(), "s"), (5, "one word " * 30_000, "s"), (5, "one word " * 30_000, "s"), (None, texts[0], "s")]
    got = near_dups.near_duplicates(docs(spark, rows), size=size).collect()
    sets = {i: word_shingles(t, size) for i, t, _ in rows if i is not None}
    want = components(sets, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want) - 20
    assert near_dups.near_duplicates(docs(spark, [])).count() == 0


def test_texts_under_one_id_keep_their_links(spark):
    """Repeated ids with different texts: near copies of each text are linked to the id, and through it."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    base = {k: [word() for _ in range(60)] for k in "wvuz"}
    near = lambda k, n: " ".join(base[k][:-1] + [f"end{n}"])
    rows = [(5, near("w", 0), "s"), (5, near("v", 0), "s"), (7, near("w", 1), "s"), (8, near("v", 1), "s"), (9, near("u", 0), "s"), (9, near("u", 0), "s"), (10, near("u", 1), "s"), (9, near("z", 0), "s"), (4, near("z", 2), "s"), (11, " ".join(base["w"][:20]), "s")]
    got = near_dups.near_duplicates(docs(spark, rows), size=5).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(4, 4, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 4, False), (9, 4, False), (9, 4, False), (10, 4, False), (11, 11, True)]


def off_target(slots, blocks, weights):
    """Largest distance of any source from its share, over all slots of all phases, in exact integers; a phase ends with a source."""
    order = np.empty(sum(blocks), np.int64)
    for s, own in enumerate(slots):
        order[own] = s
    worst, begin, left = 0.0, 0, dict(enumerate(blocks))
    while left := {s: n for s, n in left.items() if n}:
        share = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)
        end = min(slots[s][-1] for s in share) + 1
        total, t = sum(share.values()), np.arange(1, end - begin + 1, dtype=object)
        for s in left:
            had = np.cumsum(order[begin:end] == s).astype(object)
            gap = had * total - t * share.get(s, 0)
            worst = max(worst, max(gap) / total, -min(gap) / total)
            left[s] -= int(had[-1])
        begin = end
    assert begin == len(order)
    return worst


def test_no_source_is_a_block_from_its_share():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 7)
        blocks, weights = [rng.randint(0, 60) for _ in range(n)], [rng.choice((0, 1, 1, 2, rng.randrange(1, 1 << 40))) for _ in range(n)]
        slots = pfair.edf_slots(blocks, weights)
        assert [len(x) for x in slots] == blocks and sorted(t for x in slots for t in x) == list(range(sum(blocks)))
        assert off_target(slots, blocks, weights) < 1
    assert off_target(pfair.edf_slots([90_000, 10_000], [9, 1]), [90_000, 10_000], [9, 1]) < 1


def test_a_million_slots_of_three_hundred_sources():
    """One third among many sources, in a phase of a million slots and in those that follow."""
    rng = random.Random(3)
    weights = [rng.randrange(1 << 20, 1 << 30) for _ in range(299)]
    weights.append(sum(weights) // 2)
    total = sum(weights)
    blocks = [int(w / total * 1_000_000) + rng.choice((2, 40)) for w in weights]
    slots = pfair.edf_slots(blocks, weights)
    first = min(x[-1] for x in slots) + 1
    assert first > 990_000
    order = np.empty(sum(blocks), np.int64)
    for s, own in enumerate(slots):
        order[own] = s
    for s in (0, 17, 298, 299):
        had, t = np.cumsum(order[:first] == s).astype(object), np.arange(1, first + 1, dtype=object)
        gap = had * total - t * weights[s]
        assert -total < min(gap) and max(gap) < total
    for s, own in enumerate(slots):  # the windows of all blocks of the phase
        j = np.arange(sum(t < first for t in own), dtype=object)
        at = np.array(own[: len(j)], dtype=object)
        assert all(at >= j * total // weights[s]) and all(at < -(-(j + 1) * total // weights[s]))


def test_mix_keeps_all_rows_and_shares(spark):
    rng = random.Random(4)
    sizes = {"a": 3000, "b": 1000, "c": 700, None: 50, "": 20}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(0, "t0", "a"), (None, None, "b")]
    rng.shuffle(rows)
    weights = {"a": 0.2, "b": 0.5, "c": 0.2}
    out = pfair.mix(docs(spark, rows, SCHEMA.replace("n_chars", "slot")), weights, block_docs=8)
    got = sorted(out.collect(), key=lambda r: r.position)
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((i or -1, s or "") for i, _, s in rows)
    assert len({r.position for r in got}) == len(rows) and out.columns[-4:] == ["source_no", "block", "slot_", "position"]
    order = [r.source for r in sorted({r.slot_: r for r in got}.values(), key=lambda r: r.slot_)]
    assert len(order) == sum(-(-n // 8) for n in (3001, 1001, 700, 50, 20))
    share = weights | {None: 0.1 * 50 / 70, "": 0.1 * 20 / 70}
    first = min(max(t for t, s in enumerate(order) if s == name) for name in share)
    had = dict.fromkeys(share, 0)
    for t, s in enumerate(order[:first], 1):  # the first phase: all sources last
        had[s] += 1
        assert all(abs(had[x] - share[x] * t) < 1 + 1e-6 for x in share)
    assert pfair.mix(docs(spark, [])).count() == 0
    files = pfair.in_order(out, ["doc_id", "source", "position"])
    assert [r.position for r in files.collect()] == [r.position for r in got]
    # Each document by a plain version: its place in the hash order of its source, and that block's slot.
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(r.doc_id,) for r in got], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for name in share:
        own = sorted((r for r in got if r.source == name), key=lambda r: (hashes[r.doc_id] % (1 << 64), -1 if r.doc_id is None else r.doc_id))
        assert [r.block for r in own] == [k // 8 for k in range(len(own))] and all(r.position == r.slot_ * 8 + k % 8 for k, r in enumerate(own))
    larger = pfair.mix(docs(spark, rows), block_docs=8, most_slots=100).agg(F.max("slot"), F.count("*")).first()
    assert larger[0] < 105 and larger[1] == len(rows)


def test_more_sources_than_a_few_hundred(spark):
    rows = [(i, "t", f"s{i % 700}") for i in range(2800)]
    got = pfair.mix(docs(spark, rows), block_docs=1).collect()
    assert sorted(r.position for r in got) == list(range(2800))
    assert all(len({r.source for r in got if r.slot // 700 == k}) == 700 for k in range(4))  # equal shares go round


def test_importance_sample_keeps_clean_texts(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [(1, None, "s"), (2, "", "s"), (None, "word1 word2 word3", "s"), (3, "word5 word6 " * 20_000, "s"), (3, "word5 word6 " * 20_000, "s")], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randint(15, 150))]
        bad = i % 6 == 0
        rows.append((10 + i, " ".join(x + "!!" if bad else x for x in w), "s"))
        if i % 2 == 0:
            labels.append((10 + i, int(not bad)))
    lab = spark.createDataFrame(labels + [(10, 0), (None, 1), (99_999, 1), (11, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in importance.resample(docs(spark, rows), lab).collect()}
    wrong = [i for i in range(10, 610) if got[i] != bool((i - 10) % 6)]
    assert len(wrong) <= 6 and got[1] and got[2] and got[None]
    kept = importance.sampled(docs(spark, rows, SCHEMA.replace("n_chars", "log_weight")), lab)
    assert kept.columns[-1] == "log_weight" and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert importance.sampled(docs(spark, rows), lab.limit(0)).count() == len(rows)
    assert importance.sampled(docs(spark, []), lab).count() == 0


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, rng.random() * 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert [importance.kth_largest(df, "key", k) for k in (1, 7, 1500, 3000)] == [sorted(values)[-k] for k in (1, 7, 1500, 3000)]


def test_top_k_matches_brute_force(spark):
    rng = np.random.RandomState(3)
    plain = [(i, rng.uniform(-1, 1, 40).astype("float32").tolist()) for i in range(260)]
    ties = [(300 + i, plain[0][1]) for i in range(12)]
    huge = [(400 + i, [1e6, -1e6, float(i), 3.0]) for i in range(6)]
    odd = [(None, plain[1][1]), (500, None), (550, []), (501, [None] + plain[1][1][1:]), (600, [float("nan")] * 40), (601, [float("inf")] * 40), (0, plain[0][1])]
    rows = plain + ties + huge + odd
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dims string")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in plain + ties + huge}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and len(v[i]) == len(v[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_that_would_not_fit_are_left_out(spark):
    """Components beyond a long leave the search as non-finite ones do."""
    rows = [(0, [1.0, 2.0]), (1, [1e10, 1e10]), (2, [1e300, 0.0]), (3, [3.0, -1.0]), (4, [1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.lit(True), 2).select("query_id", "rank", "vec_id", "score").collect())
    assert {r[0] for r in got} == {0, 3, 4} == {r[2] for r in got}
    assert (4, 1, 0, 256 * 256 * 3_000_000) in got


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(rng.randint(30, 120)) for _ in range(200)]
    bench = text(40)
    half = bench.split()
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(clean)]
    rows += [(1000 + i, clean[i] + " tail", "s0") for i in range(10)] + [(1100 + i, " ".join(w + "###" for w in text(60).split()), "s1") for i in range(40)]
    rows += [(1200, text(20) + " " + " ".join(half[20:] + half[:20]), "s2"), (1300, None, None), (1301, "", "s0"), (None, "word1 word2 word3", "s1"), (5, clean[5], "s2")]
    folder = str(tmp_path)
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(1100 + i, 0) for i in range(0, 40, 2)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in got]
    assert sorted(i for i in ids if i is not None) == [*range(200), 1300, 1301] and ids.count(None) == 1
    assert sorted(r.start for r in got) == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    place = {i: s for i, _, s in rows if i is not None}
    first = [place[r.doc_id] for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None][:96]
    assert {first.count(s) for s in ("s0", "s1", "s2")} != {0} and min(first.count(s) for s in ("s0", "s1", "s2")) >= 16  # blocks of 16 interleave
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixture", "pack_tokens"]
