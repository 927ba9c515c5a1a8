"""Vector codes, exact duplicates and spelling variants against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleyspark.llm import exact_dups, spelling, vector_codes


def brute_codes(vectors, parts, entries, rounds):
    """vectors: list of (id, integers). Codes, errors and codebooks by plain loops."""
    width = -(-max((len(v) for _, v in vectors), default=0) // parts) or 1
    full = [(i, v + [0] * (parts * width - len(v))) for i, v in vectors]
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = {}
    for i, v in sorted(full, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[cut(v)[p] for v in list(first.values())[:entries]] for p in range(parts)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        groups = {}
        for _, v in full:
            for p, (_, k) in enumerate(assign(v)):
                groups.setdefault((p, k), []).append(cut(v)[p])
        books = [[[sum(c) // len(c) for c in zip(*groups[p, k], strict=True)] if (p, k) in groups else e for k, e in enumerate(book)] for p, book in enumerate(books)]
    return sorted((str(i), "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v))) for i, v in full), books


@pytest.mark.parametrize("width", [1, 3, 5, 40])
def test_vector_codes_match_brute_force(spark, width):
    rng = random.Random(width)
    parts, entries = 4, 6
    rows = [(i, [rng.choice((-2.0, -0.3, 0.0, 0.25, 1.5)) for _ in range(parts * width)], 0) for i in range(40)]
    rows += [(3, rows[7][1], None), (3, rows[7][1], None), (None, rows[2][1], 1), (50, rows[1][1][:-1], 1), (51, [], 2), (52, [60000.0] * parts, 2), (53, [-65536.0] * parts, 2)]
    bad = [(60, None, 1), (61, [None] * parts, 1), (62, [float("nan")] * parts, 1), (63, [float("inf")] * parts, 1), (64, [1e300] * parts, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string")
    data = vector_codes.quantised(df)
    books = vector_codes.learn(data, parts, entries)
    got = vector_codes.encode(data, books)
    assert got.columns == ["vec_id", "label", "code", "code_", "error"]
    want, want_books = brute_codes([(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows], parts, entries, 2)
    assert sorted((str(r.vec_id), r.code_, r.error) for r in got.collect()) == want
    assert books.tolist() == want_books


def test_vector_codes_of_few_rows_and_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    data = vector_codes.quantised(empty)
    assert vector_codes.encode(data, vector_codes.learn(data)).count() == 0
    two = vector_codes.quantised(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.25] * 16, 1)], "vec_id long, embedding array<float>, label int"))
    assert {(r.code, r.error) for r in vector_codes.encode(two, vector_codes.learn(two)).collect()} == {("00" * 16, 0), ("01" * 16, 0)}


def test_walsh_matrix_keeps_distances():
    for size in (1, 2, 8, 32):
        h = vector_codes.walsh(size)
        assert (h @ h.T == size * np.eye(size)).all()
        assert [(np.diff(r) != 0).sum() for r in h] == list(range(size))


def brute_copies(rows):
    """(doc_id, text) to (doc_id, keep_id, group_size, digest)."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    keep = {}
    for (i, _), t in zip(rows, norm, strict=True):
        keep.setdefault(t, []).append(i)
    best = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted((str(i), str(best(keep[t])), len(keep[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True))


def as_rows(found):
    return sorted((str(r["at"].id), str(r.keep_at.id), r.group_size, r.text_sha256) for r in found.collect())


WEAK = {"sha": None, "length": lambda t: F.length(t), "one": lambda t: F.lit(1)}


@pytest.mark.parametrize("digest", list(WEAK))
def test_exact_duplicates_match_brute_force(spark, tmp_path, digest):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(150)]
    rows = [(1000 - i, t.replace(" ", rng.choice((" ", "\n", "\t \r", "\x0b\x0c")))) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "  "), (None, "a b"), (None, "own"), (5, "same"), (5, "same"), (6, "x " * 200_000), (7, "x\n" * 200_000), (8, " "), (9, "\x1c")]
    rows += [(2000 + i, "hot") for i in range(300)]
    rng.shuffle(rows)
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string").repartition(3).write.parquet(path)
    found = exact_dups.exact_duplicates(spark, path, digest=WEAK[digest], per_salt=7)
    assert as_rows(found) == brute_copies(rows)
    kept = found.groupBy("text_sha256").agg(F.count_if("kept").alias("k"), F.count_if(F.col("kept") & (F.col("at") != F.col("keep_at"))).alias("bad"))
    assert {(r.k, r.bad) for r in kept.collect()} == {(1, 0)}


def test_exact_duplicates_go_on_from_a_state(spark, tmp_path):
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    rows = [(5, "a"), (6, "b"), (7, "a")]
    write = lambda part: spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    write(rows)
    assert as_rows(exact_dups.exact_duplicates(spark, path, state=state)) == brute_copies(rows)
    more = [(1, "a"), (9, "b"), (3, "c")]
    write(more)
    assert as_rows(exact_dups.exact_duplicates(spark, path, state=state)) == brute_copies(rows + more)
    assert spark.read.format("statestore").load(state).agg(F.sum("value.count")).first()[0] == 6  # no file was counted twice


def test_exact_duplicates_of_an_empty_table_and_a_single_file(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_dups.exact_duplicates(spark, path).count() == 0
    import pandas as pd

    rows = [(2, "a"), (1, "a"), (3, "b")]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "one.parquet")
    pd.DataFrame([(0, "a")], columns=["doc_id", "text"]).to_parquet(tmp_path / "other.parquet")
    assert as_rows(exact_dups.exact_duplicates(spark, str(tmp_path / "one.parquet"))) == brute_copies(rows)


def one_edit(a, b):
    if a == b:
        return False
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near[w]), str(form[w]), str(counts.get(form[w])), root(w)) for w, n in counts.items())


@pytest.mark.parametrize("block", [3, 1024])
def test_variants_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    monkeypatch.setattr(spelling, "SMALL", 10)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(250)}
    words |= {"prefixed" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 3))) for _ in range(60)}  # a hot prefix
    words |= {"z" * 5000, "z" * 5001, "z" * 2500 + "y" + "z" * 2500, "aaaaaaa", "aaaaaaaa", "ÿÿÿÿÿÿÿ", "ÿÿÿÿ÷ÿÿ", "日本語日本語日", "日本語日本語本"}
    counts = {w: rng.choice((2, 2, 3, 20, 25, 250, 3000)) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted((r.word, r.n, r.n_near, str(r.form), str(r.form_n), r.root) for r in got.collect()) == brute_variants(counts)


def test_roots_follow_the_longest_chains(spark):
    chain = [("abcdefg" + "h" * k, 2 * 10**k) for k in range(18)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_word_counts_match_a_loop(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Résumés", "TRAINING", "training", "trainingx", "ÀÉÈÊËÌÍ", "naïvetés", "sixsix", "x" * 3000] + ["w" + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + "1tail_training") for i in range(40)] + [(None, "training training"), (7, None), (8, ""), (9, "training"), (9, "training")]
    want = {}
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] = want.get(run, 0) + 1
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    for held in (1 << 25, 500):  # counts that leave a task in one piece, or in many
        monkeypatch.setattr(spelling, "HELD", held)
        assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
