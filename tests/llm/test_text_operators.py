"""Operators that look at one text at a time, against brute force on small fixtures."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galleyspark.llm import licenses, pseudonyms, secrets, tiling, token_planes, toxicity

SCHEMA = "doc_id long, text string, source string, hits int, found int, words int, licenses int, segments int"
LONG = "lorem ipsum dolor sit amet " * 20_000


def docs(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5) for i, t in texts], schema)


EDGES = [(None, "some words"), (1, None), (2, ""), (3, " \n\t"), (4, "twice told"), (4, "twice told"), (5, LONG)]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_planes_round_trip(spark, vocabulary):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    odd = [(7, "Ünï çödé 中文 'tis we'll __x__ 12.5"), (6, "a\x1cb <|endoftext|> İΣ́"), (9, "it's 'street' don't 'S ''s"), (8, "x y  z")]
    rows = EDGES + odd
    for kind in ("byte", "bit"):
        chunks, index = token_planes.write_planes(docs(spark, rows), vocabulary, kind=kind, block_ids=1000, chunk_ids=5000)
        got = [tuple(r) for r in token_planes.read_planes(chunks, index).orderBy("start").collect()]
        want, start = [], 0
        for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = model.encode(text or "", add_special_tokens=False).ids + [2]
            want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
            start += len(ids)
        assert [tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, g)) for g in got] == want
        assert index.agg(F.max(F.col("first_id") + F.col("n_ids"))).head()[0] == start


def test_token_planes_of_an_empty_table(spark, vocabulary):
    chunks, index = token_planes.write_planes(docs(spark, []), vocabulary)
    assert token_planes.read_planes(chunks, index).count() == 0 and index.count() == 0


def test_license_places_match_brute_force(spark):
    texts = ["Released UNDER the-MIT license. under the mit license", "Apache License, Version 2.0; licensed under CC-BY-NC 4.0 cc by nc", "under the mıt license", "under the mit license " * 300,
             "GNU Lesser General Public License, version 3", "under the MİT license; K", "Licensed under the Apache License, Version 2.0."]
    rows = EDGES + [(10 + i, t) for i, t in enumerate(texts)]
    df = licenses.scan_licenses(docs(spark, rows))
    base = licenses.base_places(F.col("words_"))
    got = df.select("doc_id", "text", "n_words", *[c.alias(f"{x}{k}") for k, (_, n, f, z) in enumerate(base) for x, c in (("n", n), ("f", f), ("z", z))]).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert len(got) == len(rows)
    for r in got:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        assert r.n_words == len(w)
        for k, (phrase, _) in enumerate(licenses.BASE):
            q = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            assert (r[f"n{k}"], r[f"f{k}"], r[f"z{k}"]) == (len(at), min(at, default=None), max(at, default=None)), r.text[:50]
    labels = {r.doc_id: [x.label for x in r.licenses_] for r in df.collect()}
    assert labels[14] == ["lgpl-3"] and labels[16] == ["apache-2"] and labels[5] == []
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_base_places_come_through_the_rules(spark):
    texts = ["cc by nc", "this text is cc by nc and no more", "licensed under the mit license", "Licensed under the Apache License, Version 2.0. under the mit license", "cc by nc sa 4.0 cc-by-nc", "no license here"]
    df = licenses.scan_licenses(docs(spark, EDGES + [(10 + i, t) for i, t in enumerate(texts)]))
    plain = licenses.base_places(F.col("words_"))
    for r in df.select("doc_id", "base", "licenses_", *[c.alias(f"{x}{k}") for k, (_, n, f, z) in enumerate(plain) for x, c in (("n", n), ("f", f), ("z", z))]).collect():
        for k, (_, label) in enumerate(licenses.BASE):
            at = [x.first for x in r.base if x.rule == f"base/{label}"]
            assert (len(at), min(at, default=None), max(at, default=None)) == (r[f"n{k}"], r[f"f{k}"], r[f"z{k}"]), r.doc_id
        assert r.doc_id != 10 or r.licenses_
        assert r.doc_id != 12 or len(r.base) == 1 and r.licenses_[0].rule == "mit/1"


def test_containment_by_brute_force(spark):
    text = "spdx license identifier mit licensed under the mit license and the gnu general public license version 3 license under apache 2 0 license"
    df = docs(spark, [(1, text)]).select("doc_id", licenses.blanked("text").alias("w"))
    spans = licenses.detections(F.col("w"), licenses.rules())
    row = df.select(spans.alias("a"), licenses.outermost(spans).alias("b")).head()
    every = [(x.first, -x.back, -x.low, i) for i, x in enumerate(row.a)]
    left = [i for a, b, p, i in every if not any(j < i and c <= a and d >= b and q >= p for c, d, q, j in every)]
    assert [row.a[i] for i in left] == row.b and 0 < len(left) < len(every)


def drawn(pattern, rng):
    """A random string that the pattern matches."""
    def walk(parts):
        out = ""
        for op, v in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(v)
            elif name == "IN":
                kind, x = rng.choice(v)
                out += chr(x if str(kind) == "LITERAL" else rng.randint(*x))
            elif name == "BRANCH":
                out += walk(rng.choice(v[1]))
            elif name == "SUBPATTERN":
                out += walk(v[3])
            elif name == "MAX_REPEAT":
                out += "".join(walk(v[2]) for _ in range(rng.randint(v[0], v[1])))
            else:
                assert name == "ASSERT"
        return out
    return f" {walk(re._parser.parse(pattern))} "


def test_every_form_of_every_license_rule_passes_the_filters(spark):
    import random

    rng = random.Random(7)
    for r in licenses.rules():
        for _ in range(200):
            text = drawn(r.pattern, rng)
            assert re.search(r.pattern, text), (r.rule, text)
            assert r.cue in text and any(k in text for k in r.keywords) and any(g in text for g in licenses.GATE), (r.rule, text)
    want = {"licensed under GPL2": "gpl-2", "licensed under LGPL3": "lgpl-3", "under the AGPL3 license": "agpl-3", "licensed under MPL2": "mpl-2", "licensed under EPL1": "epl-1",
            "released under Apache2": "apache-2", "SPDX-License-Identifier: GPL": "gpl", "see EUPL1.2 there": "eupl"}
    got = licenses.scan_licenses(docs(spark, list(enumerate(want)))).collect()
    assert all(want[r.text] in [x.label for x in r.licenses_] for r in got), [(r.text, r.licenses_) for r in got]


def luhn(number):
    d = [int(c) for c in number][::-1]
    return sum(d[0::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["+1 (663) 555-6869, 212-555-0199", "4785380592391139 and 4111 1111 1111 1111", "4785380592391138 stays", "8.196.197.208 but not 999.1.1.1",
             "re.46@mail8.example.com", "1987-02-28 2023/12/01 not 1987-02-30", "again 4785380592391139 1987-02-28", "code 1eb9c654e721b4f812088970e66a6345cee33dd6"]
    rows = EDGES + [(10 + i, t) for i, t in enumerate(texts)]
    got = pseudonyms.pseudonymise(docs(spark, rows), "key").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [r.text for r in got if r.doc_id in (1, 2, 3, 4, 5, 12, 17)] == [t for i, t in rows if i in (1, 2, 3, 4, 5, 12, 17)]
    shape = lambda t: re.sub("[0-9]", "9", re.sub("[a-z]", "a", t))
    assert all(shape(by[i].text) == shape(dict(rows)[i]) for i in (10, 11, 14, 15, 16))
    card = by[11].found_[0].pseudonym
    assert luhn(card) and card != "4785380592391139" and card in by[16].text and luhn(by[11].found_[1].pseudonym.replace(" ", ""))
    assert by[16].found_[1].pseudonym in by[15].text and "not 1987-02-30" in by[15].text and "999.1.1.1" in by[13].text
    assert pseudonyms.pseudonymise(docs(spark, []), "key").count() == 0


def test_pseudonyms_of_all_shapes_of_phones_and_dates(spark):
    values = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (663) 155-7713", "(012) 055-7713", "017-155-7713", "+49 30 12345678", "+33 6 12 34 56 78", "+44 (0)20 7946 0958", "+4930123456", "06 12 34 56 78",
              "28.02.1987", "02/28/1987", "28-02-1987"]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs(spark, [(i, f"call {v}, or {v} 190.137.223.204") for i, v in enumerate(values)]), "key").collect()}
    for i, v in enumerate(values):
        one, two, address = (f.pseudonym for f in got[i].found_)
        assert one == two and v not in got[i].text and "190.137.223.204" not in got[i].text and re.sub("[0-9]", "9", one) == re.sub("[0-9]", "9", v), v
    assert not {"date"} ^ {f.kind for i in (10, 11, 12) for f in got[i].found_[:2]} and not {"phone"} ^ {f.kind for i in range(10) for f in got[i].found_[:2]}
    days = [got[i].found_[0].pseudonym.replace("/", "-").replace(".", "-") for i in (10, 11, 12)]
    assert len(set(days)) == 1
    area = F.concat(F.lit("+1 ("), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(") "), F.lit("0"), F.lpad(F.floor(F.col("id") / 1000).cast("string"), 2, "0"), F.lit("-5555"))
    both = spark.range(100_000).select(area.alias("v")).select("v", pseudonyms.pseudonym(F.col("v"), F.lit("phone"), "k").alias("p"))
    row = both.agg(F.countDistinct("p").alias("n"), F.sum((F.substring("v", 5, 1).isin("0", "1") != F.substring("p", 5, 1).isin("0", "1")).cast("int")).alias("moved")).head()
    assert tuple(row) == (100_000, 0)


def test_pseudonyms_are_permutations(spark):
    days = spark.range(73_049).select(pseudonyms.permuted_day(F.col("id"), "k").alias("d")).agg(F.countDistinct("d"), F.min("d"), F.max("d")).head()
    assert tuple(days) == (73_049, 0, 73_048)
    assert spark.range(10_000).select(pseudonyms.permuted(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("d")).distinct().count() == 10_000


def test_secrets_are_told_from_look_alikes(spark):
    import random

    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [(None, None), (1, ""), (2, LONG)], set()
    for i in range(200):
        v = hexa(rng.choice((20, 32, 40)))
        w = "".join(rng.choice(["ther", "ation", "ing", "and", "with", "from"]) for _ in range(6))
        kind = i % 4
        rows.append((10 + i, [f"the token = \"{v}\" there", f"see commit {v} in the log", f"with {w} and from there", f"password={v}"][kind] + " and with the other from there"))
        want |= {10 + i} if kind in (0, 3) else set()
    df = docs(spark, rows)
    found = secrets.candidates(df, F.col("source"))
    labelled = found.withColumn("label", F.col("doc_id").isin(sorted(want)).cast("int")).filter("doc_id % 3 <> 0")
    got = {r.doc_id for r in secrets.scan_secrets(df, labelled, "source").collect()}
    test = {10 + i for i in range(200) if (10 + i) % 3 == 0}
    assert len((got ^ want) & test) <= 0.05 * len(test)
    assert secrets.scan_secrets(docs(spark, [])).count() == 0
    assert secrets.scan_secrets(docs(spark, [(1, "token = abcdefghijk0123456789")])).head().probability == 1.0


def brute_tiles(item, text, least):
    """Longest common unmarked run first, one at a time."""
    a, b, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and a[i + n] and b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        a[i : i + n], b[j : j + n] = [False] * n, [False] * n
        covered += n


def test_tiles_match_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        cut = rng.randint(0, len(item))
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))] + item[cut:] + ["x"] + item[:cut] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        got, want = tiling.tile(item, text, 3), brute_tiles(item, text, 3)
        assert abs(got - want) <= 3 and got <= len(item)  # ties of equal length may be marked in another order
        assert got >= sum(n for n in (cut, len(item) - cut) if n >= 3) - 3


def test_tiles_equal_brute_force():
    import random

    item = [f"w{i}" for i in range(18)]
    assert tiling.tile(item, [*item[5:13], "x", *item[0:7], *(f"z{i}" for i in range(20))], 5) == 13  # the head of a match under an earlier tile counts
    rng = random.Random(11)
    for k in range(600):
        letters = "ab" if k % 3 == 0 else "abcdefgh"
        item = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        cuts = sorted(rng.randint(0, len(item)) for _ in range(2))
        text = [rng.choice(letters) for _ in range(rng.randint(0, 10))] + item[cuts[0] :] + ["x"] * rng.randint(0, 1) + item[: cuts[1]] + [rng.choice(letters) for _ in range(rng.randint(0, 10))]
        for least in (2, 3, 5):
            assert tiling.tile(item, text, least) == brute_tiles(item, text, least), (item, text, least)
    for _ in range(100):  # passages that share words at their borders, out of order, in a longer text
        item = [f"w{i}" for i in range(rng.randint(15, 30))]
        text = [f"z{i}" for i in range(30)]
        for _ in range(3):
            at = rng.randint(0, len(item) - 5)
            text += [*item[at : at + rng.randint(5, 9)], "x"]
        assert tiling.tile(item, text, 5) == brute_tiles(item, text, 5), (item, text)


def test_benchmark_items_are_found_in_any_order(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wizards boil a quart of milk"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"),
                                   (3, None), (None, "lonely words without an id here now"), (4, "tiny item"), (5, "")], "item_id long, text string")
    rows = EDGES + [(10, "Seven wizards boil a quart of milk, while... the quick brown fox jumps over the lazy dog!"), (11, "alpha beta gamma delta epsilon but no more"), (12, "alpha beta gamma"), (13, "a tiny item here"), (14, LONG + " alpha beta gamma delta epsilon zeta eta theta " + LONG)]
    for size in (500_000, 10):
        got = tiling.find_items(docs(spark, rows), bench, words_per_pass=size)
        assert got.count() == len(rows) and got.columns[-1] == "hits_"
        assert {(r.doc_id, h.item_id) for r in got.collect() for h in r.hits_} == {(10, 1), (11, 2), (13, 4), (14, 2)}
    assert tiling.find_items(docs(spark, rows), bench.limit(0)).filter("size(hits_) > 0").count() == 0
    assert tiling.find_items(docs(spark, []), bench).count() == 0


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best one, then what lies left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    _, _, i, j = max((total[j] - total[i], i - j, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    return brute_segments(scores[:i]) + [(i, j - 1, total[j] - total[i])] + [(j + a, j + b, s) for a, b, s in brute_segments(scores[j:])]


def shifted(found, by):
    return [(a + by, b + by, s) for a, b, s in found]


def test_segments_match_their_definition():
    rng = np.random.RandomState(1)
    for _ in range(200):
        s = np.where(rng.rand(rng.randint(1, 40)) < 0.3, rng.uniform(0.5, 4, 1)[0] + rng.rand(1)[0], -0.37)
        s = np.where(s > 0, s + rng.rand(len(s)), s)
        got, want = toxicity.maximal_segments(s, -0.37), brute_segments(s)
        assert [(a, b, round(x, 6)) for a, b, x in got] == [(a, b, round(x, 6)) for a, b, x in want]


def test_toxic_rows_are_told_on_held_out_labels(spark):
    import random

    rng = random.Random(9)
    usual, bad = [f"w{i}" for i in range(300)], ["vilething", "vileword", "nastyone", "nastytwo"]
    rows, labels = list(EDGES), []
    for i in range(600):
        words = [rng.choice(usual) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 4 == 0)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(4)]
        rows.append((100 + i, " ".join(words)))
        labels.append((100 + i, toxic))
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = toxicity.learning_rows(lab.filter(~toxicity.held_out()), 10_000)
    assert {r.doc_id for r in train.collect()} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    model = toxicity.learn(df, train)
    found = toxicity.find_segments(df, model)
    assert found.columns[-2:] == ["evidence", "segments_"] and found.count() == len(rows)
    slope, offset = toxicity.calibrate(found.join(train, "doc_id"))
    model = model._replace(slope=slope, offset=offset)
    score = {r.doc_id: r.s for r in found.select("doc_id", toxicity.probability(model, "evidence").alias("s")).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((score[i] >= 0.7) == bool(t) for i, t in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in score.values()) and score[2] < 0.5
    assert toxicity.learn(df, train.limit(0)).odds == {} and toxicity.find_segments(docs(spark, []), model).count() == 0
