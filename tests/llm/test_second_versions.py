"""Second versions of operators that SQL cannot express, in plain loops."""

import hashlib
import math
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from galleyspark.llm import importance, pseudonyms

ALL = (1 << 64) - 1


def plain_permuted(value, key, tweak):
    """The Feistel network, a round at a time."""
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, 9):
        digest = bytes.fromhex(hashlib.sha256(f"{key}|{tweak}|{i}|{right}".encode()).hexdigest())
        moved = ""
        for k, c in enumerate(left):
            by = digest[k % 32] + k // 32
            low, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (None, None)
            moved += chr((ord(c) - low + by) % n + low) if n else c
        left, right = right, moved
    return left + right


def test_network_of_pseudonyms_equals_a_loop(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789") for _ in range(n)) for n in (1, 2, 3, 7, 15, 18)] + ["Ann.Lee-7", "x" * 90 + "Y9", "a", ""]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonyms.permuted(F.col("v"), "key", "card").alias("p")).collect()
    assert {r.v: r.p for r in got} == {v: plain_permuted(v, "key", "card") for v in values}


def test_mail_addresses_of_endless_hosts_do_not_stop_the_session(spark):
    rows = [(1, "write to a@" + "b." * 500_000 + "com"), (2, "a@" + "b." * 500_000), (3, "ann@mail.example.org, " * 20_000)]
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert len(out[3].found) == 20_000 and "ann@" not in out[3].text and len({f.pseudonym for f in out[3].found}) == 1
    assert not out[1].found and not out[2].found and out[1].text == rows[0][1]  # no host has so many labels


def plain_grams(text):
    """Buckets of words and pairs of a text."""
    codes, last = [], None
    for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower()):
        h = xxhash.xxh3_64_intdigest(w)
        codes.append(int(importance.AGAIN) if h == last else h)
        last = h
    mix = int(importance.MIX)
    return [c >> 48 for c in codes] + [((a * mix + b) * mix & ALL) >> 48 for a, b in zip(codes, codes[1:], strict=False)]


def test_importance_sample_equals_a_plain_version(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [(1, None), (2, ""), (3, "word5 word6 " * 3000), (3, "word5 word6 " * 3000), (None, "word1 word1 word2")], []
    for i in range(10, 160):
        good = i % 3 > 0
        rows.append((i, " ".join(rng.choice(words if good else words[:9]) for _ in range(rng.randint(1, 120)))))
        if i % 2:
            labels.append((i, int(good)))
    labels += [(None, 1), (11, None), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    known = dict(x for x in labels if None not in x)

    raw, target = np.zeros(1 << 16), np.zeros(1 << 16)
    for i, text in rows:
        for g in plain_grams(text):
            raw[g] += 1
            target[g] += known.get(i) == 1
    ratio = np.log((target + 1) / (target.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))
    weight = [64 * float(np.mean(ratio[g])) if (g := plain_grams(t)) else 0.0 for _, t in rows]
    noise = {r.doc_id: -math.log(-math.log((r.h % (1 << 40) + 0.5) / (1 << 40))) for r in docs.selectExpr("doc_id", "xxhash64('gumbel', doc_id) AS h").collect()}
    seen = sorted({(round(w, 6), known[i]) for (i, _), w in zip(rows, weight, strict=True) if i in known})
    good, bad = sum(q for _, q in seen), sum(1 - q for _, q in seen)
    cuts = [((a + b) / 2, sum(1 - q for w, q in seen if w <= a) / bad - sum(q for w, q in seen if w <= a) / good) for (a, _), (b, _) in zip(seen, seen[1:], strict=False) if b > a]
    at = max(cuts, key=lambda c: (c[1], -c[0]))[0]
    keys = [w + noise[i] for (i, _), w in zip(rows, weight, strict=True)]
    cut = sorted(keys, reverse=True)[sum(w >= at for w in weight) - 1]
    want = sorted((str(i), round(w, 3), k >= cut - 1e-9) for (i, _), w, k in zip(rows, weight, keys, strict=True))
    assert sorted((str(r.doc_id), round(r.log_weight, 3), r.kept) for r in got) == want
    assert 0 < sum(k for _, _, k in want) < len(want)
