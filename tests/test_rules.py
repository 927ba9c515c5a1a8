"""Rules on small hand-made rows, most of them against a brute-force version."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from galleyspark.functions import arrow, cutting, keys
from galleyspark.operators import columns, editorial, matching, ranking, rollups, state, transcripts, windows
from galleyspark.operators.ordered import Running, prefix_scan


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_prefix_scan_equals_loop(spark):
    rng = random.Random(1)
    rows = [(k, i // 4, i, rng.choice([None, rng.randint(0, 9)])) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, blk int, i int, v int")
    got = prefix_scan(df, ["k"], ["blk"], ["i"], total=Running("sum", "v"), top=Running("max", "v", before=True), last=Running("last", "v", before=True))
    plain = prefix_scan(df, ["k"], [], ["i"], total=Running("sum", "v"), top=Running("max", "v", before=True), last=Running("last", "v", before=True))
    want = []
    for k in range(3):
        total, top, last = 0, None, None
        for _, _, i, v in [r for r in rows if r[0] == k]:
            before = (top, last)
            if v is not None:
                total, top, last = total + v, v if top is None else max(top, v), v
            want.append((k, i, total, *before))
    for out in (got, plain):
        assert [tuple(r) for r in out.select("k", "i", "total", "top", "last").orderBy("k", "i").collect()] == sorted(want, key=lambda r: r[:2])


def test_edition_cap_and_sixth(spark):
    rows = [(date(2024, 1, 1), i, i, f"S {i}", "A" if i < 8 else "B", 2 if i < 7 else 1, 5) for i in range(10)] + [(date(2024, 1, 1), 90, 90, "s  0", "A", 2, 5)]
    df = spark.createDataFrame(rows, "day date, item_id int, ordinal int, source string, tier string, level int, stars int")
    assert [r.item_id for r in ranking.select_edition(df).orderBy("slot").collect()] == [0, 1, 2, 3, 4, 5]
    assert ranking.select_edition(df, 3).count() == 3
    assert ranking.select_edition(df.filter("item_id = 0 or item_id = 90")).count() == 1
    assert [ranking.clamp_cap(x) for x in ("9", "1", "bad", None, "4")] == [5, 3, 5, 5, 4]


def _fair(rows, day):
    """Round robin and 2:1 merge, item by item."""
    def groups(state, tier):
        g = {}
        for r in rows:
            if r["state"] == state and r["tier"] == tier:
                g.setdefault(r["source_no"], []).append(r)
        g = [g[k] for k in sorted(g)]
        off = day.toordinal() % len(g) if len(g) > 1 else 0
        return g[off:] + g[:off]

    def merge(a, b):
        out = []
        while a or b:
            out += a[:2] + b[:1]
            a, b = a[2:], b[1:]
        return out

    def robin(gs):
        return [g[i] for i in range(max(map(len, gs), default=0)) for g in gs if i < len(g)]

    done = []
    for state_ in ("new", "retry"):
        a, b = groups(state_, "A"), groups(state_, "B")
        part = merge([g[0] for g in a], [g[0] for g in b]) + merge(robin([g[1:] for g in a]), robin([g[1:] for g in b]))
        done += sorted(part, key=lambda r: not r["has_feed"])
    return [r["item_id"] for r in sorted(done, key=lambda r: (not r["has_feed"], not r["dated"]))]


def test_fair_order_equals_loops(spark):
    rng = random.Random(4)
    day = date(2024, 3, 5)
    rows = [dict(day=day, item_id=i, ordinal=i, tier=rng.choice("AB"), source="", source_no=rng.randint(0, 5), state=rng.choice(["new", "new", "retry"]), has_feed=rng.random() < 0.7, dated=rng.random() < 0.8) for i in range(70)]
    for r in rows:
        r["tier"] = "A" if r["source_no"] < 3 else "B"
    df = spark.createDataFrame(rows)
    got = [r.item_id for r in ranking.fair_candidate_order(df).orderBy("position").collect()]
    assert got == _fair(rows, day)


def test_attach_unique_best_equals_loop(spark):
    rng = random.Random(7)
    pairs = sorted({(i, v): round(rng.choice([0.7, 0.75, 0.8, 0.85, 0.95]), 2) for i in range(25) for v in rng.sample(range(20), 3)}.items())
    df = spark.createDataFrame([("s", i, i, v, v, float(x)) for (i, v), x in pairs], "source string, r_item_id int, r_ord int, v_item_id int, v_ord int, score double")
    unused, want = set(range(20)), []
    for i in range(25):
        m = sorted((x, v) for (a, v), x in pairs if a == i and v in unused)
        if m and (len(m) == 1 or m[-1][0] - m[-2][0] >= 0.08):
            unused.discard(m[-1][1])
            want.append((i, m[-1][1]))
    assert values(matching.attach_unique_best(df), "r_item_id", "v_item_id") == want


def test_daily_quota_equals_loop(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=rng.randint(0, 8 * 1440)), i, rng.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "stream string, at timestamp, seq int, asset long").withColumn("day", F.to_date("at"))
    held, used, want = set(), {}, []
    for _, at, _, asset in sorted(rows, key=lambda r: (r[1], r[2])):
        if used.get(at.date(), 0) < 3 and asset not in held:
            held.add(asset)
            used[at.date()] = used.get(at.date(), 0) + 1
            want.append((at.date(), asset, used[at.date()]))
    assert values(rollups.daily_quota(df, 3), "day", "asset", "slot") == sorted(want)


def test_links():
    cases = {"https://Example.com:443/a/?b=2&utm_source=x&a=1#f": "https://example.com/a?a=1&b=2", "http://example.com": "https://example.com", "https://example.com:8443/x/": "https://example.com:8443/x", "ftp://example.com": "", "nonsense": ""}
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", keys.url_key("u").alias("k"))
    assert {r.u: r.k for r in df.collect()} == cases


def test_scores(spark):
    rows = [(1, 5, 5, "none", 2, "high", "high", "值得编译"), (2, 5, 1, "lab", 1, "high", "high", "值得编译"), (3, 2, 2, "lab", 1, "high", "high", "看摘要"), (4, 5, 5, "none", 1, "low", "high", "值得编译"), (5, 3, 5, "none", 2, "high", "low", "值得编译")]
    df = spark.createDataFrame(rows, "item_id int, relevance int, density int, priority string, quotes int, evidence_quality string, ai_share string, recommendation string")
    plain = {r.item_id: (r.stars, r.error) for r in editorial.score_reviews(df).collect()}
    assert plain == {1: (5, None), 2: (4, None), 3: (4, "priority_without_relevance"), 4: (5, "density_needs_two_quotes"), 5: (4, None)}
    strict = {r.item_id: (r.stars, r.advice) for r in editorial.reading_advice(editorial.score_reviews_strict(df)).collect()}
    assert strict[1] == (5, "值得编译") and strict[2][0] == 3 and strict[3] == (2, "无关") and strict[4] == (2, "无关") and strict[5] == (3, "值得看摘要")


def longest_end(text, low, high, marks):
    """Largest end in (low, high] such that one of the marks ends there, else high."""
    return max((i for i in range(low + 1, high + 1) if any(text[:i].endswith(m) and i - len(m) >= low for m in marks)), default=high)


def test_pieces_rebuild_the_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "end. ", "\n", "\n\n", "句。", "x" * 40, "😀"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("text", cutting.citation_chunks("text").alias("c"), cutting.evidence_chunks("text").alias("e"), cutting.sentence_chunks("text").alias("s")).collect():
        assert "".join(r.c) == r.text and all(0 < len(p) <= 2200 for p in r.c)
        assert "".join(r.e) == r.text
        rest = r.text
        for p in r.e:
            assert len(p) == (len(rest) if len(rest) <= 450 else longest_end(rest, 200, 450, [" "]))
            rest = rest[len(p):]
        assert all(len(p) <= 1200 and p.strip() for p in r.s) and "".join("".join(r.s).split()) == "".join(r.text.split())
        for p in r.s[:-1]:
            assert len(p) == 1200 or p[-1] in "\n。.?!" and len(p) > 600


def test_captions_lose_only_overlaps(spark):
    rng = random.Random(6)
    rows = [(0, ["a b c", "b c d", "d"]), (1, []), (2, ["", " x  y ", "y x", "y"]), (3, [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)])]

    def joined(chunks):
        text = []
        for new in map(str.split, chunks):
            text += new[max(n for n in range(31) if n <= len(new) and n <= len(text) and text[len(text) - n:] == new[:n]):]
        return " ".join(text)

    got = dict(spark.createDataFrame(rows, "i int, c array<string>").select("i", cutting.merged_captions("c")).collect())
    assert got == {i: joined(c) for i, c in rows} and got[0] == "a b c d"
    assert arrow.greedy_batches([10, 4000, 10, 10]) == [0, 1, 2, 2]


def test_cleaning_keeps_evidence(spark):
    text = "\n".join(["Host: Welcome back.", "Host: This episode is sponsored by Acmeware and friends.", "Host: Their revenue rose 40% last year.", "Host: Visit acmeware.com to sign up.", "Guest: Um.", "[Laughter]", "Guest: So the margin fell.", "Guest: Thanks for listening!"])
    unended = "Host: This episode is sponsored by Acmeware.\nGuest: A new voice talks of acmeware."
    df = spark.createDataFrame([(1, text, False), (2, unended, False)], "item_id int, text string, is_caption boolean")
    rows = transcripts.clean_transcripts(df).orderBy("item_id", "island").collect()
    one = " / ".join(r.text for r in rows if r.item_id == 1)
    assert "40%" in one and "margin fell" in one and "sponsored" not in one and "acmeware.com" not in one and "Um." not in one and "listening" not in one
    assert {(r.stages, r.fillers) for r in rows if r.item_id == 1} == {(1, 1)}
    assert "sponsored" in " ".join(r.text for r in rows if r.item_id == 2)


def test_coverage_rules_differ(spark):
    rows = [("a", 0.0, 1000.0, 1000.0), ("a", 500.0, 520.0, 1000.0), ("b", 0.0, 500.0, 1000.0), ("b", 545.0, 1000.0, 1000.0)]
    df = spark.createDataFrame(rows, "item_id string, start double, end double, duration double")
    strict = {r.item_id: (r.complete, r.covered) for r in windows.strict_coverage(df).collect()}
    caption = {r.item_id: (r.complete, r.covered) for r in windows.caption_coverage(df).collect()}
    assert strict == {"a": (False, 1000.0), "b": (True, 955.0)} and caption == {"a": (True, 1000.0), "b": (True, 955.0)}


def test_compaction_keeps_protected_sentences(spark):
    p = ["开头。普通的一句话说明情况。他可能离开。收入有30亿。又一句普通的话在这里说。", "第二段开始。没有别的。"]
    df = spark.createDataFrame([(1, p)], "item_id int, paragraphs array<string>")
    out = transcripts.extractive_compact(df, 0.3).first().paragraphs
    assert len(out) == 2 and out[0].startswith("开头。") and "可能" in out[0] and "30" in out[0]
    checks = spark.createDataFrame([(1, "若成本下降则Acme3可能扩产30%。", "成本下降，扩产20%。")], "item_id int, source_text string, short_text string")
    found = set(transcripts.compression_checks(checks, 0.5).first().problems.split(","))
    assert {"connectors", "conditionals", "numbers_missing", "numbers_new", "names", "hedges"} <= found


def test_targets_and_quotes(spark):
    df = spark.createDataFrame([(1, "chat_id", "oc_a"), (2, "open_id", "ou_b"), (3, "chat_id", "ou_c"), (4, "chat_id", "oc_")], "seq int, kind string, target string")
    assert values(columns.valid_targets(df), "seq") == [(1,), (2,)]
    assert columns.valid_targets(df, None, require=True).count() == 0
    assert spark.createDataFrame([("don't stop 中文 a-b",)], "t string").select(columns.quote_units("t")).first()[0] == 5


def test_safe_public_url_is_one_search(spark):
    good = ["https://a.org", "HTTPS://a.org:443/x", "https://a.org:0443?q", "https://a.org:#f", "https://[::1]:443/", "https://a.org\n", "https://a.org:443\n", "https://a.org/u@b:1", "https://é.fr/"]
    bad = ["http://a.org", "https://", "https://:443", "https://a.org:80", "https://a.org:000443", "https://a.org:443:443", "https://u@a.org", "https://[::1]:80", "https://[a]:443:443", "https://[ab]:443x", "x https://a.org", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string").withColumn("safe", keys.safe_public_url("u"))
    assert "regexp_extract" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.u: r.safe for r in df.collect()} == {u: u for u in good} | dict.fromkeys(bad)


def test_prefixes_of_a_feed_are_known_by_their_declaration(spark):
    from galleyspark.sources.feeds import with_known_prefixes

    itunes, other = "http://www.itunes.com/dtds/podcast-1.0.dtd", "http://example.org/"
    docs = {f'<rss xmlns:z="{other}" xmlns:it = \'{itunes}\'><it:d>1</it:d><z:d/><it.x:d/></rss>': f'<rss xmlns:z="{other}" xmlns:it = \'{itunes}\'><itunes:d>1</itunes:d><z:d/><it.x:d/></rss>',
            f'<rss xmlns:itunes="{itunes}"><itunes:d/></rss>': None, "<rss><it:d/></rss>": None}
    df = spark.createDataFrame([(d,) for d in docs], "x string")
    assert {r.x: r.y for r in df.withColumn("y", with_known_prefixes(F.col("x"))).collect()} == {k: v or k for k, v in docs.items()}


def test_resolve_unique_asset_takes_one_asset_however_often_it_is_found(spark):
    rows = [(1, 10, True, False), (1, 10, True, False), (2, 10, True, True), (2, 11, True, False), (2, 10, True, False), (3, 10, True, True), (3, 11, True, True), (3, 12, True, False),
            (4, 10, False, True), (4, 11, True, False), (5, 10, False, True), (6, 10, True, False), (6, 11, True, False)]
    df = spark.createDataFrame(rows, "item_id int, asset_id int, transcribed boolean, is_enclosure boolean")
    assert values(matching.resolve_unique_asset(df), "item_id", "asset_id", "state") == [
        (1, 10, "resolved"), (2, 10, "resolved"), (3, None, "ambiguous"), (4, 11, "resolved"), (5, None, "none"), (6, None, "ambiguous")]
