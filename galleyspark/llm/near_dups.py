"""MinHash near duplicates by an inverted join of signature coordinates.

A text is the set of its distinct word shingles. Texts of one set are one representative. A representative is posted under its
coordinate-value pairs ("tokens"). Two sets over the similarity agree in ``matches`` of ``coordinates`` values (a miss has a chance of
about 1e-8), so they share one of the ``coordinates - matches + 1`` rarest tokens of either: only those prefixes are posted,
and the long lists are skipped; the full signatures count their collisions. Every pair that is kept is confirmed on the full sets.

A list may hold a third of all texts, so its pairs are never listed:

* Pivots. Each text of a list is paired with the list's smallest id, its pivot. That links most of a group of copies in linear work.
* Differences. The texts met under the pivots of one component form a family with the component's root r; D(x) = x xor r. x and y
  are similar if and only if D(x) and D(y) share at least (|D(x)| + |D(y)| - (1 - s)/(1 + s) (|x| + |y|)) / 2 shingles, which is positive
  unless both are similar to r already. So a prefix join on the rarest differences, with that bound by bands of its
  terms, finds all links that the pivots don't show. What sets copies apart is rare, so prefixes are short.
* Others. Pairs in which one text is far from the pivot of the list are joined directly; those with a text linked to the pivot
  are out by the triangle inequality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import WordHash, bounded_batches, discard, merged, portions, query, settle, table

COORDINATES, MATCHES, FAMILY = 40, 16, 10
BANDS, FAR_BANDS, FAR_STEP = 8, 24, 1.1
SLOTS = 1 << 23
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes | None], words: WordHash, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ``size`` words, or all words where there are fewer. A-Z count as a-z; words
    are cut at ASCII white space. Bytes do just this in lower() and split()."""
    code, sizes = words.codes([(t or b"").lower().split() for t in texts])
    ends = np.cumsum(sizes)
    rolled = np.full(max(len(code) - size + 1, 0), size, np.uint64)
    for k in range(size):
        rolled = rolled * MIX + code[k : len(code) - size + 1 + k]
    rolled = (rolled ^ (rolled >> np.uint64(31))) * ODD
    out = []
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[end - n : end - size + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for c in code[end - n : end]:
                h = h * MIX + c
            out.append((h ^ (h >> np.uint64(31))) * ODD)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def multipliers(coordinates: int) -> np.ndarray:
    return np.random.RandomState(20).randint(0, 1 << 62, coordinates).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def features(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n (set size), key (128-bit hash of the set), sig (the minimum of each coordinate's hash, 32 bits)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, by = WordHash(), multipliers(coordinates)
        for batch in portions(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words, size)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), coordinates), np.int32)
            if len(full):
                flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                for j, a in enumerate(by):
                    low = np.minimum.reduceat((flat * a) >> np.uint64(32), starts)
                    sig[full, j] = low.astype(np.uint32).view(np.int32)
            values = pa.array(sig.ravel())
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                              pa.ListArray.from_arrays(offsets, values)], ["doc_id", "n", "key", "sig"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, key binary, sig array<int>")


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (1 MB) of the hashed ids: what it lacks is not among them."""
    slot = F.pmod(F.xxhash64("x"), F.lit(SLOTS))
    rows = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(x), {SLOTS}) % 64 as int))")).alias("b")).collect()  # at most SLOTS / 64 rows
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[[r.w for r in rows]] = [r.b for r in rows]
    return bits.view(np.uint64)


def full_sets(docs: DataFrame, ids: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """x, s: the shingle sets of the representatives in ``ids(x)``, from their texts. The bitmap keeps most other texts out, the join all of them,
    so that sets are shuffled and texts are not."""
    import xxhash

    bounded_batches(docs.sparkSession)
    wanted = merged(reps).join(ids.select("x").distinct(), "x", "left_semi").select("x", "doc", "key")
    bits = id_bits(wanted.select(F.col("doc").alias("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            slot = batch.column("slot").to_numpy().astype(np.uint64)
            held = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            for part in portions([batch.filter(pa.array(held.astype(bool)))], "text"):
                sets = shingle_sets(part.column("text").to_pylist(), words, size)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                                  pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc", "key", "s"])

    x = F.col("doc_id").cast("long")
    texts = docs.filter(x.isNotNull()).select(x.alias("doc"), F.pmod(F.xxhash64(x), F.lit(SLOTS)).alias("slot"), F.col("text").cast("string").cast("binary").alias("text"))
    sets = texts.mapInArrow(run, "doc long, key binary, s array<long>")
    return settle(merged(sets).join(wanted, ["doc", "key"]).groupBy("x").agg(F.first("s").alias("s")))


def collisions(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def prefixes(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """token, x: each representative under its rarest tokens. Tokens of one text are the rarest of all; they need no list."""
    tokens = reps.select("x", F.posexplode("sig").alias("j", "v")).select("x", (F.col("j").cast("long") * (1 << 32) + F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    multi = merged(tokens).join(shared, "token").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("list"))
    room = F.greatest(F.lit(coordinates - matches + 1 - coordinates) + F.size("list"), F.lit(0))
    return multi.select("x", F.explode(F.slice("list", F.lit(1), room)).alias("t")).select("t.token", "x")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, for nodes of ``links(a, b)``; by alternating large-star and small-star steps.

    Each round is one table in the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    spark, mark, last = edges.sparkSession, F.struct(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))), None
    while (now := edges.agg(mark).head()[0]) != last:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").union(down.select("hi", F.col("m").alias("lo"))).distinct()
        before, edges, last = edges, settle(small), now
        discard(spark, before)
    found = settle(edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct()))
    discard(spark, edges)
    return found


def near_links(docs: DataFrame, reps: DataFrame, size: int, similar: int, coordinates: int, matches: int, family: int) -> list[DataFrame]:
    """Tables of a, b: links between representatives, enough of them to reach all that similar pairs reach."""
    spark, s100, rest = docs.sparkSession, similar, 100 - similar
    linked = lambda both, n, m: 100 * both >= s100 * (n + m - both)
    near_size = lambda n, m: (100 * F.col(n) >= s100 * F.col(m)) & (100 * F.col(m) >= s100 * F.col(n))
    #: A set of n differs from a similar larger one only if n + 1 is within the similarity.
    able = reps.filter(f"n > 0 and 100 * n >= {s100} * (n + 1)")
    posted = settle(prefixes(able, coordinates, matches))
    lists = posted.groupBy("token").agg(F.min("x").alias("p"), F.count("*").alias("m")).filter("m > 1").drop("m")
    listed = settle(merged(posted).join(lists, "token"))
    discard(spark, posted)
    sig = merged(reps.select("x", "n", "sig"))
    sig_p = sig.select(F.col("x").alias("p"), F.col("n").alias("n_p"), F.col("sig").alias("sig_p"))
    pivots = listed.filter("x > p").select("x", "p").distinct().join(sig, "x").join(sig_p, "p")
    paired = settle(pivots.filter(collisions("sig", "sig_p") >= family).select("x", "p", "n", "n_p"))

    sets = full_sets(docs, paired.select("x").union(paired.select("p")), reps, size)

    def apart(pairs: DataFrame, p: str, n_p: str) -> DataFrame:
        """Pairs (x, p) with their differences ``d``, and ``near`` where they are similar."""
        both = pairs.join(merged(sets), "x").join(merged(sets.select(F.col("x").alias(p), F.col("s").alias("s_p"))), p)
        both = both.withColumn("d", F.concat(F.array_except("s", "s_p"), F.array_except("s_p", "s"))).drop("s", "s_p")
        return both.withColumn("near", linked((F.col("n") + F.col(n_p) - F.size("d")) / 2, F.col("n"), F.col(n_p)))

    kin = settle(apart(paired, "p", "n_p").drop("d"))
    discard(spark, paired)
    comp = components(kin.filter("near").select(F.col("x").alias("a"), F.col("p").alias("b")))
    of = lambda x, c: merged(comp.select(F.col("node").alias(x), F.col("component").alias(c)))

    # Families: the texts met under pivots of one component, with their differences to its root r. Roots that only see their own are done.
    met = kin.join(of("p", "r"), "p", "left").select("x", "n", F.coalesce("r", "p").alias("r"), F.when(F.col("r").isNull(), F.col("n_p")).alias("n_r"))
    met = met.filter("x <> r").groupBy("x", "n", "r").agg(F.max("n_r").alias("n_r")).join(of("x", "c"), "x", "left").withColumn("c", F.coalesce("c", "x"))
    met = met.join(met.filter("c <> r").select("r").distinct(), "r", "left_semi").drop("n_r").join(reps.select(F.col("x").alias("r"), F.col("n").alias("n_r")), "r")
    differing = settle(apart(met, "r", "n_r"))
    discard(spark, sets)
    named = differing.withColumn("kind", F.when(F.col("near"), "near").when(F.col("c") == F.col("r"), "chain").otherwise("new"))

    # own, of_r: the terms of the bound of a text and of the root; reach: the least term of a text that can be similar, as two similar texts are
    # about as far from r. Near texts lie in BANDS equal bands below of_r, far ones in FAR_BANDS bands above it, each FAR_STEP times as far.
    share = rest / (100 + s100)
    named = named.withColumns({"own": F.size("d") - share * F.col("n"), "of_r": share * F.col("n_r")})
    near_band = F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), F.floor((F.col("own") + F.col("of_r")) * BANDS / (2 * F.col("of_r"))))).cast("int")
    far_band = F.greatest(F.lit(0), F.least(F.lit(FAR_BANDS - 1), F.floor(F.log(F.greatest(F.col("own") / F.col("of_r"), F.lit(1.0))) / math.log(FAR_STEP)))).cast("int")
    named = settle(named.withColumns({"reach": F.col("own") - 2 * share * (F.col("n") * 100 / s100), "own_band": F.when(F.col("kind") == "near", near_band).otherwise(far_band + BANDS)}))
    discard(spark, differing)
    first = named.filter("near and c <> r").select(F.col("x").alias("a"), F.col("r").alias("b"))
    edge = lambda b: F.when(b <= BANDS, (b * 2 / BANDS - 1) * F.col("of_r")).otherwise(F.col("of_r") * F.pow(F.lit(FAR_STEP), b - BANDS))
    need = lambda b: F.greatest(F.lit(1), F.ceil((F.col("own") + edge(b)) / 2 - 1e-6))
    every = F.sequence(F.when(F.col("kind") == "chain", F.lit(BANDS)).otherwise(F.lit(0)), F.col("own_band"))
    able = F.filter(every, lambda b: (b == F.col("own_band")) | (edge(b + 1) + 1e-6 >= F.col("reach")))
    # A near text meets far ones only, in its own band; a far one meets others in the band of the nearer of the two, whose lower edge bounds that one.
    at_band = lambda b: F.struct(b.alias("band"), need(b).cast("long").alias("need"))
    as_near = F.array(F.struct(F.col("own_band").alias("band"), F.greatest(F.lit(1), F.ceil((F.col("own") + F.col("of_r")) / 2 - 1e-6)).cast("long").alias("need")))
    shape = "array<struct<band:int,need:long>>"
    parts = F.when(F.col("kind") == "near", as_near.cast(shape)).otherwise(F.transform(able, at_band).cast(shape))
    rows = named.select("r", "x", "c", "kind", F.explode("d").alias("e"))
    # Differences can show a link only where a new text has them and a near one (far = 0), or a far one of another component (far = 1).
    is_far = F.col("kind") != "near"
    often = rows.groupBy("r", "e").agg(F.count(F.when(F.col("kind") == "new", 1)).alias("new"), F.count("*").alias("f"), F.count(F.when(is_far, 1)).alias("f_far"),
                                       F.min(F.when(is_far, F.col("c"))).alias("c0"), F.max(F.when(is_far, F.col("c"))).alias("c1")).filter("new > 0")
    often = often.select("r", "e", "f", "f_far", (F.col("f") > F.col("f_far")).alias("in_near"), (F.col("c0") < F.col("c1")).alias("in_far")).filter("in_near or in_far")
    listed_by = lambda f, used: F.array_sort(F.collect_list(F.when(F.col(used), F.struct(f, "e"))))
    ranked = merged(rows.select("r", "x", "e")).join(often, ["r", "e"]).groupBy("r", "x").agg(listed_by("f", "in_near").alias("near_list"), listed_by("f_far", "in_far").alias("far_list"))
    ranked = ranked.join(merged(named.select("r", "x", "c", "n", "kind", "own_band", parts.alias("parts"))), ["r", "x"])
    # Differences that show no link come before those of the list.
    sized = ranked.select("r", "x", "c", "n", "kind", "own_band", "near_list", "far_list", F.explode("parts").alias("part")).filter("part.need is not null")
    room = lambda of: F.greatest(F.lit(0), (F.size(of) - F.col("part.need") + 1).cast("int"))
    in_use = F.when(F.col("part.band") < BANDS, F.transform(F.slice("near_list", F.lit(1), room("near_list")), lambda t: t["e"])).otherwise(
        F.transform(F.slice("far_list", F.lit(1), room("far_list")), lambda t: t["e"]))
    keyed = settle(sized.select("r", "x", "c", "n", "kind", (F.col("own_band") == F.col("part.band")).alias("own"), "part.band", F.explode(in_use).alias("e")))
    mates = keyed.select("r", "band", "e", F.col("x").alias("y"), F.col("c").alias("c_y"), F.col("n").alias("n_y"), F.col("kind").alias("kind_y"), F.col("own").alias("own_y"))
    sizes_fit = (F.col("c") != F.col("c_y")) & near_size("n", "n_y")
    by_near = merged(keyed.filter(f"kind = 'new' and band < {BANDS}")).join(mates.filter("kind_y = 'near'"), ["r", "band", "e"]).filter(sizes_fit)
    # Texts of a family's largest far component meet those of other components only.
    most = named.filter("kind <> 'near'").groupBy("r", "c").agg(F.count("*").alias("m")).groupBy("r").agg(F.max(F.struct("m", "c"))["c"].alias("c_most"))
    # A left join without null-rejecting terms, as only that keeps the many rows of ``keyed`` from being the side that is broadcast; every family has a row in ``most``.
    away = merged(keyed.filter(f"band >= {BANDS}").join(most, "r", "left").withColumn("minor", ~F.col("c").eqNullSafe(F.col("c_most"))).drop("c_most"))
    others = away.select("r", "band", "e", F.col("x").alias("y"), F.col("c").alias("c_y"), F.col("n").alias("n_y"), F.col("kind").alias("kind_y"), F.col("own").alias("own_y"), F.col("minor").alias("minor_y"))
    once = sizes_fit & ((F.col("kind") == "new") | (F.col("kind_y") == "new")) & (~F.col("own_y") | ~F.col("minor_y") | (F.col("x") < F.col("y")))
    by_far = away.filter("own and minor").join(others, ["r", "band", "e"]).filter(once).union(away.filter("own and not minor").join(others.filter("minor_y and not own_y"), ["r", "band", "e"]).filter(once))
    pairs = by_near.select("r", "x", "y").union(by_far.select("r", "x", "y"))
    diffs = merged(named.select("r", "x", "n", "d"))
    held = pairs.select("r", "x", "y").distinct().join(diffs, ["r", "x"]).join(diffs.select("r", F.col("x").alias("y"), F.col("n").alias("n_y"), F.col("d").alias("d_y")), ["r", "y"])
    between = F.size("d") + F.size("d_y") - 2 * F.size(F.array_intersect("d", "d_y"))
    second = settle(first.union(held.filter(linked((F.col("n") + F.col("n_y") - between) / 2, F.col("n"), F.col("n_y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))))
    discard(spark, named, keyed)

    #: Texts far from the pivot of a list, with each other and with those of the pivot's family that are not linked to it.
    away = merged(listed.filter("x > p")).join(kin.select("x", "p", "near"), ["x", "p"], "left").filter("near is null or not near")
    away = away.join(merged(away.filter("near is null").select("token").distinct()), "token", "left_semi")
    away = away.join(of("x", "c"), "x", "left").withColumn("c", F.coalesce("c", "x")).join(merged(reps.select("x", "n")), "x")
    away = settle(away.select("token", "x", "c", "n", F.col("near").isNull().alias("far")))
    discard(spark, listed, kin)
    mate = away.select("token", F.col("x").alias("y"), F.col("c").alias("c_y"), F.col("n").alias("n_y"), F.col("far").alias("far_y"))
    direct = merged(away.filter("far")).join(mate, "token").filter((F.col("c") != F.col("c_y")) & near_size("n", "n_y") & (~F.col("far_y") | (F.col("x") < F.col("y")))).select("x", "y").distinct()
    direct = direct.join(sig, "x").join(sig.select(F.col("x").alias("y"), F.col("n").alias("n_y"), F.col("sig").alias("sig_y")), "y")
    direct = settle(direct.filter(collisions("sig", "sig_y") >= matches).select("x", "y", "n", "n_y"))
    discard(spark, away)
    more = full_sets(docs, direct.select("x").union(direct.select("y")), reps, size)
    seen = direct.join(merged(more), "x").join(merged(more).select(F.col("x").alias("y"), F.col("s").alias("s_y")), "y")
    third = settle(seen.filter(linked(F.size(F.array_intersect("s", "s_y")), F.col("n"), F.col("n_y"))).select(F.col("x").alias("a"), F.col("y").alias("b")))
    discard(spark, direct, more)
    return [comp, second, third]


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id, text)``: classes of texts linked by sets of ``size``-word
    shingles with a Jaccard similarity of ``similar`` percent or more; ``kept`` marks the smallest doc_id of a class.

    Texts that are null or hold no word have an empty set and are linked with nothing; texts count whole, of any length. Rows with a null
    doc_id are in no class (component_id null) and kept. Rows that repeat a doc_id are all returned, in one class; where their texts differ, copies
    and near copies of each are linked to it. An empty table gives an empty result. Other columns are not read.
    """
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = settle(features(texts, size, coordinates))
    named = found.filter("doc_id is not null and n > 0")
    sets = named.groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # A representative goes by its doc_id; of several sets under one doc_id all but the first go by a hash of the set.
    several = named.groupBy("doc_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key")).filter("first_key <> last_key").select(F.col("doc_id").alias("doc"), "first_key")
    node = F.when(F.col("first_key").isNull() | (F.col("key") == F.col("first_key")), F.col("doc")).otherwise(F.xxhash64("key"))
    reps = settle(sets.join(several, "doc", "left").select("key", node.alias("x"), "doc", "n", "sig"))
    copies = settle(merged(named.select("doc_id", "key")).join(reps.select("key", "doc"), "key").filter("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")))
    classes = settle(found.select("doc_id", "n"))
    discard(spark, found)
    near = near_links(texts, reps, size, similar, coordinates, matches, family)
    links = near[0].select(F.col("node").alias("a"), F.col("component").alias("b")).union(near[1]).union(near[2])
    docs_of = reps.filter("x <> doc").select("x", "doc")
    for end in ("a", "b"):
        links = links.join(docs_of.withColumnRenamed("x", end), end, "left").withColumn(end, F.coalesce("doc", end)).drop("doc").select("a", "b")
    final = components(copies.union(links))
    out = merged(classes).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    out = settle(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(spark, reps, copies, classes, final, *near)
    return out


@query("op8_signature_join")
def op8_signature_join(spark, folder) -> DataFrame:
    """Classes of near copies by two-word shingles."""
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), size=2)
