"""Entity resolution: which feed item, video, asset, source and page are the same thing.

Candidates always come from equality joins on narrow keys (a rare shared word, a title, a day slot), never from all
pairs of a group; the exact rule is then applied to the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.operators.ordered import fold_in_order, independent_runs
from galleyspark.session import cut_lineage

WINDOW = 48 * 3600


def _title_features(items: DataFrame) -> DataFrame:
    return items.select("source", "item_id", "published_at", "duration", keys.ascii_title("title").alias("t"), keys.title_words("title").alias("w"))


def _rare_first(rows: DataFrame, freq: DataFrame) -> DataFrame:
    """Order each row's words from rare to common within its source."""
    words = rows.select("side", "source", "item_id", F.explode("w").alias("word")).join(freq, ["source", "word"])
    ordered = words.groupBy("side", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]).alias("rare"))
    return rows.join(ordered, ["side", "item_id"], "left")


def syndication_pairs(rss: DataFrame, video: DataFrame) -> DataFrame:
    """Feed items and videos that are confidently the same release, with a score.

    Both: source, item_id, title, published_at, duration. A match shares its whole title or at least 80% of the shorter
    title's words. In the latter case one of the shorter title's ceil(0.2 n)+1 rarest words occurs in the other title, so
    only those rare words are used as join keys, together with a slot of time (both dated) or a marker (one undated).
    """
    both = _title_features(rss).withColumn("side", F.lit("r")).unionByName(_title_features(video).withColumn("side", F.lit("v")))
    both = cut_lineage(both)  # narrow, and read by each step below: the texts are read once
    freq = both.select("source", F.explode("w").alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    rows = cut_lineage(_rare_first(both, freq))
    k = F.size("w")
    prefix = F.when(k >= 4, F.slice("rare", 1, (k - F.ceil(k * 0.8) + 1).cast("int")))  # fewer words match by the whole title only
    slot = F.floor(F.unix_seconds("published_at") / WINDOW)
    dated = F.col("published_at").isNotNull()
    r_slots = F.when(dated, F.array(slot, F.lit(-1).cast("long"))).otherwise(F.array(F.lit(-2).cast("long")))
    v_slots = F.when(dated, F.array(slot - 1, slot, slot + 1, F.lit(-2).cast("long"))).otherwise(F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long")))
    exact = F.array(F.concat(F.lit("="), "t"))
    short = F.coalesce(F.transform(prefix, lambda w: F.concat(F.lit("<"), w)), F.array().cast("array<string>"))
    full = lambda mark: F.transform("w", lambda w: F.concat(F.lit(mark), w))
    # '<w' pairs a feed item's rare words with all words of a video; '>w' the other way round.
    rk = F.concat(exact, short, full(">"))
    vk = F.concat(exact, full("<"), F.coalesce(F.transform(prefix, lambda w: F.concat(F.lit(">"), w)), F.array().cast("array<string>")))
    cols = ["item_id", "published_at", "duration", "t", "w"]

    def side(mark, ks, slots, p):
        s = rows.filter(F.col("side") == mark).select("source", *[F.col(c).alias(p + c) for c in cols], ks.alias("ks"), slots.alias("slots"))
        return s.withColumn("key", F.explode("ks")).withColumn("slot", F.explode("slots")).drop("ks", "slots")

    c = side("r", rk, r_slots, "r_").join(side("v", vk, v_slots, "v_"), ["source", "key", "slot"])
    overlap = F.size(F.array_intersect("r_w", "v_w"))
    nr, nv = F.size("r_w"), F.size("v_w")
    small = F.least(nr, nv)
    some = (nr > 0) & (nv > 0)
    containment = F.when(some, overlap / small).otherwise(0.0)
    jaccard = F.when(some, overlap / F.size(F.array_union("r_w", "v_w"))).otherwise(0.0)
    c = c.select("*", F.when(some, overlap).otherwise(0).alias("o"), containment.alias("c"), jaccard.alias("j"), small.alias("small"),
                 (F.col("r_t") == F.col("v_t")).alias("exact"),
                 ((nr >= 4) & (F.contains(F.col("v_t"), F.col("r_t")) | F.contains(F.col("r_t"), F.col("v_t")))).alias("within"))
    o, ex, wi = F.col("o"), F.col("exact"), F.col("within")
    title_ok = ex | ((o >= 4) & (F.col("c") >= 0.80) & ((F.col("j") >= 0.50) | wi))
    has_date = F.col("r_published_at").isNotNull() & F.col("v_published_at").isNotNull()
    near = F.abs(F.unix_micros("r_published_at") - F.unix_micros("v_published_at")) <= WINDOW * 1000000
    date_ok = F.when(has_date, near).otherwise(ex | wi)
    has_dur = (F.coalesce("r_duration", F.lit(0.0)) > 0) & (F.coalesce("v_duration", F.lit(0.0)) > 0)
    ratio = F.least("r_duration", "v_duration") / F.greatest("r_duration", "v_duration")
    dur_ok = F.when(has_dur, ratio >= 0.82).otherwise(ex | (has_date & (o >= 4)) | (wi & (o >= 5)))
    evidence = (has_date | has_dur) & ((F.col("small") > 3) | (has_date & has_dur))
    score = (F.col("c") * 0.65 + F.col("j") * 0.35 + F.when(has_date, 0.08).otherwise(0.0) + F.when(has_dur, 0.08).otherwise(0.0) + F.when(ex, 0.10).otherwise(0.0))
    # Candidates grow with the square of a word's titles: the rule decides in the join, cheap parts first, and only matches are shuffled.
    return c.filter(evidence & dur_ok & date_ok & title_ok).select("source", "r_item_id", "v_item_id", score.alias("score")).dropDuplicates(["source", "r_item_id", "v_item_id"])


def attach_unique_best(pairs: DataFrame, margin: float = 0.08) -> DataFrame:
    """In feed order each item takes its best unused video if no other comes within ``margin``. Returns the taken pairs: source, r_item_id, v_item_id.

    pairs: source, r_item_id, r_ord, v_item_id, v_ord, score. Orders are integers that count within a source. A source falls into runs of
    items that compete for videos; no video is an option on both sides of a cut. Each run is folded once, and of the used
    videos a task holds only those that a later item may still ask for.
    """
    pairs = cut_lineage(pairs)  # read twice
    last = pairs.groupBy("source", "v_item_id").agg(F.max("r_ord").alias("last"))
    option = F.struct("score", "v_ord", "v_item_id", "last")
    items = pairs.join(last, ["source", "v_item_id"]).groupBy("source", "r_item_id", "r_ord").agg(F.max("last").alias("reach"), F.collect_list(option).alias("options"))
    runs = independent_runs(cut_lineage(items.withColumn("blk", F.floor(F.col("r_ord") / 4096))), ["source"], ["blk"], "r_ord", "reach")

    def step(used: dict, row):
        if len(used) > 10_000:
            for v in [v for v, end in used.items() if end < row.r_ord]:
                del used[v]
        free = sorted((o["score"], o["v_ord"], o["v_item_id"], o["last"]) for o in row.options if o["v_item_id"] not in used)
        if free and (len(free) == 1 or free[-1][0] - free[-2][0] >= margin):
            used[free[-1][2]] = free[-1][3]
            yield row.source, row.r_item_id, free[-1][2]

    types = dict(pairs.dtypes)
    schema = f"source {types['source']}, r_item_id {types['r_item_id']}, v_item_id {types['v_item_id']}"
    return fold_in_order(runs.drop("blk", "reach"), ["source", "run"], ["r_ord"], dict, step, schema)


def attach_videos(rss: DataFrame, video: DataFrame, taken: DataFrame) -> DataFrame:
    """Feed items with the id and duration of their video; videos nobody took are appended."""
    taken = cut_lineage(taken)  # read twice
    j = rss.join(taken.select(F.col("r_item_id").alias("item_id"), "v_item_id"), "item_id", "left").join(
        video.select(F.col("item_id").alias("v_item_id"), F.col("duration").alias("v_duration")), "v_item_id", "left")
    merged = j.select("source", F.coalesce("v_item_id", "item_id").alias("item_id"), "title", "published_at", F.coalesce("duration", "v_duration").alias("duration"),
                      F.when(F.col("v_item_id").isNotNull(), "merged").otherwise("feed").alias("origin"))
    rest = video.join(taken.select(F.col("v_item_id").alias("item_id")), "item_id", "left_anti")
    return merged.unionByName(rest.select("source", "item_id", "title", "published_at", "duration", F.lit("video").alias("origin")))


def merge_metadata(found: DataFrame, enriched: DataFrame) -> DataFrame:
    """Field by field: what the feed said wins, then the enrichment, then what was found otherwise.

    Both: item_id, title, url, show, duration_seconds, duration_string, published_at, extra (map). found adds from_feed, row_id.
    """
    e = enriched.select("row_id", *[F.col(c).alias("e_" + c) for c in ("item_id", "title", "url", "show", "duration_seconds", "duration_string", "published_at", "extra")])
    j = found.join(e, "row_id", "left")
    feed = F.col("from_feed")
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    text = lambda c: F.when(feed, F.col(c)).otherwise(F.coalesce(blank("e_" + c), F.col(c)))
    opt = lambda c: F.coalesce(F.when(feed, blank(c)), blank("e_" + c), F.col(c))
    kept = F.map_filter("extra", lambda k, v: k.isin("source_name", "source_priority"))
    none = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter("extra", lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce("e_extra", none), k), F.lit(False))),
                        F.map_filter(F.coalesce("e_extra", none), lambda k, v: ~F.map_contains_key(kept, k)))
    extra = F.map_concat(F.map_filter(both, lambda k, v: ~F.map_contains_key(kept, k)), kept)
    return j.select("row_id", *[text(c).alias(c) for c in ("item_id", "title", "url", "show")], *[opt(c).alias(c) for c in ("duration_seconds", "duration_string", "published_at")], extra.alias("extra"))


def _near_in_time(items: DataFrame, assets: DataFrame, on: list[str], seconds: int) -> DataFrame:
    """Pairs equal in ``on`` with times at most ``seconds`` apart: one slot per asset, three per item."""
    slot = lambda c: F.floor(F.unix_seconds(c) / seconds)
    i = items.withColumn("slot", F.explode(F.array(slot("published_at") - 1, slot("published_at"), slot("published_at") + 1)))
    a = assets.withColumn("slot", slot("asset_at"))
    near = F.abs(F.unix_micros("published_at") - F.unix_micros("asset_at")) <= seconds * 1000000
    return i.join(a, [*on, "slot"]).filter(near)


def _hashed(key: Column) -> Column:
    """128 bits for a long text key: keys are compared by equality only."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("key"), key).alias("g"))


def match_assets(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Same media link, or same title and show within a day and a similar duration. Video items match by id only.

    items: item_id, url, audio_url, title, show, published_at, duration. assets: asset_id, link, asset_title, asset_show, asset_at, asset_duration.
    """
    return asset_pairs(items, assets).select("item_id", "asset_id").distinct()


def asset_pairs(items: DataFrame, assets: DataFrame) -> DataFrame:
    """item_id, asset_id, is_enclosure (the asset has the link of the item): the pairs of ``match_assets``, twice where two rules find one."""
    # Links and titles are parsed once for each row; the joins see short keys.
    name = lambda title, show: _hashed(F.concat_ws("\n", keys.word_title(title), keys.word_title(show)))
    audio = F.when(F.coalesce("audio_url", F.lit("")) != "", keys.media_key("audio_url")).otherwise("")
    i = cut_lineage(items.select("item_id", "published_at", "duration", "show", keys.is_video_url("url").alias("is_video"), keys.video_id("url").alias("vid"), F.array_distinct(F.array(keys.media_key("url"), audio)).alias("keys"), name("title", "show").alias("name")).withColumn("own", F.nullif(F.get("keys", F.lit(0)), F.lit(""))))
    a = cut_lineage(assets.select("asset_id", "asset_at", "asset_duration", keys.media_key("link").alias("key"), keys.video_id("link").alias("vid"), name("asset_title", "asset_show").alias("name")))
    pair = ["item_id", "asset_id", F.coalesce(F.col("own") == F.col("key"), F.lit(False)).alias("is_enclosure")]
    by_video = i.filter("is_video").select("item_id", "own", "vid").join(a.select("asset_id", "key", "vid"), "vid").select(*pair)
    by_link = i.filter("not is_video").select("item_id", "own", F.explode("keys").alias("key")).filter("key <> ''").join(a.select("asset_id", "key"), "key").select(*pair)
    # Candidates by name carry no link: a pair that shares the item's own link is also among those by link.
    named = i.filter(~F.col("is_video") & (F.col("show") != "") & (F.col("duration") > 0)).select("item_id", "published_at", "duration", "name")
    cand = _near_in_time(named, a.select("asset_id", "asset_at", "asset_duration", "name"), ["name"], 86400)
    by_name = cand.filter(F.abs(F.col("asset_duration") - F.col("duration")) <= F.greatest(F.lit(30.0), F.col("duration") * 0.05)).select("item_id", "asset_id", F.lit(False).alias("is_enclosure"))
    return by_video.union(by_link).union(by_name)


def match_cross_version(items: DataFrame, assets: DataFrame, min_words: int = 8) -> DataFrame:
    """Another edition of a feed item: same long core title and show, within an hour, duration similar or unknown."""
    live = items.filter(~keys.is_video_url("url") & F.col("from_feed") & (F.col("duration") > 0)).select(
        "item_id", "published_at", "duration", keys.core_title("title").alias("t"), keys.show_key("show").alias("s")).filter(F.size(F.split("t", " ")) >= min_words)
    a = assets.select("asset_id", "asset_at", "asset_duration", keys.core_title("asset_title").alias("t"), keys.show_key("asset_show").alias("s"))
    fits = F.col("asset_duration").isNull() | (F.abs(F.col("asset_duration") - F.col("duration")) <= F.greatest(F.lit(30.0), F.col("duration") * 0.05))
    return _near_in_time(live, a, ["t", "s"], 3600).filter(fits).select("item_id", "asset_id")


def resolve_unique_asset(matches: DataFrame) -> DataFrame:
    """The one transcribed asset of an item. matches: item_id, asset_id, transcribed, is_enclosure.

    If any match is the item's own enclosure only those count; exactly one is needed.
    """
    # One asset is there when the least id is the greatest: pairs combine before the shuffle, and repeated ones count once.
    own = lambda c: F.when(F.col("transcribed") & F.col("is_enclosure"), F.col(c))
    any_ = lambda c: F.when(F.col("transcribed"), F.col(c))
    per = matches.groupBy("item_id").agg(*[f(v("asset_id")).alias(f"{n}_{m}") for v, n in ((own, "own"), (any_, "any")) for f, m in ((F.min, "least"), (F.max, "most"))])
    least, most = F.coalesce("own_least", "any_least"), F.coalesce("own_most", "any_most")
    return per.select("item_id", F.when(least == most, least).alias("asset_id"), F.when(least.isNull(), "none").when(least == most, "resolved").otherwise("ambiguous").alias("state"))


HOSTED_ENCLOSURE = r"^https://api\.substack\.com/feed/podcast/([0-9]+)/[^/?]+$"


def resolve_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Configured source of an item: by ids, else by feeds, else by names. The first level with any hit decides; two hits there mean none.

    items: item_id, ids, feeds (arrays), url, names (array). sources: source, ids, feeds, names (arrays).
    """
    enclosure = keys.url_key("url")
    hosted = F.regexp_extract(enclosure, HOSTED_ENCLOSURE, 1)
    feeds = F.transform("feeds", keys.url_key)
    item_feeds = F.when(hosted != "", F.concat(feeds, F.array(F.concat(F.lit("https://api.substack.com/feed/podcast/"), hosted, F.lit(".rss"))))).otherwise(feeds)

    def leveled(df, ident, feed_keys):
        tagged = lambda col, level: F.transform(col, lambda k: F.struct(F.lit(level).alias("level"), k.alias("key")))
        ks = df.select(ident, F.explode(F.array_distinct(F.concat(tagged(F.transform("ids", lambda k: F.trim(k)), 1), tagged(feed_keys, 2)))).alias("k")).select(ident, "k.level", "k.key")
        # Names need compatibility folding in Arrow, which cannot run inside an array lambda.
        names = df.select(ident, F.explode("names").alias("name")).select(ident, F.lit(3).alias("level"), keys.source_name_key("name").alias("key")).distinct()
        return ks.unionByName(names).filter("key <> ''")

    hits = leveled(items, "item_id", item_feeds).join(leveled(sources, "source", feeds), ["level", "key"]).select("item_id", "level", "source").distinct()
    per = hits.groupBy("item_id", "level").agg(F.count("*").alias("n"), F.min("source").alias("source"))
    best = per.groupBy("item_id").agg(F.min(F.struct("level", "n", "source")).alias("b"))
    return items.select("item_id").join(best, "item_id", "left").select("item_id", F.when(F.col("b.n") == 1, F.col("b.source")).alias("source"), F.col("b.level").alias("level"))


def source_key_collisions(sources: DataFrame) -> DataFrame:
    """Normalised names that more than one source uses. sources: source, name (one row per name or alias)."""
    k = sources.select("source", keys.source_name_key("name").alias("key")).filter("key <> ''").distinct()
    return k.groupBy("key").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source")).filter("sources > 1")


def already_tracked(new: DataFrame, tracked: DataFrame) -> DataFrame:
    """New feeds whose canonical link is configured already. Both: url."""
    t = tracked.select(keys.url_key("url").alias("key")).filter("key <> ''").distinct()
    return new.withColumn("key", keys.url_key("url")).join(t, "key", "left_semi")


def history_aliases(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """Earlier ids of the same release: exact title, show and instant. items: item_id, title, show, published_at (dated, with a feed)."""
    e = episodes.filter(F.col("result") != "discovery_filtered").select(F.col("item_id").alias("alias_id"), "title", "show", "published_at")
    return items.join(e, ["title", "show", "published_at"]).select("item_id", "alias_id")


def identity_keys(items: DataFrame) -> DataFrame:
    """Adds ``ids``, the identities of a release: id, links, title with day, show with title and day.

    items: item_id, urls, feed_url, title, show, published_at, is_discovery. Link keys are only computed where a feed link is known.
    """
    staged = items.select("*", keys.url_key("feed_url").alias("__feed"), F.filter(F.transform("urls", lambda u: F.trim(F.coalesce(u, F.lit("")))), lambda u: u != "").alias("__urls"),
                          F.date_format("published_at", "yyyy-MM-dd").alias("__day"), keys.ascii_title("title").alias("__a"), keys.word_title("title").alias("__w"), keys.show_key("show").alias("__s"))
    feed, day = F.col("__feed"), F.col("__day")
    urls = F.when(feed == "", F.col("__urls")).otherwise(F.filter("__urls", lambda u: keys.url_key(u) != feed))
    one = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<string>"))
    ids = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("id:"), F.col("item_id").cast("string"))), F.transform(urls, lambda u: F.concat(F.lit("url:"), u)),
        one(F.coalesce((F.length("__a") >= 12) & day.isNotNull() & ~F.col("is_discovery"), F.lit(False)), F.concat_ws(":", F.lit("title-day"), "__a", day)),
        one(F.coalesce((F.col("__s") != "") & (F.length("__w") >= 8) & day.isNotNull(), F.lit(False)), F.concat_ws(":", F.lit("show-title-day"), "__s", "__w", day))))
    return staged.withColumn("ids", ids).drop("__feed", "__urls", "__day", "__a", "__w", "__s")


def identity_representative(items: DataFrame) -> DataFrame:
    """Items preferred for every identity they have. items: item_id, ordinal (unique), score (both whole numbers), ids (array of identity keys).

    The preferred member of a key has the highest score, then the lowest ordinal; both are one number, so the best of a key is a plain maximum that
    combines before the shuffle. An item stays if it is the best of as many keys as it has: the exploded keys are shuffled once, and joined to nothing.
    """
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    rank = (whole("score") * F.lit(10**18).cast("decimal(19,0)") - whole("ordinal")).cast("decimal(38,0)")
    ranked = cut_lineage(items.select("item_id", rank.alias("rank"), F.array_distinct(F.transform("ids", _hashed)).alias("ids")))
    best = ranked.select("rank", F.explode("ids").alias("k")).groupBy("k.h", "k.g").agg(F.max("rank").alias("rank"))
    won = best.groupBy("rank").agg(F.count("*").alias("won"))
    return ranked.join(won, "rank").filter(F.col("won") == F.size("ids")).select("item_id")


def drop_reviewed(items: DataFrame, states: DataFrame) -> DataFrame:
    """New and due items; a release is out if any member of any of its identities is in the history and not due.

    items: item_id, ids (identity keys; history keys may be among them). states: key, known, state ('new', 'retry' or null), one row
    per member and key. Members of a key are folded before they meet the items, so no pairs of members are formed.
    """
    told = states.select(_hashed(F.col("key")).alias("k"), (F.col("known") & F.col("state").isNull()).alias("blocked"), F.coalesce(F.col("state") == "retry", F.lit(False)).alias("retry"))
    per_key = told.groupBy(F.col("k.h").alias("h"), F.col("k.g").alias("g")).agg(F.bool_or("blocked").alias("blocked"), F.bool_or("retry").alias("retry")).filter("blocked or retry")
    j = items.select("item_id", F.explode(F.transform("ids", _hashed)).alias("k")).select("item_id", "k.h", "k.g").join(per_key, ["h", "g"], "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.groupBy("item_id").agg(F.bool_or(f("blocked")).alias("blocked"), F.bool_or(f("retry")).alias("retry")).filter(~F.col("blocked")).select(
        "item_id", F.when(F.col("retry"), "retry").otherwise("new").alias("state"))
