"""Landed web pages: articles, links, paywalls, publisher transcripts and page metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.functions import keys
from galleyspark.functions.html import attr, first, has_class, html_nodes, inside, text_of, within
from galleyspark.functions.text import BLANKS, casefold
from galleyspark.operators.ordered import first_n

# Body selectors in order, what is dropped inside a body, what breaks lines, how paywalled pages show.
BODY_CLASSES = ["entry-content", "post-content", "post-body", "w-richtext"]
DROP_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form", "button"]
DROP_CLASSES = ["paywall-footer", "subscription-widget", "subscribe-widget", "post-footer"]
BLOCK_TAGS = ["p", "div", "section", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "br"]
PAYWALL_CLASSES = ["paywall", "paywall-content", "paywall-overlay", "locked-content"]
PAYWALL_MARKERS = ["stratechery plus", "subscribe to read", "this is a paid", "subscribe to continue", "paid subscribers", "unlock this article",
                   "subscribe to stratechery plus for full access"]
LD_DATES = "array<struct<datePublished string, duration string, name string, headline string, `@type` string, `@graph` array<struct<datePublished string, duration string, name string, headline string, `@type` string>>>>"


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def _any_class(n: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | has_class(n, name)
    return out


def ld_records(nodes: Column) -> Column:
    """Records of all ld+json scripts, those of a graph included."""
    raw = F.transform(F.filter(nodes, lambda n: (n["tag"] == "script") & (attr(n, "type") == "application/ld+json")),
                      lambda s: F.trim(F.array_join(F.transform(within(nodes, s, lambda n: n["tag"] == "#raw"), lambda n: n["text"]), "")))
    lists = F.transform(raw, lambda r: F.from_json(F.when(r.startswith("["), r).otherwise(F.concat(F.lit("["), r, F.lit("]"))), LD_DATES))
    pick = lambda r: F.struct(r["datePublished"].alias("datePublished"), r["duration"].alias("duration"), F.coalesce(r["name"], r["headline"]).alias("name"), r["@type"].alias("kind"))
    flat = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    graph = F.flatten(F.filter(F.transform(flat, lambda r: r["@graph"]), lambda x: x.isNotNull()))
    return F.concat(F.transform(flat, pick), F.transform(graph, pick))


def meta(nodes: Column, key: str, value: str) -> Column:
    return attr(first(nodes, lambda n: (n["tag"] == "meta") & (attr(n, key) == value)), "content")


def extract_articles(pages: DataFrame) -> DataFrame:
    """Title, body text and date of each page. pages: page_id, url, html. One Python pass makes nodes; the rest are columns."""
    n = F.col("nodes")
    p = pages.select("page_id", "url", html_nodes("html").alias("nodes"))
    heading = F.coalesce(first(n, lambda x: has_class(x, "post-title")), first(n, lambda x: (x["tag"] == "h1") & inside(n, x, "article")),
                         first(n, lambda x: (x["tag"] == "h1") & inside(n, x, "main")), first(n, lambda x: x["tag"] == "h1"))
    p = p.withColumn("h", heading).withColumn("page_title", first(n, lambda x: x["tag"] == "title")).withColumn("og", meta(n, "property", "og:title")).withColumn(
        "site", F.coalesce(meta(n, "property", "og:site_name"), F.lit("")))
    p = p.withColumn("heading", F.coalesce(_squash(text_of(n, F.col("h"))), F.lit("")))
    raw = F.when(F.col("og") != "", F.col("og")).otherwise(F.coalesce(text_of(n, F.coalesce("h", "page_title")), F.lit("")))
    p = p.withColumn("title", _squash(raw))
    has_h = F.col("h").isNotNull()
    for sep in (" | ", " - ", " — ", " – "):
        quoted = "\\Q" + sep + "\\E"
        parts = F.split("title", quoted)
        head, tail = F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))
        all_but_first = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), sep)
        all_but_last = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), sep)
        site = F.col("site")
        cut = (F.when((site != "") & (head == site), all_but_first).when(has_h & (tail == F.col("heading")), tail).when((site != "") & (tail == site), all_but_last)
               .when(has_h, F.when(F.array_contains(parts, F.col("heading")), F.col("heading")).otherwise(F.col("title")))
               .when((site == "") & F.col("og").isNull(), all_but_last).otherwise(F.col("title")))
        p = p.withColumn("title", F.when((F.col("title") == F.col("heading")) | (F.size(parts) < 2), F.col("title")).otherwise(cut))
    dated = first(n, lambda x: ((x["tag"] == "meta") & ((attr(x, "property") == "article:published_time") | (attr(x, "name") == "date"))) | ((x["tag"] == "time") & attr(x, "datetime").isNotNull()))
    p = p.withColumn("d", dated).withColumn("stamp", F.coalesce(F.when(attr(F.col("d"), "content") != "", attr(F.col("d"), "content")), attr(F.col("d"), "datetime"))).withColumn(
        "ld", F.filter(F.transform(ld_records(n), lambda r: r["datePublished"]), lambda x: keys.published_utc(x).isNotNull()))
    published = F.coalesce(keys.published_utc("stamp"), keys.published_utc(F.try_element_at("ld", F.lit(-1))))
    # The first selector with any node decides; of its nodes the longest is the body.
    size = lambda x: F.length(text_of(n, x))
    longest = lambda keep: F.array_max(F.transform(F.filter(n, keep), lambda x: F.struct(size(x).alias("n"), (-x["i"]).alias("o"), x["end"].alias("end"))))
    articles = F.filter(n, lambda x: x["tag"] == "article")
    one_long = (F.size(articles) == 1) & (F.length(text_of(n, F.get(articles, F.lit(0)))) > 1000)
    rich = F.filter(n, lambda x: has_class(x, "w-richtext"))
    as_range = lambda best: F.when(best.isNotNull(), F.struct((-best["o"]).alias("i"), best["end"].alias("end")))
    body = F.coalesce(
        as_range(longest(lambda x: attr(x, "itemprop") == "articleBody")), *[as_range(longest(_class_test(c))) for c in BODY_CLASSES[:3]],
        F.when(one_long, as_range(longest(lambda x: x["tag"] == "article"))).when(F.size(rich) > 0, as_range(longest(_class_test("w-richtext")))),
        as_range(longest(lambda x: F.contains(x["cls"], F.lit("post_post__")))), as_range(longest(lambda x: x["tag"] == "article")), as_range(longest(lambda x: x["tag"] == "main")))
    p = p.withColumn("published_at", published).withColumn("main", body)
    p = p.withColumn("events", F.when(F.col("main").isNotNull(), F.slice(n, F.col("main.i") + 2, F.col("main.end") - F.col("main.i"))))
    p = p.withColumn("drops", F.transform(F.filter("events", lambda x: x["tag"].isin(DROP_TAGS) | _any_class(x, DROP_CLASSES)), lambda x: F.struct(x["i"].alias("a"), x["end"].alias("b"))))
    lives = lambda x: ~F.exists("drops", lambda d: x["i"].between(d["a"], d["b"]))
    breaks = BLOCK_TAGS + ["/" + t for t in BLOCK_TAGS]
    flow = F.array_join(F.transform(F.filter("events", lambda x: ((x["tag"] == "#text") | x["tag"].isin(breaks)) & lives(x)), lambda x: F.when(x["tag"] == "#text", x["text"]).otherwise("\n")), "")
    lines = F.filter(F.transform(F.split(flow, "\n"), _squash), lambda x: x != "")
    wall = F.exists(n, lambda x: _any_class(x, PAYWALL_CLASSES) | attr(x, "data-paywall").isNotNull())
    return p.select("page_id", "url", _squash(F.col("title")).alias("title"), F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"), "published_at", wall.alias("paywall"))


def _class_test(name: str):
    return lambda x: has_class(x, name)


def extract_links(pages: DataFrame, base: str, include: str, exclude: str = "(?!)") -> DataFrame:
    """Links of index pages: absolute, on the same host, https, included and not excluded; distinct in first-seen order per page.

    pages: page_id, url (base of relative links), html. Pure expressions; the order survives as the first position of each link.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    a = pages.select("page_id", F.col(base).alias("base"), F.posexplode(anchors).alias("pos", "href"))
    p = keys.Link("base")
    a = a.select("page_id", "pos", F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("href"), p.scheme.alias("scheme"), p.authority.alias("site"), p.host.alias("host"),
                 F.coalesce(F.nullif(F.regexp_replace(p.path, r"[^/]*$", ""), F.lit("")), F.lit("/")).alias("folder"))
    root = F.concat("scheme", F.lit("://"), "site")
    href = F.col("href")
    full = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat("scheme", F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(root, "folder", href)))
    a = a.select("page_id", "pos", "host", full.alias("full"))
    q = keys.Link("full")
    a = a.select("page_id", "pos", "host", q.scheme.alias("scheme"), q.authority.alias("site"), q.host.alias("link_host"), q.path.alias("path"))
    a = a.filter((F.col("scheme") == "https") & (F.col("link_host") == F.col("host")) & F.rlike("site", F.lit(r"^[^@:]+(:443)?$")))
    a = a.withColumn("link", F.concat("scheme", F.lit("://"), "site", "path"))
    ok = (F.rlike("path", F.lit(include)) | F.rlike("link", F.lit(include))) & ~F.rlike("path", F.lit(exclude))
    return a.filter(ok).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def drop_paywalled(articles: DataFrame, min_chars: int = 1000) -> DataFrame:
    """For free-only sources: without short texts, paywall elements and paywall lines. articles: text, paywall, free_only."""
    marked = F.exists(F.split("text", "\n"), lambda line: F.exists(F.array(*[F.lit(m) for m in PAYWALL_MARKERS]), lambda m: F.startswith(casefold(line), m)))
    return articles.filter(~(F.col("free_only") & ((F.length("text") < min_chars) | F.col("paywall") | marked)))


def cap_articles_per_source(articles: DataFrame, n: int = 10) -> DataFrame:
    """Newest first (undated last), distinct link, the first ``n`` usable ones per source. articles: source, url, title, text, published_at, pos."""
    usable = articles.filter((F.col("text") != "") & (F.col("title") != ""))
    order = F.struct(F.coalesce(-F.unix_micros("published_at"), F.lit(2**62)).alias("age"), "pos")
    unique = usable.groupBy("source", "url").agg(F.min(order).alias("o"), F.min_by(F.struct("title", "published_at"), order).alias("v"))
    return first_n(unique.select("source", "url", "v.title", "v.published_at", "o"), ["source"], [F.col("o")], n).drop("o")


# Publisher layouts: where the transcript is, which tags are blocks, and how speakers are marked. Fixed values.
BLOCKED_MARKERS = ["access the full transcript", "subscribe to continue reading", "sign in to read the rest"]
LAYOUTS = {
    "article": {"top": lambda x: has_class(x, "transcript__content"), "blocks": ["h2", "h3", "p", "blockquote", "li"], "speaker_class": "transcript__speaker"},
    "heading": {"top": lambda x: (has_class(x, "body") & has_class(x, "markup")) | has_class(x, "available-content"), "blocks": ["h3", "h4", "p", "blockquote", "ul", "ol", "pre"], "after": "transcript"},
    "wrapper": {"top": lambda x: has_class(x, "pc-detail_transcript") & (attr(x, "transcript-wrapper") == "true"), "blocks": ["p", "blockquote", "li"]},
    "anchor": {"top": lambda x: attr(x, "id") == "podcast-transcript", "blocks": ["h2", "h3", "h4", "p", "li"]},
}
SPEAKER = r"\A(?:\[([^\]\n]{1,80})\]|([A-Z][A-Za-z0-9 .,'’\-]{0,79}):)"


def extract_publisher_transcripts(pages: DataFrame) -> DataFrame:
    """Transcript text and its quality features for pages of known layouts. pages: page_id, layout, html.

    Features: blocks, distinct speakers, labelled blocks with their first and last position, chapters, stamps. Gates are filters on them.
    """
    p = pages.select("page_id", "layout", html_nodes("html").alias("nodes"))
    n = F.col("nodes")
    out = None
    for name, rule in LAYOUTS.items():
        q = p.filter(F.col("layout") == name).withColumn("top", first(n, rule["top"]))
        inner = F.slice(n, F.col("top.i") + 2, F.greatest(F.col("top.end") - F.col("top.i"), F.lit(0)))
        q = q.withColumn("inner", inner)
        if "after" in rule:
            label = lambda x: F.lower(text_of(n, x, " "))
            q = q.withColumn("mark", first(F.col("inner"), lambda x: x["tag"].isin("h2", "h3") & (label(x) == "transcript") & (x["up"] == F.col("top.i"))))
            q = q.withColumn("stop", first(F.col("inner"), lambda x: (x["up"] == F.col("top.i")) & (x["i"] > F.col("mark.i")) & ((x["tag"] == "h2") | (~x["tag"].startswith("/") & (x["tag"] != "#text") & label(x).isin("ready for more?", "subscribe", "share")))))
            q = q.withColumn("inner", F.when(F.col("mark").isNotNull(), F.filter("inner", lambda x: (x["i"] > F.col("mark.end")) & (x["i"] < F.coalesce("stop.i", F.lit(2**30))) & (x["up"] == F.col("top.i")))))
        items = F.filter("inner", _tag_test(rule["blocks"]))
        items = F.filter(items, lambda x: ~((x["tag"] == "li") & inside(F.col("inner"), x, "li")))
        q = q.withColumn("blocks", F.filter(F.transform(items, lambda x: F.struct(x["tag"].alias("tag"), text_of(n, x, " ").alias("text"))), lambda b: b["text"] != ""))
        if "speaker_class" in rule:
            names = F.transform(F.filter("inner", _class_test(rule["speaker_class"])), lambda x: casefold(text_of(n, x, " ")))
            q = q.withColumn("names", F.filter(names, lambda v: v != ""))
        else:
            who = lambda b: casefold(F.trim(F.concat(F.regexp_extract(b["text"], SPEAKER, 1), F.regexp_extract(b["text"], SPEAKER, 2))))
            q = q.withColumn("names", F.filter(F.transform("blocks", who), lambda v: (v != "") & v.rlike("[a-z]") & ~v.rlike("[.!?]") & (F.size(F.split(v, " ")) <= 10)))
        noted = _seconds(F.transform(F.filter(n, lambda x: (x["tag"] == "#text") & F.exists(F.filter(n, _class_test("show-notes-container")), lambda c: x["i"].between(c["i"], c["end"]))), lambda x: x["text"]))
        own = _seconds(F.transform(F.filter("blocks", lambda b: b["tag"].isin("h3", "h4")), lambda b: b["text"]))
        q = q.select("page_id", "layout", "blocks", "names", (F.array_sort(noted) if name == "article" else own).alias("times"))
        out = q if out is None else out.unionByName(q)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    labelled = F.filter(F.transform("blocks", lambda b, i: F.when(b["text"].rlike(SPEAKER), i)), lambda i: i.isNotNull())
    blocked = F.exists(F.array(*[F.lit(m) for m in BLOCKED_MARKERS]), lambda m: F.contains(casefold(text), m))
    stamps = F.filter("blocks", lambda b: b["tag"].isin("h3", "h4") & b["text"].rlike(r"\d{1,2}:\d{2}"))
    return out.select("page_id", "layout", text.alias("text"), F.size("blocks").alias("n_blocks"), F.size(F.array_distinct("names")).alias("speakers"), F.size(labelled).alias("labelled"),
                      F.array_min(labelled).alias("first_label"), F.array_max(labelled).alias("last_label"), F.size(F.filter("blocks", lambda b: b["tag"] == "h2")).alias("chapters"),
                      F.size(stamps).alias("stamps"), blocked.alias("blocked"), "names", F.get("times", F.lit(0)).alias("first_time"), F.when(F.size("times") > 1, F.element_at("times", -1)).alias("last_time"))


STAMP = r"(?<!\d)(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?!\d)"


def _seconds(texts: Column) -> Column:
    """Seconds of the first stamp in each text that has one."""
    part = lambda t, k: F.coalesce(F.nullif(F.regexp_extract(t, STAMP, k), F.lit("")), F.lit("0")).cast("int")
    return F.transform(F.filter(texts, lambda t: t.rlike(STAMP)), lambda t: part(t, 1) * 3600 + part(t, 2) * 60 + part(t, 3))


# Fixed values per layout: words and words a minute, characters at least and per minute, speakers, how far stamps may stay from
# the ends (seconds, share of the duration), and, for the layout with a host, blocks, host, and words and characters where no duration is known.
GATES = {
    "article": {"words": 1000, "pace": (70, 230), "ends": ((360, 0.12), (1200, 0.25))},
    "heading": {"chars": (5000, 180), "ends": ((180, 0.10), (900, 0.20))},
    "wrapper": {"speakers": 2, "blocks": 20, "host": "david senra", "words": 1000, "pace": (70, 260), "untimed": (3000, 15000)},
    "anchor": {"speakers": 2, "pace": (70, 220)},
}
TRANSCRIPT_WORD = r"[A-Za-z0-9]++(?:[’'-][A-Za-z0-9]++)*+"


def accept_publisher_transcripts(transcripts: DataFrame, items: DataFrame) -> DataFrame:
    """page_id, layout, text, problem: the first gate of its layout that a transcript fails, null for one that is complete.

    transcripts: the rows of ``extract_publisher_transcripts``. items: page_id, duration (seconds; null or not positive where unknown).
    """
    j = transcripts.join(items.select("page_id", F.when(F.col("duration") > 0, F.col("duration")).alias("duration")), "page_id", "left").withColumn("words", F.regexp_count("text", F.lit(TRANSCRIPT_WORD)))
    d, blocks, problem = F.col("duration"), F.col("n_blocks"), F.lit(None).cast("string")
    for layout, g in GATES.items():
        rules = [("no_transcript", blocks == 0), ("blocked", F.col("blocked"))]
        if "blocks" in g:
            spread = (F.col("labelled") >= F.greatest(F.lit(8), F.floor(blocks / 20))) & (F.col("first_label") <= F.greatest(F.lit(2.0), F.bround(blocks * 0.05))) & (F.col("last_label") >= F.bround(blocks * 0.80))
            rules += [("few_blocks", blocks < g["blocks"]), ("labels_not_spread", ~F.coalesce(spread, F.lit(False))), ("no_host", ~F.array_contains("names", g["host"]))]
        if "speakers" in g:
            rules.append(("few_speakers", F.col("speakers") < g["speakers"]))
        if "chars" in g:
            least, each = g["chars"]
            rules.append(("too_short", F.length("text") < F.greatest(F.lit(least), F.coalesce(F.bround(d / 60) * each, F.lit(0)))))
        if "pace" in g:
            low, high = g["pace"]
            words, chars = g.get("untimed", (None, None))
            rules.append(("no_duration", d.isNull()) if words is None else ("too_short", d.isNull() & ((F.col("words") < words) | (F.length("text") < chars))))
            rules += [("too_short", d.isNotNull() & (F.col("words") < g.get("words", 0))), ("pace", d.isNotNull() & ~(F.col("words") / (d / 60.0)).between(low, high))]
        if "ends" in g:
            (early, early_share), (late, late_share) = g["ends"]
            off = (F.col("first_time") > F.least(F.lit(early), d * early_share)) | (d - F.col("last_time") > F.greatest(F.lit(late), d * late_share))
            rules.append(("stamps_off", F.coalesce(F.col("last_time").isNotNull() & d.isNotNull() & off, F.lit(False))))
        first_rule = F.coalesce(*[F.when(broken, name) for name, broken in rules])
        problem = F.when(F.col("layout") == layout, first_rule).otherwise(problem)
    return j.select("page_id", "layout", "text", problem.alias("problem"))


def _tag_test(tags):
    return lambda x: x["tag"].isin(tags)


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, time and duration from meta tags, else from ld+json. pages: page_id, html."""
    p = pages.select("page_id", html_nodes("html").alias("nodes"))
    n = F.col("nodes")
    p = p.withColumn("ld", ld_records(n)).withColumn("og", meta(n, "property", "og:title")).withColumn("time", meta(n, "property", "article:published_time"))
    p = p.withColumn("secs", F.coalesce(meta(n, "property", "og:audio:duration").try_cast("double"), meta(n, "property", "og:video:duration").try_cast("double")))
    p = p.withColumn("h", F.coalesce(first(n, lambda x: x["tag"] == "h1"), first(n, lambda x: x["tag"] == "title")))
    pick = lambda f: F.get(F.filter(F.transform("ld", lambda r: r[f]), lambda v: v.isNotNull()), F.lit(0))
    return p.select("page_id", F.coalesce(F.when(F.trim("og") != "", F.trim("og")), pick("name"), text_of(n, F.col("h"), " ")).alias("title"),
                    F.coalesce(keys.published_utc("time"), keys.published_utc(pick("datePublished"))).alias("published_at"),
                    F.coalesce(F.when(F.col("secs") > 0, F.col("secs")), keys.iso_duration_seconds(pick("duration"))).alias("duration"))
