"""Identity keys and field parsers as column expressions: links, titles, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyspark.functions.arrow import _nfkd_bare, accent_free, nfkc
from galleyspark.functions.text import BLANKS, casefold, col

# Tracking parameters that never identify a feed or an asset.
FEED_TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "si", "_hsenc", "_hsmi"]
ASSET_TRACKING = ["fbclid", "gclid"]
# Hosts that serve videos, and the shape of a video id.
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be"]
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# One search instead of the parts of a Link: https, a host, no credentials, port 443 or none. A line break may end the port.
_PORT = r"(?:0{0,2}443)?(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?"
_PUBLIC = rf"^(?i:https)://(?:\[[^\]/?#@]*\]:{_PORT}|[^:/?#@]+(?::{_PORT})?)(?=[/?#]|\z)"


class Link:
    """Parts of a URL column. Regular expressions accept what a strict URI parser refuses, such as non-ASCII paths."""

    def __init__(self, url: Column | str):
        u = F.trim(col(url))
        self.scheme = F.lower(F.regexp_extract(u, _URL, 1))
        self.authority = F.regexp_extract(u, _URL, 2)
        server = F.regexp_replace(self.authority, r"^.*@", "")
        self.host = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
        self.port_text = F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
        self.port = F.try_to_number(F.when(self.port_text.rlike(r"^\d{1,5}$"), self.port_text), F.lit("99999")).cast("int")
        self.bad_port = (self.port_text != "") & ~self.port_text.rlike(r"^\d{1,5}$")
        self.path = F.regexp_extract(u, _URL, 3)
        self.query = F.regexp_extract(u, _URL, 4)


def _pairs(query: Column, keep_blank: bool) -> Column:
    """Decoded (key, value) structs of a query string in written order."""
    raw = F.filter(F.split(query, "&"), lambda p: (p != "") if keep_blank else p.rlike("=."))
    dec = lambda s: F.coalesce(F.try_url_decode(s), s)
    return F.transform(raw, lambda p, i: F.struct(
        dec(F.substring_index(p, "=", 1)).alias("k"), dec(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v"), i.alias("i")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column | str) -> Column:
    """Canonical feed link without tracking parameters; empty if it is no web link."""
    p = Link(url)
    kept = F.filter(_pairs(p.query, True), lambda s: ~F.lower(s["k"]).startswith("utm_") & ~F.lower(s["k"]).isin(FEED_TRACKING))
    flat = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["k"].alias("k"), s["v"].alias("v")))),
                                    lambda s: F.concat(_encode(s["k"]), F.lit("="), _encode(s["v"]))), "&")
    port = F.when(p.port.isNotNull() & ~p.port.isin(80, 443), F.concat(F.lit(":"), p.port.cast("string"))).otherwise("")
    key = F.concat(F.lit("https://"), p.host, port, F.regexp_replace(p.path, "/+$", ""), F.when(flat != "", F.concat(F.lit("?"), flat)).otherwise(""))
    return F.when(p.scheme.isin("http", "https") & (p.host != "") & ~p.bad_port & (p.port.isNull() | (p.port <= 65535)), key).otherwise("")


def media_key(url: Column | str) -> Column:
    """Key of one media asset: video id, or host and path with the identifying query parameters."""
    p = Link(url)
    host = F.regexp_replace(p.host, r"^www\.", "")
    pairs = _pairs(p.query, False)
    first_v = F.coalesce(F.get(F.filter(pairs, lambda s: s["k"] == "v"), F.lit(0))["v"], F.lit(""))
    kept = F.array_sort(F.transform(F.filter(pairs, lambda s: ~s["k"].startswith("utm_") & ~s["k"].isin(ASSET_TRACKING)),
                                    lambda s: F.struct(s["k"].alias("k"), s["i"].alias("i"), s["v"].alias("v"))))
    flat = F.array_join(F.transform(kept, lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    key = (F.when(host == "youtu.be", F.concat(F.lit("youtube:"), F.regexp_replace(p.path, "^/+|/+$", "")))
           .when((host == "youtube.com") & (p.path == "/watch"), F.concat(F.lit("youtube:"), first_v))
           .otherwise(F.concat(host, F.regexp_replace(p.path, "/+$", ""), F.lit("?"), flat)))
    return F.when(p.scheme.isin("http", "https") & (host != ""), key).otherwise("")


def is_video_url(url: Column | str) -> Column:
    p = Link(url)
    return (p.scheme == "https") & p.host.isin(VIDEO_HOSTS)


def video_id(url: Column | str) -> Column:
    """The 11-character id of a public video link, or null."""
    p = Link(url)
    parts = F.filter(F.split(p.path, "/"), lambda s: s != "")
    pairs = _pairs(p.query, False)
    found = (F.when((p.host == "youtu.be") & (F.size(parts) > 0), F.get(parts, F.lit(0)))
             .when(F.regexp_replace(p.path, "/+$", "") == "/watch", F.get(F.filter(pairs, lambda s: s["k"] == "v"), F.lit(0))["v"])
             .when((F.size(parts) == 2) & F.get(parts, F.lit(0)).isin("embed", "live", "shorts"), F.get(parts, F.lit(1))))
    return F.when(is_video_url(url) & found.rlike(VIDEO_ID), found)


def safe_public_url(url: Column | str) -> Column:
    """The link if it is public https without credentials or odd ports, else null."""
    u = F.trim(F.replace(col(url), F.lit("&amp;"), F.lit("&")))
    return F.when(u.rlike(_PUBLIC), u)


# Title keys -------------------------------------------------------------------------------------

# Words that carry no identity in page titles of one publisher family, and in titles in general.
NOISE_WORDS = ["episode", "ep", "invest", "like", "the", "best", "with", "patrick", "oshaughnessy", "o", "shaughnessy", "colossus", "podcast"]
TITLE_STOPWORDS = ["a", "an", "and", "are", "at", "by", "ceo", "episode", "for", "from", "full", "has", "how", "in", "interview", "of", "on", "podcast",
                   "re", "show", "tech", "technology", "the", "to", "vc", "video", "we", "why", "with"]


def ascii_words(c: Column | str) -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def ascii_title(c: Column | str) -> Column:
    return F.array_join(ascii_words(c), " ")


def title_words(c: Column | str) -> Column:
    """Distinct words of a title that can identify it."""
    return F.array_distinct(F.filter(ascii_words(c), lambda w: (F.length(w) >= 2) & ~w.isin(TITLE_STOPWORDS)))


def word_title(c: Column | str) -> Column:
    """Words of any script."""
    return F.array_join(F.regexp_extract_all(casefold(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def core_title(c: Column | str) -> Column:
    """Title without its edition number and without a trailing guest list."""
    cut = F.regexp_replace(col(c), r"(?i)^\s*(?:ep\.?|episode)\s*\d+\s*[-:–—]?\s*", "")
    return word_title(F.substring_index(cut, "|", 1))


def show_key(c: Column | str) -> Column:
    return F.regexp_replace(word_title(c), "^the ", "")


def source_name_key(c: Column | str) -> Column:
    """Source names compared by letters and digits of any script, after compatibility folding, without a leading 'the'."""
    spaced = F.regexp_replace(casefold(nfkc(c)), r"[^\p{L}\p{N}\s]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(spaced, BLANKS, " ")), "^the ", "")


def noise_free_title(c: Column | str) -> Column:
    plain = F.lower(F.coalesce(_nfkd_bare(F.coalesce(F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B"))), col(c))), F.lit("")))
    return F.array_join(F.filter(F.regexp_extract_all(plain, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(NOISE_WORDS) & ~w.rlike(r"^\d+$")), " ")


def accent_free_title(c: Column | str) -> Column:
    return accent_free(c)


# Durations and dates ----------------------------------------------------------------------------


def duration_seconds(c: Column | str) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` to seconds; null if unreadable or not positive."""
    parts = F.transform(F.split(F.trim(col(c)), ":"), lambda p: F.when(p.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(p)).try_cast("double"))
    total = (F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, parts[0] * 60 + F.get(parts, F.lit(1)))
             .when(F.size(parts) == 3, parts[0] * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))))
    return F.when(total > 0, total)


def iso_duration_seconds(c: Column | str) -> Column:
    """``P..DT..H..M..S`` to seconds."""
    v = F.upper(F.trim(col(c)))
    shape = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    g = lambda i: F.coalesce(F.when(F.regexp_extract(v, shape, i) != "", F.regexp_extract(v, shape, i)).cast("double"), F.lit(0.0))
    total = g(1) * 86400 + g(2) * 3600 + g(3) * 60 + g(4)
    return F.when(v.rlike(shape) & (total > 0), total)


def duration_label(c: Column | str) -> Column:
    """Rounded minutes as shown to readers; unreadable text stays, nothing becomes the 'not given' label."""
    v = F.trim(F.coalesce(col(c), F.lit("")))
    zh = r"^(?:(\d+)\s*小时)?\s*(?:(\d+)\s*分(?:钟)?)?\s*(?:(\d+)\s*秒)?$"
    z = lambda i: F.coalesce(F.when(F.regexp_extract(v, zh, i) != "", F.regexp_extract(v, zh, i)).cast("double"), F.lit(0.0))
    seconds = (F.when(v.rlike(r"^\d+(\.\d+)?$") | v.rlike(r"^\d+:\d{2}(:\d{2})?$"), F.coalesce(duration_seconds(v), F.lit(0.0)))
               .when(v.rlike(zh) & v.rlike(r"\d"), z(1) * 3600 + z(2) * 60 + z(3)))
    label = F.when(seconds > 0, F.concat(F.bround(seconds / 60, 0).cast("long").cast("string"), F.lit(" 分钟"))).otherwise("未提供")
    return F.when(seconds.isNotNull(), label).when(v != "", v).otherwise("未提供")


def published_utc(c: Column | str) -> Column:
    """RFC-822 dates, ISO dates (naive means UTC), epoch seconds and yyyymmdd to a UTC timestamp; null if unreadable."""
    v = F.trim(col(c))
    bare = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3},\s*", ""), r"\s*\b(?:GMT|UTC|UT|Z)$", " +0000")
    rfc = F.when(v.rlike(r"^([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} "), F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))))
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), v.try_cast("timestamp"))
    compact = F.when(v.rlike(r"^\d{8}$"), F.try_to_timestamp(v, F.lit("yyyyMMdd")))
    epoch = F.when(v.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(v.try_cast("double")))
    return F.coalesce(rfc, iso, compact, epoch)
