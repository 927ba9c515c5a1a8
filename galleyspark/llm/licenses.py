"""License scan by ordered signature rules, with DataFrame functions only.

A text becomes its words with single blanks between and around them. Rules are regular expressions over that form, one for each license
family and wording; a rule is tried only where its wording's cue and one of its name's keywords occur, and only texts with one of the gate words are looked at. A detection
that lies within one of the same or a higher priority is suppressed, so "gnu lesser general public license" is not also the general one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import fresh, query, table

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, wording of the name, keywords of which each form of name and short identifier holds one after a blank (no blank after it where a version may follow at once), short identifier.
FAMILIES = [
    ("mit", "(?:mit|expat)(?: x11)?", (" mit ", " expat ",), "mit"),
    ("mit-0", "mit (?:no attribution|0)", (" mit ",), "mit 0"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", (" apache",), "apache 2 0"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version| v)? ?1 1", (" apache",), "apache 1 1"),
    ("gpl", "gnu (?:general public license|gpl)", (" gnu ", " gpl",), "gpl"),
    ("gpl-2", "(?:gnu general public license|gnu gpl|gpl)(?: version| v)? ?2(?: 0)?", (" general public license", " gpl",), "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu general public license|gnu gpl|gpl)(?: version| v)? ?3(?: 0)?", (" general public license", " gpl",), "gpl 3 0(?: only| or later)?"),
    ("lgpl", "(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl)", (" lesser general ", " library general ", " lgpl",), "lgpl"),
    ("lgpl-2.1", "(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl)(?: version| v)? ?2 1", (" lesser general ", " library general ", " lgpl",), "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "(?:gnu (?:lesser|library) general public license|(?:gnu )?lgpl)(?: version| v)? ?3(?: 0)?", (" lesser general ", " library general ", " lgpl",), "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu affero general public license|(?:gnu )?agpl)(?:(?: version| v)? ?3(?: 0)?)?", (" affero ", " agpl",), "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gnu free documentation license", (" gnu ", " gfdl ",), "gfdl 1 3"),
    ("bsd-2", "(?:2 clause|two clause|simplified|freebsd) bsd", (" bsd ",), "bsd 2 clause"),
    ("bsd-3", "(?:3 clause|three clause|new|revised|modified) bsd", (" bsd ",), "bsd 3 clause"),
    ("bsd-4", "(?:4 clause|four clause|original) bsd", (" bsd ",), "bsd 4 clause"),
    ("bsd", "bsd(?: style)?", (" bsd ", " 0bsd ",), "0bsd"),
    ("isc", "isc", (" isc ",), "isc"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version| v)? ?1 1", (" mozilla ", " mpl",), "mpl 1 1"),
    ("mpl-2", "(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", (" mozilla ", " mpl",), "mpl 2 0"),
    ("epl-1", "(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", (" eclipse ", " epl",), "epl 1 0"),
    ("epl-2", "(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", (" eclipse ", " epl",), "epl 2 0"),
    ("cddl", "(?:common development and distribution license|cddl)(?: version)?(?: 1 [01])?", (" common development ", " cddl ",), "cddl 1 [01]"),
    ("eupl", "(?:european union public licen[cs]e|eupl)(?: version| v)?(?: ?1 [12])?", (" european union ", " eupl",), "eupl 1 2"),
    ("artistic-2", "(?:perl )?artistic license(?: 2(?: 0)?)?", (" artistic ",), "artistic 2 0"),
    ("zlib", "zlib(?: libpng)?", (" zlib ",), "zlib"),
    ("boost", "boost software license(?: version)?(?: 1 0)?", (" boost ", " bsl ",), "bsl 1 0"),
    ("unlicense", "unlicense", (" unlicense ",), "unlicense"),
    ("wtfpl", "(?:do what the fuck you want to public license|wtfpl)", (" do what ", " wtfpl ",), "wtfpl"),
    ("python", "python software foundation(?: license)?", (" python ", " psf ",), "psf 2 0"),
    ("postgresql", "postgresql", (" postgresql ",), "postgresql"),
    ("openssl", "openssl", (" openssl ",), "openssl"),
    ("ofl", "(?:sil open font license|ofl)(?: version)?(?: 1 1)?", (" open font ", " ofl ",), "ofl 1 1"),
    ("cc0", "(?:cc0(?: 1 0)?|creative commons zero)(?: universal)?", (" cc0 ", " creative commons zero ",), "cc0 1 0"),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1-4] 0)?", (" cc by ", " creative commons ",), "cc by [1-4] 0"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?", (" cc by sa ", " creative commons ",), "cc by sa [1-4] 0"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)(?: [1-4] 0)?", (" cc by nd ", " creative commons ",), "cc by nd [1-4] 0"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?", (" cc by nc ", " creative commons ",), "cc by nc [1-4] 0"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?", (" cc by nc sa ", " creative commons ",), "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] 0)?", (" cc by nc nd ", " creative commons ",), "cc by nc nd [1-4] 0"),
]

#: Priority, trust, a part that each form of the wording holds, wording around a name. The first column orders suppression; a longer detection of one priority wins.
WORDINGS = [
    (3, 0.98, "spdx license identifier", "spdx license identifier {id}"),
    (3, 0.95, "licensed ", "(?:is |are )?(?:dual )?licensed (?:to you )?under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?(?: version [0-9](?: [0-9])?)?"),
    (3, 0.95, " under ", "(?:released|distributed|published|redistributed|provided|offered) under (?:the )?(?:terms of (?:the )?|conditions of (?:the )?)?{name}(?: licen[cs]e)?"),
    (3, 0.9, " available under ", "(?:made )?available under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?"),
    (3, 0.9, " by ", "(?:governed|covered) by (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?"),
    (3, 0.9, " subject to ", "subject to (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?"),
    (2, 0.8, " under ", "under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)"),
    (2, 0.8, "licen", "licen[cs]e (?:is )?{name}"),
    (1, 0.6, "licen", "{name} licen[cs]e(?:d)?"),
]
#: For names that speak of a license themselves, in one of their forms at least: the keywords are the only cue.
BARE = (2, 0.7, "", "{name}(?: version [0-9](?: [0-9])?)?")
#: Every form of every rule holds one of these (a test draws forms of all rules); texts without any are not looked at.
GATE = ["licen", " under ", " governed by ", " covered by ", " subject to ", *(phrase for phrase, _ in BASE), *sorted({k for _, name, keywords, _ in FAMILIES if "licen" in name for k in keywords if "licen" not in k})]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = (1, 2, 3)


class Rule(NamedTuple):
    rule: str
    label: str
    priority: int
    trust: float
    cue: str
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All families in all wordings; the base phrases last, whose places ``scan_licenses`` gives unsuppressed in ``base``."""
    made = [Rule(f"{label}/{k}", label, priority, trust, cue, keywords, f"(?<= )(?:{wording.replace('{id}', short).replace('{name}', name)})(?= )")
            for label, name, keywords, short in FAMILIES for k, (priority, trust, cue, wording) in enumerate(WORDINGS + [BARE] * ("licen" in name))]
    return made + [Rule(f"base/{label}", label, 3, 0.95, phrase, (phrase,), f"(?<= ){phrase}(?= )") for phrase, label in BASE]


def blanked(text: str) -> Column:
    """Words of the text with A-Z as a-z, one blank between, before and after them; two blanks where there is none. lower() also changes other
    letters, of which two would become a-z: they are put out of its way."""
    safe = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "Kİ", "ⓚⓘ")
    safe = F.when(F.col(text).contains("K") | F.col(text).contains("İ"), safe).otherwise(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(safe), SEPARATORS, " ")), F.lit(" "))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(words: Column, found: list[Rule]) -> Column:
    """All matches of all rules whose cue and one of whose keywords occur: array of (first, last, priority, rule, label, trust), words counted from 0."""
    table_ = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).alias(n) for n, v in r._asdict().items()]) for r in found])

    def places(r: Column) -> Column:
        hits, gaps = F.regexp_extract_all(words, r["pattern"], F.lit(0)), F.split(words, r["pattern"], -1)
        start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

        def step(state: Column, pair: Column) -> Column:
            first = state["at"] + pair["gap"]
            return F.struct((first + pair["hit"]).alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("first"), (first + pair["hit"]).alias("last")))).alias("out"))

        pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(blanks(h).alias("hit"), blanks(g).alias("gap")))
        spans = F.aggregate(pairs, start, step)["out"]
        return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("back"), (-r["priority"]).alias("low"), r["rule"].alias("rule"), r["label"].alias("label"), r["trust"].alias("trust")))

    return F.array_sort(F.flatten(F.transform(F.filter(table_, lambda r: words.contains(r["cue"]) & F.exists(r["keywords"], lambda k: words.contains(k))), places)))


def outermost(sorted_spans: Column) -> Column:
    """Drop spans that lie within an earlier one of the same or a higher priority. Order: first word, longest first, highest priority first."""
    shape = "array<struct<first:int,back:int,low:int,rule:string,label:string,trust:double>>"
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in LEVELS], F.array().cast(shape).alias("out"))

    def step(state: Column, x: Column) -> Column:
        last, priority = -x["back"], -x["low"]
        held = F.element_at(F.array(*[state[f"e{p}"] for p in LEVELS]), priority)
        ends = [F.when(priority >= p, F.greatest(state[f"e{p}"], last)).otherwise(state[f"e{p}"]).alias(f"e{p}") for p in LEVELS]
        return F.struct(*ends, F.when(held >= last, state["out"]).otherwise(F.concat(state["out"], F.array(x))).alias("out"))

    return F.aggregate(sorted_spans, start, step)["out"]


def scan_licenses(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``licenses``: the detections left, array of (first, back, low, rule, label, trust), where ``back`` and ``low`` are
    last word and priority with a minus sign, and ``base``: all detections of base rules, those within a longer one too. ``words`` holds the
    blanked text. Names get ``_`` where taken.

    Null and empty texts have no words and no detection. Rows are looked at alone: repeated rows give equal results, all columns stay.
    """
    words, n, out, base = (fresh(docs.columns, c) for c in ("words", "n_words", "licenses", "base"))
    w = F.col(words)
    gate = F.lit(False)
    for g in GATE:
        gate = gate | w.contains(g)
    shape = "array<struct<first:int,back:int,low:int,rule:string,label:string,trust:double>>"
    both = F.transform(F.array(detections(w, found or rules())), lambda d: F.struct(outermost(d).cast(shape).alias("left"), F.filter(d, lambda x: x["rule"].startswith("base/")).cast(shape).alias("base")))[0]
    named = docs.withColumn(words, blanked("text")).withColumn(out, F.when(gate, both))
    none = F.array().cast(shape)
    return named.withColumns({n: F.when(w == "  ", F.lit(0)).otherwise(blanks(w) - 1).cast("long"), base: F.coalesce(F.col(out)["base"], none), out: F.coalesce(F.col(out)["left"], none)}).select(*docs.columns, words, n, out, base)


def base_places(words: Column) -> list[tuple[str, Column, Column, Column]]:
    """For each base phrase: label, number of places, first and last place (null without any). A plain count for tests to hold ``base`` against."""
    out = []
    for phrase, label in BASE:
        there = words.contains(f" {phrase} ")
        pattern = f"(?<= ){phrase}(?= )"
        parts = F.split(words, pattern, -1)
        count = F.when(there, F.size(parts) - 1).otherwise(0).cast("long")
        first = F.when(there, blanks(parts[0]) - 1).cast("long")
        last = F.when(there, blanks(words) - blanks(F.element_at(parts, -1)) - phrase.count(" ") - 1).cast("long")
        out.append((label, count, first, last))
    return out


@query("op4_license_rules")
def op4_license_rules(spark, folder) -> DataFrame:
    """Base places and all labels of every document; a base place within a longer detection counts as a detection of its own."""
    found = scan_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    ours = F.col("base.label")
    trust = F.transform(F.array_distinct("licenses.label"), lambda x: F.array_max(F.transform(F.filter("licenses", lambda d: d["label"] == x), lambda d: d["trust"])))
    kept = F.aggregate(trust, F.lit(1.0), lambda p, t: p * (1 - t))
    based = F.size(ours) > 0
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").cast("long").alias("first_word"), F.array_max("base.first").cast("long").alias("last_word"),
        join(ours).alias("base_labels"), join(F.concat(ours, F.col("licenses.label"))).alias("labels"),
        F.round(F.when(based, F.greatest(1 - kept, F.lit(0.95))).otherwise(1 - kept), 6).alias("score"), F.size(F.array_union("licenses", "base")).cast("long").alias("n_detections"))
