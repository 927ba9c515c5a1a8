"""HTML to a flat array of nodes, the one step Catalyst cannot do; everything after it is column work on that array."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyspark.functions.text import EDGE_BLANKS
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

NODE = StructType([
    StructField("i", IntegerType()), StructField("end", IntegerType()), StructField("up", IntegerType()), StructField("tag", StringType()),
    StructField("cls", StringType()), StructField("attrs", MapType(StringType(), StringType())), StructField("text", StringType())])
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Flat(HTMLParser):
    """Opening tags, texts and closing tags in document order; an opening tag knows where its subtree ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def put(self, tag, attrs=None, text=None):
        self.rows.append([len(self.rows), len(self.rows), self.open[-1] if self.open else -1, tag, (attrs or {}).get("class"), attrs, text])
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        at = self.put(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(at)

    def handle_endtag(self, tag):
        if any(self.rows[at][3] == tag for at in self.open):
            while self.close() != tag:
                pass

    def close(self):
        at = self.open.pop()
        self.put("/" + self.rows[at][3])
        self.rows[at][1] = len(self.rows) - 1
        return self.rows[at][3]

    def handle_data(self, data):
        parent = self.rows[self.open[-1]][3] if self.open else ""
        self.put("#raw" if parent in ("script", "style", "template") else "#text", None, data)


def _flatten(page: str) -> list[tuple]:
    p = _Flat()
    p.feed(page)
    HTMLParser.close(p)
    while p.open:
        p.close()
    return [tuple(r) for r in p.rows]


@pandas_udf(ArrayType(NODE))
def html_nodes(pages: pd.Series) -> pd.Series:
    names = [f.name for f in NODE]
    return pages.map(lambda v: [dict(zip(names, r, strict=True)) for r in _flatten(v)] if isinstance(v, str) else None)


def terminated(page: Column) -> Column:
    """A page in which references without their semicolon (``&amp<``, often from cut texts) are text; browsers and ``html_nodes`` guess what they mean."""
    return F.regexp_replace(page, r"&(?!(?:#\d++|#[xX][0-9A-Fa-f]++|[A-Za-z][A-Za-z0-9]*+);)", "&amp;")


def has_class(n: Column, name: str) -> Column:
    return F.coalesce(F.contains(F.concat(F.lit(" "), n["cls"], F.lit(" ")), F.lit(f" {name} ")), F.lit(False))


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def within(nodes: Column, top: Column, keep) -> Column:
    """Nodes of a subtree for which ``keep`` holds."""
    return F.filter(F.slice(nodes, top["i"] + 2, top["end"] - top["i"]), keep)


def text_of(nodes: Column, top: Column, sep: str = "") -> Column:
    """Text of a subtree: pieces as they are, or trimmed and joined by a separator."""
    pieces = F.transform(within(nodes, top, lambda n: n["tag"] == "#text"), lambda n: n["text"])
    if not sep:
        return F.array_join(pieces, "")
    return F.array_join(F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, EDGE_BLANKS, "")), lambda p: p != ""), sep)


def first(nodes: Column, keep) -> Column:
    return F.get(F.filter(nodes, keep), F.lit(0))


def inside(nodes: Column, n: Column, tag: str) -> Column:
    """Does a node have an ancestor of this tag?"""
    return F.exists(nodes, lambda a: (a["tag"] == tag) & (a["i"] < n["i"]) & (n["i"] <= a["end"]))
