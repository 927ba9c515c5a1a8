"""Cutting a text into bounded pieces, and joining overlapping pieces, as column expressions.

A cutter is one pattern whose matches follow each other through the text: first a tail that fits whole, then the longest
run that ends at a wanted place, then a run of full length. The matches are the pieces, so no character is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galleyspark.functions.arrow import caption_joiner
from galleyspark.functions.text import BLANKS, EDGE_BLANKS, col


def _pieces(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(f"(?s){pattern}"), F.lit(0))


CITATION_ENDS = [r"\n\n", r"\n", "。", "！", "？", r"\. ", "! ", r"\? ", "; "]  # fixed values, in order of preference


def citation_chunks(text: Column | str, low: int = 1200, high: int = 2200) -> Column:
    """Pieces of ``low`` to ``high`` characters that end at the most preferred separator, the last of its kind in reach."""
    ends = "|".join(f".{{{low},{high - len(e.replace(chr(92), ''))}}}{e}" for e in CITATION_ENDS)
    return _pieces(text, rf".{{1,{high}}}\z|{ends}|.{{{high}}}")


def evidence_chunks(text: Column | str, low: int = 200, high: int = 450) -> Column:
    """Pieces of at most ``high`` characters, ended by the last blank beyond ``low`` where there is one."""
    return _pieces(text, rf".{{1,{high}}}\z|.{{{low},{high - 1}}} |.{{{high}}}")


def sentence_chunks(text: Column | str, high: int = 1200) -> Column:
    """Pieces of at most ``high`` characters, ended by the last sentence mark of their upper half; blank pieces are left out."""
    half = high // 2
    stop = rf".{{{high - 1}}}[\n。]|.{{{half},{high - 2}}}(?:[\n。]|[.?!](?= ))"
    return F.filter(_pieces(text, rf".{{1,{high}}}\z|{stop}|.{{{high}}}"), lambda p: F.regexp_replace(p, EDGE_BLANKS, "") != "")


def merged_captions(chunks: Column | str, reach: int = 30) -> Column:
    """One text of caption chunks. The state is the last ``reach`` words; a chunk adds what follows its longest overlap with them."""
    return caption_joiner(reach)(F.transform(col(chunks), lambda c: F.regexp_replace(c, BLANKS, " ")))
