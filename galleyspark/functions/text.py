"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# White space of any script, written out: the Unicode flag makes every match slower.
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
NOT_BLANK = _SPACE.replace("[", "[^", 1).replace("]+", "]")  # one character that is no white space
BLANKS, EDGE_BLANKS = _SPACE, rf"\A{_SPACE}|{_SPACE}\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), EDGE_BLANKS, "")


def casefold(c: Column | str) -> Column:
    """Lower case plus the folds that plain lower case leaves out for letters in use here."""
    return F.replace(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))  # translate looks up every character


def collapse(c: Column | str) -> Column:
    """White space (Unicode) to single blanks, trimmed."""
    return F.trim(F.regexp_replace(col(c), BLANKS, " "))


def normalised(c: Column | str) -> Column:
    """The form in which quotes and names are compared."""
    return collapse(casefold(c))


def occurrences(body: Column, word: Column) -> Column:
    """Non-overlapping occurrences of ``word``."""
    return ((F.length(body) - F.length(F.replace(body, word, F.lit("")))) / F.length(word)).cast("int")
