"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame functions only.

Values are found by pattern and validated (Luhn sum, octets, calendar). A valid value is permuted within its format by a keyed Feistel
network, so it stays valid, two values never share a pseudonym, and a value has the same pseudonym in every document. Half of a value is
shifted by a keyed hash of the other half, in turn; letters and digits each stay what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import fresh, query, table

ROUNDS = 8
#: Kind, pattern. The order is the order of preference at one place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}",  # a host has 127 labels at most
    "phone": r"(?<![\w+])(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?:\(?\d\)?[ .-]?){7,14}\d|0\d(?:[ .-]\d\d){4})(?![\w-]|\.\d)",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "date": r"(?<![\w/-])(?:19|20)\d{2}(?:-\d{2}-|/\d{2}/)\d{2}(?![\w/-])|(?<![\w./-])(?:\d{1,2}\.\d{1,2}\.|\d{1,2}/\d{1,2}/|\d{1,2}-\d{1,2}-)(?:19|20)\d{2}(?![\w/-]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])",
}
#: Area code, exchange, number, after a country code or none; all other phones are "+" with 8 to 15 digits, or pairs after a leading 0.
TEN = r"^(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"
DAYS = (17, 4297)  # their product is the number of days from 1900-01-01 to 2099-12-31
FIRST_DAY = "1900-01-01"


def pattern() -> str:
    """All kinds in one expression; the two back references of cards keep their numbers."""
    order = ["card", *(k for k in KINDS if k != "card")]
    return "|".join(f"(?:{KINDS[k]})" for k in order)


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def byte_of(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def shifted(half: Column, digest: Column) -> Column:
    """Each letter or digit of ``half`` moved on within its kind by a byte of the hash; at most 32 places have bytes of their own."""
    def move(c: Column, i: Column) -> Column:
        by = byte_of(digest, i % 32) + F.floor(i / 32)
        turn = lambda low, n: F.chr(F.pmod(F.ascii(c) - low + by, F.lit(n)) + low)
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permuted(value: Column, key: str, tweak: str) -> Column:
    """The Feistel network over a text: state (l, r) becomes (r, l moved by the hash of r) in each of an even number of rounds."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), shifted(s["l"], keyed(key, F.lit(tweak), i.cast("string"), s["r"])).alias("r"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(end["l"], end["r"])


def permuted_day(day: Column, key: str) -> Column:
    """The same over a pair of numbers modulo 17 and 4297: exact on all days of two centuries, without a value outside."""
    a, b = DAYS
    number = lambda *parts: F.conv(F.substring(keyed(key, F.lit("date"), *parts), 1, 8), 16, 10).cast("long")
    start = F.struct(F.floor(day / b).cast("long").alias("a"), (day % b).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        first = F.struct(F.pmod(s["a"] + number(i.cast("string"), s["b"].cast("string")), F.lit(a)).alias("a"), s["b"].alias("b"))
        return F.transform(F.array(first), lambda t: F.struct(t["a"].alias("a"), F.pmod(t["b"] + number(i.cast("string"), t["a"].cast("string")), F.lit(b)).alias("b")))[0]

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return (end["a"] * b + end["b"]).cast("int")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def poured(value: Column, fresh_digits: Column) -> Column:
    """``value`` with its digits replaced in order, all else as it stands."""
    place = lambda i: F.length(digits(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(fresh_digits, place(i), F.lit(1))).otherwise(c)), "")


def luhn_rest(body: Column) -> Column:
    """The check digit that completes ``body``."""
    doubled = lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    chars = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda s, d: s + d)
    return F.pmod(-total, F.lit(10)).cast("string")


def day_of(value: Column) -> Column:
    """The day that a date names, year first or last; the other order of day and month is tried where day first is none."""
    v = F.regexp_replace(value, "[./]", "-")
    return F.coalesce(F.when(v.rlike(r"^\d{4}-"), F.try_to_date(v, "yyyy-MM-dd")), F.when(v.rlike(r"-\d{4}$"), F.coalesce(F.try_to_date(v, "d-M-yyyy"), F.try_to_date(v, "M-d-yyyy"))))


def kind_of(value: Column) -> Column:
    """The kind of a match whose value is valid, else null."""
    number = digits(value)
    is_card = ~value.contains(".") & ~value.contains("/") & ~value.contains("(") & ~value.startswith("+") & F.length(number).between(13, 19)
    octets = F.split(value, "[.]")
    return (F.when(value.contains("@"), F.lit("email"))
            .when(is_card, F.when(luhn_rest(F.substring(number, F.lit(1), F.length(number) - 1)) == F.right(number, F.lit(1)), F.lit("card")))
            .when((F.size(octets) == 4) & value.rlike(r"^[0-9.]+$") & value.contains("."), F.when(F.forall(octets, lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0"))), F.lit("address")))
            .when(value.rlike(r"^(?:(?:19|20)\d{2}([-/])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d{2})$"), F.when(day_of(value).isNotNull(), F.lit("date")))
            .otherwise(F.lit("phone")))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value."""
    number = digits(value)
    body = permuted(F.substring(number, F.lit(1), F.length(number) - 1), key, "card")
    card = F.transform(F.array(body), lambda b: poured(value, F.concat(b, luhn_rest(b))))[0]
    # A phone number keeps its country code. The first digits of area and exchange keep their range, 2 to 9 or 0 to 1, and are moved within it.
    ten = F.right(number, F.lit(10))
    heads = F.concat(F.substring(ten, 1, 1), F.substring(ten, 4, 1))
    tails = F.concat(F.substring(ten, 2, 2), F.substring(ten, 5, 6))
    moved = permuted(tails, key, "phone")
    by = keyed(key, F.lit("heads"), tails)
    first = lambda i: F.substring(heads, i + 1, 1).cast("int")
    head = lambda i: F.when(first(i) < 2, F.pmod(first(i) + byte_of(by, F.lit(i)), F.lit(2))).otherwise(F.pmod(first(i) - 2 + byte_of(by, F.lit(i)), F.lit(8)) + 2).cast("string")
    ten_digits = F.transform(F.array(moved), lambda t: poured(value, F.concat(F.substring(number, F.lit(1), F.length(number) - 10), head(0), F.substring(t, 1, 2), head(1), F.substring(t, 3, 6))))[0]
    # Others keep the digits before the first separator, or one where more than three stand there.
    lead = F.length(F.regexp_extract(value, r"^\+?(\d*)", 1))
    kept = F.when(lead.between(1, 3), lead).otherwise(F.lit(1))
    free = permuted(F.substring(number, kept + 1, F.length(number)), key, "phone")
    phone = F.when(value.rlike(TEN), ten_digits).otherwise(F.transform(F.array(free), lambda t: poured(value, F.concat(F.substring(number, F.lit(1), kept), t)))[0])
    octets = F.transform(F.split(value, "[.]"), lambda o: o.cast("int"))
    pair = lambda s, i: byte_of(keyed(key, F.lit("address"), i.cast("string"), s["r"][0].cast("string"), s["r"][1].cast("string")), F.lit(0))
    other = lambda s, i: byte_of(keyed(key, F.lit("address"), i.cast("string"), s["r"][0].cast("string"), s["r"][1].cast("string")), F.lit(1))
    start = F.struct(F.slice(octets, 1, 2).alias("l"), F.slice(octets, 3, 2).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), F.array((s["l"][0] + pair(s, i)) % 256, (s["l"][1] + other(s, i)) % 256).alias("r"))
    address = F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)), lambda e: F.array_join(F.transform(F.concat(e["l"], e["r"]), lambda o: o.cast("string")), "."))[0]
    apart = F.datediff(day_of(value), F.lit(FIRST_DAY).cast("date"))
    # Year-last dates are written day first, so that two days never share a text.
    dates = F.transform(F.array(F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_day(apart, key))), lambda d: F.when(value.rlike(r"^\d{4}"), F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd-MM-yyyy")))[0]
    date = F.when(value.contains("/"), F.replace(dates, F.lit("-"), F.lit("/"))).when(value.contains("."), F.replace(dates, F.lit("-"), F.lit("."))).otherwise(dates)
    at = F.instr(value, F.lit("@"))
    email = F.concat(permuted(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))
    return F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "address", address).when(kind == "date", date).when(kind == "email", email)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and ``found``: array of (kind, pseudonym) in text order (``found_``... where taken).

    Matches whose value is not valid stay as they are. Null stays null, empty stays empty; rows are looked at alone, so repeated rows give
    equal results; all rows and columns stay. A pseudonym shows no value: without the key it cannot be turned back.
    """
    text, found = F.col("text").cast("string"), fresh(docs.columns, "found")
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern()), F.lit(0)), F.split(text, pattern(), -1)
    named = F.transform(hits, lambda v: F.transform(F.array(F.struct(v.alias("v"), kind_of(v).alias("kind"))), lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), pseudonym(x["v"], x["kind"], key).alias("by")))[0])
    shape = "array<struct<v:string,kind:string,by:string>>"
    done = docs.withColumn(found, F.when(text.rlike("[0-9@]"), named).otherwise(F.array()).cast(shape))
    whole = F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(found), i)["by"], F.get(F.col(found), i)["v"], F.lit("")))))
    done = done.withColumn("text", F.when(F.size(found) > 0, whole).otherwise(text))
    return done.withColumn(found, F.transform(F.filter(found, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["by"].alias("pseudonym"))))


@query("op3_feistel_pseudonyms")
def op3_feistel_pseudonyms(spark, folder, key: str = "rotate-me") -> DataFrame:
    """All documents with pseudonyms, and how many values of which kinds were replaced."""
    out = pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.kind")), ",").alias("kinds"))
