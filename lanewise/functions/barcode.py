"""Licence barcode text to typed fields, as column expressions without a UDF.

The directory of subfiles is walked by an aggregate that carries what has been read so far; if any of
it is malformed the whole text is scanned line by line instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import card_date, date_order
from .text import bind

HEADER = "^@[\\n\\r\\x1e]{0,4}(?:ANSI |AAMVA)([0-9]{6})([0-9]{2})"
#: The first line of a text without a usable directory begins with a subfile type.
FIRST = "(?:DL|ID|ZO|ZV|ZJ|ZA|ZB|ZC)([A-Z]{3}.*)$"
_PAIRS = "array<struct<key: string, value: string>>"


def _pairs(lines: Column) -> Column:
    found = F.filter(lines, lambda x: x.rlike("^[A-Z]{3}"))
    return F.transform(found, lambda x: F.struct(F.substring(x, 1, 3).alias("key"), F.trim(F.substr(x, F.lit(4))).alias("value")))


def last_of_each(pairs: Column) -> Column:
    """A map in which the last pair of a key holds, whatever the session says of repeated keys."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])))


def _lines(body: Column) -> Column:
    return F.split(body, "[\\n\\r]")


def _found(text: Column, kind: Column, begin: Column) -> Column:
    """0-based place at or after begin of the first kind that three capitals follow; -1 if there is none."""
    place = F.regexp_instr(F.substr(text, begin + 1), F.concat(kind, F.lit("[A-Z]{3}")))
    return F.when(place > 0, begin + place - 1).otherwise(-1)


def _directory(text: Column, head: Column) -> Column:
    """The pairs of all subfiles that the directory lists; null if the directory or a subfile is malformed.

    head is struct<at, count, done>: the place of the two digits that count the entries, their number
    (null if they are no digits) and the place after the last entry.
    """
    at, count, done = head["at"], head["count"], head["done"]
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    entries = F.transform(places, lambda i: F.substr(text, at + 3 + i * 10, F.lit(10)))

    def step(state: Column, entry: Column) -> Column:
        kind, offset, length = F.substring(entry, 1, 2), F.substring(entry, 3, 4).cast("int"), F.substring(entry, 7, 4).cast("int")
        straight = (offset >= done) & (F.substr(text, offset + 1, F.lit(2)) == kind)
        begin = F.when(straight, offset).otherwise(_found(text, kind, state["cursor"]))

        def read(x: Column) -> Column:
            ok = state["ok"] & (F.length(x["body"]) >= 3)
            inner = F.when(x["body"].startswith(kind), F.substr(x["body"], F.lit(3))).otherwise(x["body"])
            return F.when(
                ok,
                F.struct(F.lit(True).alias("ok"), (x["start"] + F.length(x["body"])).alias("cursor"), F.concat(state["pairs"], _pairs(_lines(inner))).alias("pairs")),
            ).otherwise(F.struct(F.lit(False).alias("ok"), state["cursor"].alias("cursor"), state["pairs"].alias("pairs")))

        found = bind(begin, lambda start: F.struct(start.alias("start"), F.when(start >= 0, F.substr(text, start + 1, length)).otherwise("").alias("body")))
        return bind(found, read)

    def walk(list_: Column) -> Column:
        sound = count.isNotNull() & F.forall(list_, lambda e: e.rlike("^.{2}[0-9]{8}$"))
        empty = F.struct(F.lit(True).alias("ok"), done.alias("cursor"), F.array().cast(_PAIRS).alias("pairs"))
        whole = F.aggregate(list_, empty, step, lambda s: F.when(s["ok"] & (F.size(s["pairs"]) > 0), s["pairs"]))
        return F.when(sound, whole)

    return bind(entries, walk)


def _scanned(text: Column, end: Column) -> Column:
    lines = _lines(F.substr(text, end + 1))
    first = F.regexp_extract(F.get(lines, 0), FIRST, 1)
    return _pairs(F.concat(F.array(first), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))))


def parse_barcode(text: Column) -> Column:
    """struct<iin, version, fields> of a licence barcode's text; null if it is none or has no field.

    Each part is bound to a lambda's variable, so that the expressions built on it compute it once.
    """
    begun = F.struct(F.length(F.regexp_extract(text, HEADER, 0)).alias("end"), F.regexp_extract(text, HEADER, 1).alias("iin"), F.regexp_extract(text, HEADER, 2).alias("version"))

    def counted(h: Column) -> Column:
        at = h["end"] + F.when(h["version"].cast("int") >= 2, 2).otherwise(0)
        digits = F.substr(text, at + 1, F.lit(2))
        return F.struct(at.alias("at"), F.when(digits.rlike("^[0-9]{2}$"), digits.cast("int")).alias("count"))

    def placed(c: Column) -> Column:
        return F.struct(c["at"].alias("at"), c["count"].alias("count"), (c["at"] + 2 + 10 * F.coalesce(c["count"], F.lit(0))).alias("done"))

    def record(h: Column) -> Column:
        listed = bind(bind(counted(h), placed), lambda d: _directory(text, d))
        pairs = F.coalesce(listed, _scanned(text, h["end"]))
        return bind(pairs, lambda p: F.when(F.size(p) > 0, F.struct(h["iin"].alias("iin"), h["version"].alias("version"), last_of_each(p).alias("fields"))))

    return F.when(text.rlike(HEADER), bind(begun, record))


def element(fields: Column, key: str) -> Column:
    """The element, or the empty string if it is missing."""
    return F.coalesce(F.try_element_at(fields, F.lit(key)), F.lit(""))


def element_date(fields: Column, key: str) -> Column:
    value = F.try_element_at(fields, F.lit(key))
    return card_date(value, date_order(F.nullif(element(fields, "DCG"), F.lit("")), value))


def full_name(fields: Column) -> Column:
    """First, middle and last name by the first set of elements that is there."""
    f = lambda k: element(fields, k)
    middle = F.when(F.upper(f("DAD")) == "NONE", "").otherwise(f("DAD"))
    name = (
        F.when((f("DAC") != "") & (f("DCS") != ""), F.concat_ws(" ", f("DAC"), middle, f("DCS")))
        .when((f("DCT") != "") & (f("DCS") != ""), F.concat_ws(" ", f("DCT"), f("DCS")))
        .when(f("DAA") != "", f("DAA"))
        .when(f("ZOA") != "", f("ZOA"))
        .otherwise(f("DCS"))
    )
    return F.trim(F.regexp_replace(F.translate(name, ",", " "), r"\s+", " "))
