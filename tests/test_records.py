"""Card texts to fields: the cases of the fixtures' table of variants."""

import datetime as dt
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lanewise.functions import barcode, dates

ELEMENTS = {"DCA": "G", "DCB": "NONE", "DBA": "20301231", "DCS": "WINTER", "DAC": "NORA", "DAD": "ELISE", "DBD": "20230914", "DBB": "19881107", "DAJ": "ON", "DAQ": "W20486173950246", "DCG": "CAN"}


def card(elements, more=(), version="09", offset=None):
    """A card's text: a DL subfile and others, whose directory says 0 for the place of number offset, or of all of them."""
    texts = [kind + "".join(map("{}{}\n".format, own, own.values())) + "\r" for kind, own in (("DL", elements), *more)]
    head = f"@\n\x1e\rANSI 636012{version}{'' if version == '01' else '00'}{len(texts):02d}"
    places = accumulate(map(len, texts[:-1]), initial=len(head) + 10 * len(texts))
    entries = [f"{x[:2]}{0 if offset in (i, 'all') else at:04d}{len(x):04d}" for i, (x, at) in enumerate(zip(texts, places, strict=True))]
    return "".join([head, *entries, *texts])


def parsed(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", barcode.parse_barcode(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] and (r["r"]["iin"], r["r"]["version"], r["r"]["fields"]) for r in found]


def test_plain_card(spark):
    (got,) = parsed(spark, card(ELEMENTS))
    assert got == ("636012", "09", ELEMENTS)


def test_variants(spark):
    zo = [("ZO", {"ZOA": "NORA WINTER,", "ZOB": "Y"})]
    both = ELEMENTS | zo[0][1]
    got = parsed(spark, card(ELEMENTS, zo), card(ELEMENTS, zo, offset=0), card(ELEMENTS, zo, offset=1), card(ELEMENTS, zo, offset="all"), card(ELEMENTS, version="01"), card(ELEMENTS).replace("DL00", "DLXX", 1))
    assert [g[2] for g in got] == [both, both, both, both, ELEMENTS, ELEMENTS]


def test_no_card(spark):
    assert parsed(spark, "hello world", "", None, "@\n\x1e\rANSI 636012090001") == [None] * 4


def test_empty_element(spark):
    (got,) = parsed(spark, card(ELEMENTS | {"DCB": ""}))
    assert got[2]["DCB"] == ""


def test_last_of_repeated_elements(spark):
    (got,) = parsed(spark, "@\n\x1e\rANSI 636012090001DLDAQ1\nDAQ2\nDAC\n")
    assert got[2] == {"DAQ": "2", "DAC": ""}


@pytest.mark.parametrize(
    ("country", "value", "day"),
    [("CAN", "19900315", "1990-03-15"), ("USA", "03151990", "1990-03-15"), (None, "19900315", "1990-03-15"), (None, "03151990", "1990-03-15"), ("CAN", "19901301", None), ("CAN", "1990", None), ("CAN", "20090229", None), (None, "20002000", None), ("CAN", None, None)],
)
def test_dates(spark, country, value, day):
    row = spark.createDataFrame([(country, value)], "c string, v string")
    got = row.select(dates.card_date(F.col("v"), dates.date_order(F.col("c"), F.col("v")))).first()[0]
    assert got == (dt.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize(
    ("fields", "name"),
    [
        ({"DAC": "NORA", "DAD": "ELISE", "DCS": "WINTER"}, "NORA ELISE WINTER"),
        ({"DAC": "NORA", "DAD": "NONE", "DCS": "WINTER"}, "NORA WINTER"),
        ({"DCT": "NORA ELISE", "DCS": "WINTER"}, "NORA ELISE WINTER"),
        ({"DAA": "WINTER,NORA"}, "WINTER NORA"),
        ({"DAC": "", "ZOA": "NORA WINTER,"}, "NORA WINTER"),
        ({"DCS": "WINTER"}, "WINTER"),
        ({"DAQ": "1"}, ""),
    ],
)
def test_full_name(spark, fields, name):
    assert spark.createDataFrame([(fields,)], "f map<string, string>").select(barcode.full_name(F.col("f"))).first()[0] == name


def test_age_of_a_leap_day(spark):
    rows = spark.createDataFrame([("2008-02-29", "2026-02-28"), ("2008-02-29", "2026-03-01"), ("1990-03-15", "2026-03-15")], "b string, d string")
    got = rows.select(dates.age_on(F.to_date("b"), F.to_date("d"))).collect()
    assert [r[0] for r in got] == [17, 18, 36]


def test_failures_parse_each_barcode_once(spark):
    """A filter on rows would be pushed below the parser and repeat it, and with it every column that the text is derived from."""
    from lanewise.plans import further

    plan = further.barcode_failures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
