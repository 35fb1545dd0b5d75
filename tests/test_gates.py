"""One mutation of a sound claim for each case, at a fixed clock."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanewise.operators import gates
from tests.test_records import ELEMENTS, card

CLAIM = {
    "request_id": "r1", "full_name": "Nora Elise Winter", "date_of_birth": dt.date(1988, 11, 7), "licence_number": "W2048-61739-50246", "issuing_province": "ON",
    "licence_class": "G", "issue_date": dt.date(2023, 9, 14), "expiry_date": dt.date(2030, 12, 31),
}
SCHEMA = "request_id string, full_name string, date_of_birth date, licence_number string, issuing_province string, licence_class string, issue_date date, expiry_date date, barcode_text string"


def gated(spark, claim=None, elements=None, now="2026-11-11 15:00:00", text=None, iin=None):
    text = card(ELEMENTS | (elements or {})) if text is None else text
    text = text.replace("636012", iin) if iin else text
    rows = spark.createDataFrame([(*(CLAIM | (claim or {})).values(), text)], SCHEMA)
    return gates.with_gates(gates.with_record(rows), F.lit(now).cast("timestamp")).first()


CASES = [
    ({}, {}, []),
    ({"licence_class": " g "}, {}, []),
    ({"licence_class": "M"}, {}, ["CLASS_MISMATCH"]),
    ({"licence_class": None}, {}, ["CLASS_MISMATCH"]),
    ({"issue_date": dt.date(2023, 9, 15)}, {}, ["ISSUE_DATE_MISMATCH"]),
    ({"expiry_date": dt.date(2031, 1, 1)}, {}, ["EXPIRY_DATE_MISMATCH"]),
    ({"date_of_birth": dt.date(1988, 11, 8)}, {}, ["DOB_MISMATCH"]),
    ({"licence_number": "T9990"}, {}, ["LICENCE_NUMBER_MISMATCH"]),
    ({"issuing_province": "QC"}, {}, ["JURISDICTION_MISMATCH"]),
    ({"issuing_province": "ZZ"}, {}, ["JURISDICTION_MISMATCH"]),
    ({}, {"DAJ": "QC"}, ["JURISDICTION_MISMATCH"]),
    ({"full_name": "Nora Elise Wintor"}, {}, []),
    ({"full_name": "Noel Elise Winter"}, {}, ["NAME_MISMATCH"]),
    ({"expiry_date": dt.date(2026, 11, 11)}, {"DBA": "20261111"}, []),
    ({"expiry_date": dt.date(2026, 11, 10)}, {"DBA": "20261110"}, ["LICENCE_EXPIRED"]),
    ({"issue_date": dt.date(2026, 11, 12)}, {"DBD": "20261112"}, ["LICENCE_NOT_YET_VALID"]),
    ({"date_of_birth": dt.date(2009, 3, 15)}, {"DBB": "20090315"}, ["UNDERAGE"]),
    ({"date_of_birth": dt.date(2008, 11, 11)}, {"DBB": "20081111"}, []),
    ({}, {"DBA": "", "DBB": ""}, ["DOB_MISMATCH", "EXPIRY_DATE_MISMATCH", "LICENCE_EXPIRED"]),
]


@pytest.mark.parametrize(("claim", "elements", "reasons"), CASES)
def test_reasons(spark, claim, elements, reasons):
    assert gated(spark, claim, elements)["barcode_reasons"] == reasons


def test_order_of_checks_and_scores(spark):
    row = gated(spark, {"full_name": "Nora Elise Wintor"})
    assert [c["field"] for c in row["checks"]] == ["issuing_province", "licence_number", "full_name", "date_of_birth", "licence_class", "issue_date", "expiry_date"]
    assert [c["score"] for c in row["checks"]] == [100, 100, 94.1, 100, 100, 100, 100]


def test_local_midnight(spark):
    card_, claim = {"DBA": "20260601", "DAJ": "BC", "DAQ": "1234567"}, {"expiry_date": dt.date(2026, 6, 1), "issuing_province": "BC", "licence_number": "1234567"}
    assert gated(spark, claim, card_, "2026-06-02 02:00:00", iin="636028")["barcode_reasons"] == []
    assert gated(spark, claim, card_, "2026-06-02 08:00:00", iin="636028")["barcode_reasons"] == ["LICENCE_EXPIRED"]


def test_format_is_advice(spark):
    row = gated(spark, {"licence_number": "123"}, {"DAQ": "123"})
    assert (row["barcode_reasons"], row["barcode_advisories"]) == ([], ["LICENCE_FORMAT_UNUSUAL"])


def test_unknown_province_stops(spark):
    row = gated(spark, {"issuing_province": "ZZ"}, {"DAJ": ""}, iin="999999")
    assert (row["barcode_reasons"], len(row["checks"])) == (["JURISDICTION_MISMATCH"], 1)


def test_unreadable(spark):
    assert gated(spark, text="")["barcode_reasons"] == ["BARCODE_UNREADABLE"]
    assert gated(spark, text="hello")["barcode_reasons"] == ["BARCODE_NOT_AAMVA"]


def test_later_stages_fail_closed(spark):
    face = "array<struct<score: double, x: int, y: int, w: int, h: int>>"
    rows = spark.createDataFrame(
        [
            (1, [], [(0.9, 0, 0, 9, 9)], 0.9, 0.9),
            (2, [(0.9, 0, 0, 10, 10), (0.9, 0, 0, 5, 5)], [(0.9, 0, 0, 9, 9)], 0.9, 0.9),
            (3, [(0.9, 0, 0, 10, 10), (0.8, 0, 0, 9, 9)], [], 0.1, 0.9),
            (4, [(0.9, 0, 0, 10, 10)], [(0.9, 0, 0, 9, 9)], None, 0.9),
            (5, [(0.9, 0, 0, 10, 10)], [(0.9, 0, 0, 9, 9)], 0.9, None),
            (6, [(0.9, 0, 0, 10, 10)], [(0.9, 0, 0, 9, 9)], 0.9, 0.35),
        ],
        f"i int, selfie_faces {face}, licence_faces {face}, liveness double, similarity double",
    )
    got = [r[0] for r in gates.with_face(rows).orderBy("i").select("face_reasons").collect()]
    assert got == [["FACE_NOT_FOUND_SELFIE"], ["IMAGE_QUALITY"], ["LIVENESS_FAILED", "FACE_NOT_FOUND_LICENCE"], ["LIVENESS_FAILED"], ["FACE_MISMATCH"], []]
