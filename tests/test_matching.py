"""Names, plates, paths and validation."""

import pytest
from pyspark.sql import functions as F

from lanewise.functions import text


def names(spark, a, b):
    return tuple(spark.createDataFrame([(a, b)], "a string, b string").select(text.match_names(F.col("a"), F.col("b")).alias("x")).select("x.*").first())


@pytest.mark.parametrize(
    ("a", "b", "passed", "score"),
    [
        ("José-Luis García", "GARCIA, JOSE LUIS", True, 100.0),
        ("Nora Winter", "NORA ELISE WINTER", True, 100.0),
        ("Nora Elise Winter", "WINTER NORA", True, 100.0),
        ("Smith", "JOHN SMITH", False, None),
        ("Jon Smith", "SMITH, JOHN ANDREW", False, None),
        ("John Smith", "JOHN SMYTH", True, 90.0),
        ("Nora Elise Wintor", "NORA ELISE WINTER", True, 100 * 32 / 34),
        ("Noel Elise Winter", "NORA ELISE WINTER", False, 100 * 30 / 34),
        ("", "JOHN", False, 0.0),
        (None, None, False, 0.0),
    ],
)
def test_names(spark, a, b, passed, score):
    got = names(spark, a, b)
    assert got[0] is passed
    assert score is None or got[1] == pytest.approx(score)
    assert names(spark, b, a) == got


@pytest.mark.parametrize(("a", "b", "same"), [("ABC 123", "abc-123", True), ("ABCO23", "ABC023", True), ("ABI123", "AB1123", True), ("A8C123", "ABC123", True), ("ABC124", "ABC123", False), ("O0C123", "0OC123", False), ("ABC12", "ABC123", False), ("", "", False), (None, "A", False)])
def test_plates(spark, a, b, same):
    for x, y in ((a, b), (b, a)):
        assert spark.createDataFrame([(x, y)], "a string, b string").select(text.match_plates(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize(("name", "safe"), [("a b", "a_b"), ("../x", "x"), ("a/b\\c", "a_b_c"), ("", "unknown"), (None, "unknown"), ("...", "unknown"), ("x" * 80, "x" * 64), ("é.jpg", "jpg")])
def test_folders(spark, name, safe):
    assert spark.createDataFrame([(name,)], "n string").select(text.safe_folder(F.col("n"))).first()[0] == safe


@pytest.mark.parametrize(("key", "ok"), [("sessions/a/b", True), ("a//b", False), ("a/../b", False), ("a/x.tmp", False), ("a/x.TMP", False), ("", False), (None, False)])
def test_keys(spark, key, ok):
    assert spark.createDataFrame([(key,)], "k string").select(text.valid_key(F.col("k"))).first()[0] is ok


def test_provinces(spark):
    rows = spark.createDataFrame([(" on ",), ("NF",), ("ZZ",), (None,)], "p string")
    assert [r[0] for r in rows.select(text.normal_province(F.col("p"))).collect()] == ["ON", "NL", None, None]
