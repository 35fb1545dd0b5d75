"""Claims, licence cards and model outputs derived from the order tables by key arithmetic.

The expressions are written in the SQL that Spark and DuckDB share, so both engines derive the same
rows; nothing is random. Every order is one request, and its key decides which field disagrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of all queries.
NOW = "2024-06-15 03:30:00"
#: What is wrong with request k: the case k % CASES.
CASES = 20


def pick(values: list[str], index: str) -> str:
    """The value at an index that counts from 0."""
    return f"split_part('{'|'.join(values)}', '|', cast({index} as int) + 1)"


def iso(y: str, m: str, d: str) -> str:
    return f"concat({y}, '-', lpad(cast({m} as string), 2, '0'), '-', lpad(cast({d} as string), 2, '0'))"


def _digits(date: str, usa: str) -> str:
    y, m, d = f"substr({date}, 1, 4)", f"substr({date}, 6, 2)", f"substr({date}, 9, 2)"
    return f"CASE WHEN {usa} THEN concat({m}, {d}, {y}) ELSE concat({y}, {m}, {d}) END"


_PROVINCES = ["ON", "QC", "BC", "AB", "MB", "SK", "NB", "NS", "NL", "PE", "YT", "NT", "NU"]
_ISSUERS = ["636012", "604428", "636028", "604432", "636048", "636044", "636017", "636013", "636016", "604426", "604429", "604434", "604433"]

#: Steps of (column, expression) over orders: each step may use the columns of the ones before.
CARD = [
    [("k", "o_orderkey"), ("c", "o_custkey"), ("m", f"o_orderkey % {CASES}")],
    [
        ("province", pick(_PROVINCES, "k % 13")),
        ("issuer", f"CASE WHEN m = 10 THEN '999999' ELSE {pick(_ISSUERS, 'k % 13')} END"),
        ("first", pick(["ALEX", "JOHN", "MARIE", "LI", "OLGA", "JEAN-LUC", "ANA"], "c % 7")),
        ("middle", pick(["JAMIE", "NONE", "ANNE", "LEE", "NONE"], "c % 5")),
        ("last", pick(["SMITH", "TESTER", "ROY", "OBRIEN", "GAGNON", "NGUYEN", "SINGH", "TREMBLAY", "WONG", "CLARK", "LEBLANC"], "c % 11")),
        ("dob", f"CASE WHEN k % 29 = 0 THEN {pick(['2006-06-14', '2006-06-15', '2006-06-16'], 'k % 3')} ELSE {iso('cast(1940 + (c * 37) % 64 as string)', '1 + c % 12', '1 + c % 28')} END"),
        ("issue", f"CASE WHEN k % 31 = 0 THEN {pick(['2024-06-14', '2024-06-15', '2024-06-16'], 'k % 3')} ELSE {iso('cast(2017 + k % 7 as string)', '1 + k % 12', '1 + k % 28')} END"),
        ("expiry", f"CASE WHEN k % 17 = 0 THEN {pick(['2024-06-13', '2024-06-14', '2024-06-15'], 'k % 3')} ELSE {iso('cast(2025 + k % 5 as string)', '1 + k % 12', '1 + k % 28')} END"),
        ("licence_class", pick(["G", "5", "C", "M1"], "k % 4")),
        ("usa", "m = 15"),
    ],
    [
        ("daq", "CASE WHEN m = 9 THEN '' WHEN province IN ('ON', 'MB') THEN concat('T', lpad(cast(k as string), 14, '0')) WHEN province = 'QC' THEN concat('Q', lpad(cast(k as string), 12, '0')) WHEN province = 'NL' THEN concat('L', lpad(cast(k as string), 9, '0')) ELSE lpad(cast(k % 100000000 as string), 8, '0') END"),
        ("daj", "CASE WHEN m = 10 THEN '' WHEN province = 'NL' THEN 'NF' ELSE province END"),
        ("claim_province", "CASE WHEN m = 8 THEN CASE WHEN province = 'ON' THEN 'QC' ELSE 'ON' END WHEN m = 10 THEN 'ZZ' WHEN m = 3 THEN concat(' ', lower(province)) ELSE province END"),
        ("claim_name", "CASE WHEN m = 1 THEN concat(first, ' ', last, 'X') WHEN m = 2 THEN concat(last, ', ', first) WHEN m = 13 THEN concat(first, ' QUINN') WHEN m = 16 THEN last WHEN middle = 'NONE' THEN concat(first, ' ', last) ELSE concat(first, ' ', middle, ' ', last) END"),
        ("claim_class", "CASE WHEN m = 3 THEN concat(' ', lower(licence_class), ' ') WHEN m = 17 THEN 'Z' ELSE licence_class END"),
        ("claim_dob", "CASE WHEN m = 4 THEN '1955-05-05' ELSE dob END"),
        ("claim_issue", "CASE WHEN m = 5 THEN '2016-01-02' ELSE issue END"),
        ("claim_expiry", "CASE WHEN m = 6 THEN '2033-03-03' ELSE expiry END"),
    ],
    [
        ("claim_number", "CASE WHEN m = 7 THEN 'T0000-00000-00000' WHEN length(daq) > 6 THEN concat(substr(daq, 1, 5), '-', substr(daq, 6, 20)) ELSE daq END"),
        ("version", "CASE WHEN m = 14 THEN '01' ELSE '09' END"),
        (
            "body",
            "concat('DLDCA', licence_class, chr(10), 'DAC', first, chr(10), 'DAD', middle, chr(10), 'DCS', last, chr(10), 'DBD', "
            + _digits("issue", "usa") + ", chr(10), 'DBB', " + _digits("dob", "usa") + ", chr(10), 'DBA', " + _digits("expiry", "usa")
            + ", chr(10), 'DAJ', daj, chr(10), 'DAQ', daq, chr(10), 'DCG', CASE WHEN usa THEN 'USA' ELSE 'CAN' END, chr(10), 'DAG1 TEST ST', chr(10), 'DCB', chr(13))",
        ),
    ],
    [
        ("head", "concat('@', chr(10), chr(30), chr(13), 'ANSI ', issuer, version, CASE WHEN version = '01' THEN '' ELSE '00' END, '01')"),
    ],
    [
        (
            "barcode_text",
            "CASE WHEN m = 11 THEN 'hello world' WHEN m = 12 THEN '' ELSE concat(head, 'DL', CASE WHEN m = 18 THEN '00XX' WHEN m = 19 THEN '0000' "
            "ELSE lpad(cast(length(head) + 10 as string), 4, '0') END, lpad(cast(length(body) as string), 4, '0'), body) END",
        ),
    ],
    [
        ("request_id", "concat('r', cast(k as string))"),
        ("driver_id", "concat('d', cast(c as string))"),
        ("plate_number", "concat(chr(cast(65 + k % 26 as int)), 'B', chr(cast(73 + k % 7 as int)), cast(100 + k % 900 as string))"),
        ("vehicle_colour", pick(["Grey", "light blue", "Navy-Blue", "red/maroon", "teal", "Gold", "white", "charcoal"], "k % 8")),
    ],
    [
        ("plate_read", "CASE WHEN k % 10 = 0 THEN replace(plate_number, '1', 'I') WHEN k % 10 = 1 THEN concat(lower(substr(plate_number, 1, 3)), ' ', substr(plate_number, 4, 3)) WHEN k % 10 = 2 THEN 'XYZ999' WHEN k % 10 = 3 THEN '' ELSE plate_number END"),
        ("plate_confidence", "0.5 + cast(k % 50 as double) / 100"),
        ("plate_found", "k % 23 <> 0"),
        ("liveness", "cast(k % 40 as double) / 40 + 0.45"),
        ("similarity", "cast((k * 7) % 100 as double) / 100"),
        ("colour", "CASE WHEN k % 19 = 0 THEN NULL ELSE " + pick(["Grey", "Light Blue", "Deep Navy Blue", "Red", "Blue", "Yellow / Gold", "White", "Black"], "(k + k % 3) % 8") + " END"),
        ("n_selfie", "CASE WHEN k % 27 = 0 THEN 0 WHEN k % 5 = 0 THEN 2 ELSE 1 END"),
        ("second_score", "0.8 + cast(k % 4 as double) / 20"),
        ("second_side", "cast(20 + k % 60 as int)"),
        ("n_licence", "CASE WHEN k % 37 = 0 THEN 0 ELSE 1 END"),
    ],
]


def derived(table: DataFrame, steps: list[list[tuple[str, str]]]) -> DataFrame:
    for step in steps:
        table = table.withColumns({name: F.expr(sql) for name, sql in step})
    return table


def sql_steps(table: str, steps: list[list[tuple[str, str]]], prefix: str = "f") -> str:
    """The same steps as common table expressions; the last is named prefix."""
    parts, before = [], table
    for i, step in enumerate(steps):
        name = prefix if i == len(steps) - 1 else f"{prefix}{i}"
        parts.append(f"{name} AS (SELECT *, {', '.join(f'{sql} AS {column}' for column, sql in step)} FROM {before})")
        before = name
    return ", ".join(parts).replace("AS first", 'AS "first"').replace("AS last", 'AS "last"')


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _faces(n: str, score: str, side: str) -> Column:
    face = lambda s, x: F.struct(s.cast("double").alias("score"), F.lit(0).alias("x"), F.lit(0).alias("y"), x.cast("int").alias("w"), x.cast("int").alias("h"))
    two = F.array(face(F.col(score), F.col(side)), face(F.lit(0.97), F.lit(100)))
    return F.when(F.col(n) == 0, F.slice(two, 1, 0)).when(F.col(n) == 1, F.slice(two, 2, 1)).otherwise(two)


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """The derived columns of all orders.

    The rules that follow cost far more than moving two keys, so a table of fewer files than cores is
    spread over them first; a table of many files is left as it is read.
    """
    keys = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    cores = spark.sparkContext.defaultParallelism
    if keys.rdd.getNumPartitions() < cores:
        keys = keys.repartition(cores, "o_orderkey")
    return derived(keys, CARD)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims beside the barcode text and the model outputs of each request."""
    day = lambda c: F.to_date(c)
    return cards(spark, folder).select(
        "request_id", "driver_id", F.col("claim_name").alias("full_name"), day("claim_dob").alias("date_of_birth"), F.col("claim_number").alias("licence_number"),
        F.col("claim_province").alias("issuing_province"), "plate_number", "vehicle_colour", F.col("claim_class").alias("licence_class"),
        day("claim_issue").alias("issue_date"), day("claim_expiry").alias("expiry_date"), "barcode_text", "liveness", "similarity", "plate_found", "plate_read",
        "plate_confidence", "colour", _faces("n_selfie", "second_score", "second_side").alias("selfie_faces"), _faces("n_licence", "second_score", "second_side").alias("licence_faces"),
    )
