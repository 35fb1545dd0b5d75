"""The rules that hold a claim against its licence record, and the decision over all stages.

Every rule fails closed: a comparison with a missing value is a failure, never unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import barcode, dates, text
from lanewise.operators import dimensions
from lanewise.operators.settings import Rules

ADVISORIES = ("COLOUR_MISMATCH", "COLOUR_UNVERIFIED", "LICENCE_FORMAT_UNUSUAL", "LIVENESS_SKIPPED_DEV")
#: A second selfie face of this score and share of the largest's area.
SECOND_SCORE, SECOND_AREA = 0.9, 0.25


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_record(claims: DataFrame) -> DataFrame:
    """claims with the parsed barcode as record."""
    return claims.withColumn("record", barcode.parse_barcode(F.col("barcode_text")))


def with_gates(claims: DataFrame, now: Column, rules: Rules = Rules()) -> DataFrame:
    """Adds barcode_reasons, barcode_advisories and checks to claims with a record, on the small jurisdiction table.

    Columns read: full_name, date_of_birth, licence_number, issuing_province, licence_class,
    issue_date, expiry_date, barcode_text, record. One pass: both lookups broadcast thirteen rows.
    """
    spark = claims.sparkSession
    table = dimensions.jurisdictions(spark)
    by_iin = F.broadcast(table.select(F.col("iin").alias("_iin"), F.col("province").alias("_iin_province")))
    by_province = F.broadcast(table.select(F.col("province").alias("_province"), "licence_pattern", "tz"))
    fields = F.col("record.fields")
    rows = claims.join(by_iin, F.col("record.iin") == F.col("_iin"), "left")
    rows = rows.withColumns({"_claimed": text.normal_province(F.col("issuing_province")), "_daj": text.normal_province(barcode.element(fields, "DAJ"))})
    rows = rows.withColumn("_of", F.coalesce("_iin_province", "_daj", "_claimed")).join(by_province, F.col("_of") == F.col("_province"), "left")
    raw = lambda k: F.nullif(barcode.element(fields, k), F.lit(""))
    rows = rows.withColumns({"_daq": text.normal_licence(raw("DAQ")), "_name": barcode.full_name(fields), "_class": text.normal_class(raw("DCA"))})
    rows = rows.withColumns({"_dob": barcode.element_date(fields, "DBB"), "_issued": barcode.element_date(fields, "DBD"), "_expiry": barcode.element_date(fields, "DBA")})
    rows = rows.withColumns({"_match": text.match_names(F.col("full_name"), F.col("_name"), rules.name_pass), "_today": dates.local_day(now, F.col("tz"))})

    same_province = _is((F.col("_iin_province") == F.col("_daj")) & (F.col("_daj") == F.col("_claimed")))
    known = F.col("_of").isNotNull()
    alike = lambda a, b: _is(F.col(a) == F.col(b))
    tests = [
        ("issuing_province", F.col("_claimed"), F.coalesce("_daj", "_iin_province"), same_province, None, "JURISDICTION_MISMATCH"),
        ("licence_number", F.col("licence_number"), raw("DAQ"), _is((F.col("_daq") != "") & (F.col("_daq") == text.normal_licence(F.col("licence_number")))), None, "LICENCE_NUMBER_MISMATCH"),
        ("full_name", F.col("full_name"), F.nullif("_name", F.lit("")), _is(F.col("_match.passed")), F.col("_match.score"), "NAME_MISMATCH"),
        ("date_of_birth", F.col("date_of_birth").cast("string"), F.col("_dob").cast("string"), alike("_dob", "date_of_birth"), None, "DOB_MISMATCH"),
        ("licence_class", F.col("licence_class"), raw("DCA"), _is((F.col("_class") != "") & (F.col("_class") == text.normal_class(F.col("licence_class")))), None, "CLASS_MISMATCH"),
        ("issue_date", F.col("issue_date").cast("string"), F.col("_issued").cast("string"), alike("_issued", "issue_date"), None, "ISSUE_DATE_MISMATCH"),
        ("expiry_date", F.col("expiry_date").cast("string"), F.col("_expiry").cast("string"), alike("_expiry", "expiry_date"), None, "EXPIRY_DATE_MISMATCH"),
    ]
    checks, reasons = [], []
    for i, (field, claimed, decoded, passed, score, code) in enumerate(tests):
        shown = F.struct(
            F.lit(field).alias("field"), claimed.alias("claimed"), decoded.alias("decoded"),
            F.round(F.when(passed, 100.0).otherwise(0.0) if score is None else score, 1).alias("score"),
            F.lit(100.0 if score is None else rules.name_pass).alias("threshold"), passed.alias("passed"),
        )
        checks.append(shown if i == 0 else F.when(known, shown))
        reasons.append(F.when(~passed & (F.lit(True) if i == 0 else known), code))
    reasons += [
        F.when(known & (F.col("_expiry").isNull() | (F.col("_today") > F.col("_expiry"))), "LICENCE_EXPIRED"),
        F.when(known & _is(F.col("_issued") > F.col("_today")), "LICENCE_NOT_YET_VALID"),
        F.when(known & _is(dates.age_on(F.col("_dob"), F.col("_today")) < rules.min_age), "UNDERAGE"),
    ]
    odd = known & (F.col("_daq") != "") & ~_is(F.rlike("_daq", F.col("licence_pattern")))
    parsed, none = F.col("record").isNotNull(), F.array().cast("array<string>")
    unread = F.when(F.coalesce("barcode_text", F.lit("")) == "", F.array(F.lit("BARCODE_UNREADABLE"))).otherwise(F.array(F.lit("BARCODE_NOT_AAMVA")))
    return rows.select(
        *claims.columns,
        F.col("_of").alias("province"),
        F.when(parsed, F.array_compact(F.array(*reasons))).otherwise(unread).alias("barcode_reasons"),
        F.when(parsed & odd, F.array(F.lit("LICENCE_FORMAT_UNUSUAL"))).otherwise(none).alias("barcode_advisories"),
        F.when(parsed, F.array_compact(F.array(*checks))).alias("checks"),
    )


def by_area(faces: Column) -> Column:
    """Faces from the largest on, the first one first among equals."""
    placed = F.transform(faces, lambda f, i: F.struct((-(f["w"] * f["h"])).alias("area"), i.alias("ord"), f.alias("face")))
    return F.transform(F.array_sort(placed), lambda p: p["face"])


def selfie_reason(faces: Column) -> Column:
    """Why the selfie's faces can't be used, or null."""
    ranked = by_area(faces)
    second, area = F.get(ranked, 1), lambda f: f["w"] * f["h"]
    crowd = _is((second["score"] >= SECOND_SCORE) & (area(second) >= SECOND_AREA * area(F.get(ranked, 0))))
    return F.when(F.coalesce(F.size(faces), F.lit(0)) <= 0, "FACE_NOT_FOUND_SELFIE").when(crowd, "IMAGE_QUALITY")


def with_face(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds face_reasons from selfie_faces, licence_faces, liveness and similarity (both scores from model outputs)."""
    selfie = selfie_reason(F.col("selfie_faces"))
    first = F.array_compact(
        F.array(
            selfie,
            F.when(selfie.isNull() & ~_is(F.col("liveness") >= rules.live_pass), "LIVENESS_FAILED"),
            F.when(F.coalesce(F.size("licence_faces"), F.lit(0)) <= 0, "FACE_NOT_FOUND_LICENCE"),
        )
    )
    unlike = F.when(_is(F.col("similarity") >= rules.face_pass), F.array().cast("array<string>")).otherwise(F.array(F.lit("FACE_MISMATCH")))
    return rows.withColumn("face_reasons", F.when(F.size(first) > 0, first).otherwise(unlike))


def colour_family(claimed: Column) -> Column:
    """The palette names that the claimed colour words allow; null if there are none. Light blue is a colour of its own."""
    words = text.colour_tokens(claimed)
    table = F.create_map(*[x for w, names in dimensions.COLOUR_WORDS.items() for x in (F.lit(w), F.array(*map(F.lit, names)))])
    family = F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))))
    light = F.array_contains(words, "light") & F.array_contains(words, "blue")
    return F.when(light, F.array(F.lit("Light Blue"))).when(F.size(family) > 0, family)


def with_vehicle(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds vehicle_reasons and vehicle_advisories from plate_found, plate_read, plate_confidence, plate_number, colour and vehicle_colour."""
    found = _is(F.col("plate_found"))
    unsure = (text.blank(F.col("plate_read")) == "") | ~_is(F.col("plate_confidence") >= rules.plate_pass)
    reason = F.when(~found, "PLATE_NOT_FOUND").when(unsure, "PLATE_UNREADABLE").when(~_is(text.match_plates(F.col("plate_read"), F.col("plate_number"))), "PLATE_MISMATCH")
    family = colour_family(F.col("vehicle_colour"))
    advice = F.when(F.col("colour").isNull() | family.isNull(), "COLOUR_UNVERIFIED").when(~F.array_contains(family, F.col("colour")), "COLOUR_MISMATCH")
    return rows.withColumn("vehicle_reasons", F.array_compact(F.array(reason))).withColumn("vehicle_advisories", F.array_compact(F.array(F.when(found, advice))))


def with_decision(rows: DataFrame, liveness_skipped: bool = False) -> DataFrame:
    """Adds ran, reasons, advisories and decision. After a barcode reason the other two stages haven't run."""
    ran, none = F.size("barcode_reasons") == 0, F.array().cast("array<string>")
    only = lambda c: F.when(ran, F.col(c)).otherwise(none)
    advisories = [F.col("barcode_advisories"), only("vehicle_advisories")] + [F.array(F.lit("LIVENESS_SKIPPED_DEV"))] * liveness_skipped
    rows = rows.withColumn("reasons", F.array_distinct(F.concat("barcode_reasons", only("face_reasons"), only("vehicle_reasons"))))
    return rows.withColumns({"stages_ran": ran, "advisories": F.concat(*advisories), "decision": F.when(ran & (F.size("reasons") == 0), "APPROVED").otherwise("REJECTED")})


def explained(rows: DataFrame) -> DataFrame:
    """A row for each reason with what the code table says of it."""
    codes = dimensions.reason_codes(rows.sparkSession)
    return rows.select("request_id", F.posexplode("reasons").alias("ord", "code")).join(F.broadcast(codes), "code")
