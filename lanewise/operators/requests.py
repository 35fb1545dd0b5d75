"""Validation of request forms: the first rule that a form breaks gives its error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import text

MAX_TEXT = 200
MAX_IMAGE_BYTES = 12 << 20
ID = "^[A-Za-z0-9_-]{1,64}$"
_ISO_DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ISO_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?"


def _error(when: Column, code: str, field: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))


def validated(form: DataFrame) -> DataFrame:
    """Adds error_code and error_field, both null for a sound form; rules hold in their fixed order."""
    clean = lambda c: F.trim(text.blank(F.col(c)))
    rules = []
    for column, field in (("form_request_id", "request_id"), ("form_driver_id", "driver_id")):
        rules += [_error(clean(column) == "", "MISSING_FIELD", field), _error(~clean(column).rlike(ID), "INVALID_FIELD", field)]
    at = clean("consent_at")
    zoned = at.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    rules += [
        _error((at == "") | (clean("consent_policy_version") == ""), "CONSENT_REQUIRED", "consent_at"),
        _error(~at.rlike(_ISO_TIME) | F.try_to_timestamp(at).isNull(), "INVALID_FIELD", "consent_at"),
        _error(~zoned, "INVALID_FIELD", "consent_at"),
        _error(F.length(clean("consent_policy_version")) > MAX_TEXT, "INVALID_FIELD", "consent_policy_version"),
    ]
    for column, field in (("form_name", "full_name"), ("claim_number", "licence_number"), ("plate_number", "plate_number"), ("vehicle_colour", "vehicle_colour"), ("claim_class", "licence_class")):
        rules += [_error(clean(column) == "", "MISSING_FIELD", f"claimed.{field}"), _error(F.length(clean(column)) > MAX_TEXT, "INVALID_FIELD", f"claimed.{field}")]
    for column, field in (("form_dob", "date_of_birth"), ("claim_issue", "issue_date"), ("claim_expiry", "expiry_date")):
        day = clean(column)
        sound = day.rlike(_ISO_DAY) & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
        rules += [_error(day == "", "MISSING_FIELD", f"claimed.{field}"), _error(~sound, "INVALID_FIELD", f"claimed.{field}")]
    year = clean("vehicle_year")
    rules += [
        _error(text.normal_province(F.col("form_province")).isNull(), "INVALID_FIELD", "claimed.issuing_province"),
        _error((year != "") & ~F.coalesce(year.rlike("^[0-9]+$") & F.expr("try_cast(trim(vehicle_year) as int)").between(1900, 2100), F.lit(False)), "INVALID_FIELD", "claimed.vehicle_year"),
    ]
    return form.withColumn("_e", F.coalesce(*rules)).withColumns({"error_code": F.col("_e.code"), "error_field": F.col("_e.field")}).drop("_e")


def oversize(images: DataFrame, limit: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Adds error_code IMAGE_TOO_LARGE to uploads (content) above the limit."""
    return images.withColumn("error_code", F.when(F.octet_length("content") > limit, "IMAGE_TOO_LARGE"))
