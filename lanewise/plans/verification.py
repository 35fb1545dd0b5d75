"""Queries over claims and licence cards, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import barcode, dates, text
from lanewise.operators import dimensions, gates
from lanewise.sources import fixtures

_F = "WITH RECURSIVE " + fixtures.sql_steps("orders", fixtures.CARD)


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts in DuckDB."""
    codes = lambda x: f"list_transform(string_split({x}, ''), lambda ch: [unicode(ch)])"
    steps = f"list_transform(range(1, length({b}) + 1), lambda n: [n::INT])"
    cell = f"list_append(q, CASE WHEN ({codes(b)})[j[1]][1] = x[1] THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], q[j[1]]) END)"
    row = f"list_reduce({steps}, lambda q, j: {cell}, [0])"
    return f"list_reduce({codes(a)}, lambda p, x: {row}, list_resize([0], length({b}) + 1, 0))[-1]"


def name_sql(c: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(replace(coalesce({c}, ''), 'ß', 'SS'))), '[^A-Z0-9]+', ' ', 'g'))"


def sorted_sql(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _names_sql(claimed: str, document: str) -> str:
    """Steps that end in passed and score, from the CTE f."""
    return f"""n0 AS (SELECT *, {name_sql(claimed)} AS na, {name_sql(document)} AS nb FROM f),
    n1 AS (SELECT *, {sorted_sql('na')} AS sa, {sorted_sql('nb')} AS sb, list_distinct(string_split(na, ' ')) AS ta, list_distinct(string_split(nb, ' ')) AS tb FROM n0),
    d1 AS (SELECT DISTINCT sa, sb FROM n1 WHERE sa <> sb AND sa <> '' AND sb <> ''),
    d2 AS (SELECT sa, sb, 200.0::DOUBLE * {lcs_sql('sa', 'sb')} / (length(sa) + length(sb)) AS ratio FROM d1),
    n2 AS (SELECT n1.*, CASE WHEN n1.sa = n1.sb THEN 100.0::DOUBLE ELSE d2.ratio END AS ratio FROM n1 LEFT JOIN d2 ON n1.sa = d2.sa AND n1.sb = d2.sb),
    n3 AS (SELECT *, CASE WHEN na = '' OR nb = '' THEN false WHEN ratio >= 90 THEN true ELSE least(len(ta), len(tb)) >= 2 AND
        CASE WHEN len(ta) <= len(tb) THEN len(list_filter(ta, lambda t: NOT list_contains(tb, t))) ELSE len(list_filter(tb, lambda t: NOT list_contains(ta, t))) END = 0 END AS name_passed FROM n2),
    n AS (SELECT *, CASE WHEN na = '' OR nb = '' THEN 0.0::DOUBLE WHEN ratio >= 90 THEN ratio WHEN name_passed THEN 100.0::DOUBLE ELSE ratio END AS name_score FROM n3)"""


_DOC_NAME = "concat_ws(' ', \"first\", CASE WHEN middle = 'NONE' THEN NULL ELSE middle END, \"last\")"
_NUMBER = lambda c: f"regexp_replace(upper({c}), '[^A-Z0-9*]', '', 'g')"
_PATTERN = "CASE province " + " ".join(f"WHEN '{p}' THEN '{x}'" for p, _, x, _ in dimensions.JURISDICTIONS) + " END"
# at 03:30 UTC it is already the 15th in Newfoundland and the Atlantic provinces
_GATES = (
    _F + ", " + _names_sql("claim_name", _DOC_NAME) + f""",
    g0 AS (SELECT *, m NOT IN (11, 12) AS parsed, CASE WHEN upper(trim(claim_province)) = 'ZZ' THEN NULL ELSE upper(trim(claim_province)) END AS cp,
        CASE WHEN m = 10 THEN NULL ELSE province END AS of_, CASE WHEN province IN ('NL', 'NS', 'NB', 'PE') THEN DATE '2024-06-15' ELSE DATE '2024-06-14' END AS today,
        trim(upper(claim_class)) AS cc FROM n),
    g1 AS (SELECT *, date_diff('year', dob::DATE, today) - CASE WHEN strftime(today, '%m%d') < strftime(dob::DATE, '%m%d') THEN 1 ELSE 0 END AS age,
        coalesce(of_ = cp, false) AS p1, daq <> '' AND daq = {_NUMBER('claim_number')} AS p2, name_passed AS p3, dob = claim_dob AS p4, licence_class = cc AS p5,
        issue = claim_issue AS p6, expiry = claim_expiry AS p7 FROM g0),
    g AS (SELECT *, CASE WHEN m = 12 THEN ['BARCODE_UNREADABLE'] WHEN m = 11 THEN ['BARCODE_NOT_AAMVA'] WHEN of_ IS NULL THEN ['JURISDICTION_MISMATCH'] ELSE list_filter([
        CASE WHEN NOT p1 THEN 'JURISDICTION_MISMATCH' END, CASE WHEN NOT p2 THEN 'LICENCE_NUMBER_MISMATCH' END, CASE WHEN NOT p3 THEN 'NAME_MISMATCH' END,
        CASE WHEN NOT p4 THEN 'DOB_MISMATCH' END, CASE WHEN NOT p5 THEN 'CLASS_MISMATCH' END, CASE WHEN NOT p6 THEN 'ISSUE_DATE_MISMATCH' END,
        CASE WHEN NOT p7 THEN 'EXPIRY_DATE_MISMATCH' END, CASE WHEN today > expiry::DATE THEN 'LICENCE_EXPIRED' END,
        CASE WHEN issue::DATE > today THEN 'LICENCE_NOT_YET_VALID' END, CASE WHEN age < 18 THEN 'UNDERAGE' END], lambda r: r IS NOT NULL) END AS barcode_reasons,
        CASE WHEN parsed AND of_ IS NOT NULL AND daq <> '' AND NOT regexp_matches(daq, {_PATTERN}) THEN ['LICENCE_FORMAT_UNUSUAL'] ELSE [] END AS barcode_advisories FROM g1)"""
)
_FAMILY = {c: (["Light Blue"] if "light" in w and "blue" in w else sorted({x for t in w for x in dimensions.COLOUR_WORDS.get(t, [])})) for c in ["Grey", "light blue", "Navy-Blue", "red/maroon", "teal", "Gold", "white", "charcoal"] for w in [c.lower().replace("-", " ").replace("/", " ").split()]}
_FAMILY_SQL = "CASE vehicle_colour " + " ".join(f"WHEN '{c}' THEN {names!r}" for c, names in _FAMILY.items() if names) + " END"
_PLATES = """(plate_read <> '' AND (upper(replace(plate_read, ' ', '')) = plate_number OR (length(plate_read) = length(plate_number) AND
    len(list_filter(range(1, length(plate_number) + 1), lambda i: substr(plate_read, i, 1) <> substr(plate_number, i, 1))) = 1 AND
    len(list_filter(range(1, length(plate_number) + 1), lambda i: concat(substr(plate_read, i, 1), substr(plate_number, i, 1)) IN ('O0', '0O', 'I1', '1I', 'B8', '8B'))) = 1)))"""
_STAGES = (
    _GATES + f""",
    s0 AS (SELECT *, len(barcode_reasons) = 0 AS ran, CASE WHEN n_selfie = 0 THEN 'FACE_NOT_FOUND_SELFIE' WHEN n_selfie = 2 AND second_score >= 0.9 AND second_side * second_side >= 2500 THEN 'IMAGE_QUALITY' END AS sr FROM g),
    s1 AS (SELECT *, list_filter([sr, CASE WHEN sr IS NULL AND liveness < 0.5 THEN 'LIVENESS_FAILED' END, CASE WHEN n_licence = 0 THEN 'FACE_NOT_FOUND_LICENCE' END], lambda r: r IS NOT NULL) AS f1,
        CASE WHEN NOT plate_found THEN 'PLATE_NOT_FOUND' WHEN plate_read = '' OR plate_confidence < 0.6 THEN 'PLATE_UNREADABLE' WHEN NOT {_PLATES} THEN 'PLATE_MISMATCH' END AS vr,
        {_FAMILY_SQL} AS family FROM s0),
    s2 AS (SELECT *, CASE WHEN len(f1) > 0 THEN f1 WHEN similarity < 0.35 THEN ['FACE_MISMATCH'] ELSE [] END AS fr,
        CASE WHEN plate_found THEN CASE WHEN colour IS NULL OR family IS NULL THEN 'COLOUR_UNVERIFIED' WHEN NOT list_contains(family, colour) THEN 'COLOUR_MISMATCH' END END AS va FROM s1),
    s AS (SELECT *, CASE WHEN ran THEN list_concat(barcode_reasons, fr, CASE WHEN vr IS NULL THEN [] ELSE [vr] END) ELSE barcode_reasons END AS reasons,
        CASE WHEN ran AND va IS NOT NULL THEN list_append(barcode_advisories, va) ELSE barcode_advisories END AS advisories FROM s2)"""
)


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    return gates.with_gates(gates.with_record(fixtures.claims(spark, folder)), fixtures.now())


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    return gates.with_decision(gates.with_vehicle(gates.with_face(_gated(spark, folder))))


def gates_decision_by_province(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decided(spark, folder)
    return rows.groupBy(F.coalesce("province", F.lit("??")).alias("province"), "decision").agg(F.count("*").alias("n"), F.sum(F.size("reasons")).cast("bigint").alias("n_reasons"))


def gates_reason_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = gates.explained(_decided(spark, folder))
    return rows.groupBy("code", "retryable", "message").agg(F.count("*").alias("n"))


def gates_check_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder).select("request_id", F.inline(F.transform("checks", lambda x, i: F.struct(i.cast("bigint").alias("ord"), *(x[c].alias(c) for c in ("field", "claimed", "decoded", "score", "threshold", "passed"))))))


def gates_advisories(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decided(spark, folder).select(F.explode("advisories").alias("advisory"))
    return rows.groupBy("advisory").agg(F.count("*").alias("n"))


def stage_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decided(spark, folder)
    return rows.select("request_id", "stages_ran", F.array_join("reasons", ",").alias("reasons"), F.array_join("advisories", ",").alias("advisories"), "decision")


def aamva_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = gates.with_record(fixtures.claims(spark, folder))
    f = F.col("record.fields")
    return rows.select(
        "request_id", "record.iin", "record.version", F.size(F.map_keys(f)).cast("bigint").alias("n_fields"), F.try_element_at(f, F.lit("DAQ")).alias("daq"),
        F.when(f.isNotNull(), barcode.full_name(f)).alias("full_name"), barcode.element_date(f, "DBB").alias("dob"), barcode.element_date(f, "DBD").alias("issued"),
        barcode.element_date(f, "DBA").alias("expiry"), F.try_element_at(f, F.lit("DCB")).alias("dcb"),
    )


def name_match_scores(spark: SparkSession, folder: str) -> DataFrame:
    c = fixtures.cards(spark, folder).select("request_id", "claim_name", F.concat_ws(" ", "first", F.when(F.col("middle") != "NONE", F.col("middle")), "last").alias("doc"))
    return c.select("request_id", text.match_names(F.col("claim_name"), F.col("doc")).alias("x")).select("request_id", "x.passed", F.round("x.score", 6).alias("score"))


def normalise_names(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.read(spark, folder, "documents").select("doc_id", text.normal_name(F.col("text")).alias("name"))


def plate_match(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.cards(spark, folder).select("request_id", text.match_plates(F.col("plate_read"), F.col("plate_number")).alias("matched"))


def plate_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different plates that would pass for one another.

    Instead of crossing all plates, each one offers itself with every confused sign set to one form:
    plates that match share that key, and few others do.
    """
    plates = fixtures.cards(spark, folder).select(text.normal_plate(F.col("plate_number")).alias("plate")).distinct()
    keyed = plates.withColumn("key", F.translate("plate", "OIB", "018"))
    other = keyed.select(F.col("plate").alias("other"), "key")
    pairs = keyed.join(other, "key").where((F.col("plate") < F.col("other")) & text.match_plates(F.col("plate"), F.col("other")))
    return pairs.select("plate", "other")


def province_format_advisory(spark: SparkSession, folder: str) -> DataFrame:
    c = fixtures.cards(spark, folder).select("province", text.normal_licence(F.col("daq")).alias("daq"))
    table = F.broadcast(dimensions.jurisdictions(spark).select("province", "licence_pattern"))
    rows = c.join(table, "province").withColumn("unusual", (F.col("daq") != "") & ~F.rlike("daq", F.col("licence_pattern")))
    return rows.groupBy("province").agg(F.count("*").alias("n"), F.count_if("unusual").alias("n_unusual"))


def date_order_parse(spark: SparkSession, folder: str) -> DataFrame:
    c = fixtures.cards(spark, folder)
    raw = F.when(F.col("k") % 7 == 0, "20090229").when(F.col("k") % 7 == 1, "19901301").when(F.col("k") % 7 == 2, F.concat(F.substring("dob", 6, 2), F.substring("dob", 9, 2), F.substring("dob", 1, 4))).when(F.col("k") % 7 == 3, "1990").otherwise(F.translate("dob", "-", ""))
    country = F.when(F.col("k") % 5 == 0, "CAN").when(F.col("k") % 5 == 1, "USA")
    rows = c.select("request_id", raw.alias("raw"), dates.date_order(country, raw).alias("ord"))
    return rows.select("request_id", "ord", dates.card_date(F.col("raw"), F.col("ord")).alias("day"))


def age_on(spark: SparkSession, folder: str) -> DataFrame:
    o = fixtures.read(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    born = F.make_date(F.lit(1960) + (F.col("o_orderkey") % 40).cast("int"), F.lit(1) + (F.col("o_orderkey") % 12).cast("int"), F.lit(1) + (F.col("o_orderkey") % 28).cast("int"))
    return o.select("o_orderkey", dates.age_on(F.when(F.col("o_orderkey") % 13 == 0, F.lit("1980-02-29").cast("date")).otherwise(born), F.col("d")).cast("bigint").alias("age"))


def local_today(spark: SparkSession, folder: str) -> DataFrame:
    c = fixtures.cards(spark, folder).select("province")
    table = F.broadcast(dimensions.jurisdictions(spark).select("province", "tz"))
    return c.join(table, "province").groupBy("province", dates.local_day(fixtures.now(), F.col("tz")).alias("today")).agg(F.count("*").alias("n"))


def validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    from lanewise.operators.requests import validated

    form = fixtures.derived(fixtures.cards(spark, folder), FORM)
    return validated(form).select("request_id", "error_code", "error_field")


#: A form for each request, in which the case v spoils one field.
FORM = [
    [("v", "k % 16")],
    [
        ("form_request_id", "CASE WHEN v = 1 THEN '' WHEN v = 2 THEN 'r 1/x' ELSE request_id END"),
        ("form_driver_id", "CASE WHEN v = 3 THEN ' ' ELSE driver_id END"),
        ("consent_at", "CASE WHEN v = 4 THEN NULL WHEN v = 5 THEN '2026-11-11T12:00:00' WHEN v = 6 THEN 'yesterday' ELSE '2026-11-11T12:00:00Z' END"),
        ("consent_policy_version", "CASE WHEN v = 7 THEN '' ELSE 'v1' END"),
        ("form_name", "CASE WHEN v = 8 THEN ' ' WHEN v = 9 THEN repeat('x', 201) ELSE claim_name END"),
        ("form_dob", "CASE WHEN v = 10 THEN '15/03/1990' WHEN v = 11 THEN '' ELSE claim_dob END"),
        ("form_province", "CASE WHEN v = 12 THEN 'XX' WHEN claim_province = 'ZZ' THEN 'NF' ELSE claim_province END"),
        ("vehicle_year", "CASE WHEN v = 13 THEN 'abc' WHEN v = 14 THEN '1899' WHEN v = 15 THEN '2020' ELSE NULL END"),
    ],
]


def impostor_first_other(spark: SparkSession, folder: str) -> DataFrame:
    """For each request the first other request of its province with a different name, without pairing requests.

    The first request of a province is everyone's impostor unless it has the same name; then the first
    one with another name is. Both follow from the first request of each (province, name).
    """
    c = fixtures.cards(spark, folder).select("k", "province", F.upper("claim_name").alias("name"))
    firsts = c.groupBy("province", "name").agg(F.min("k").alias("first"))
    best = firsts.groupBy("province").agg(F.min(F.struct("first", "name")).alias("one"))
    second = firsts.join(F.broadcast(best), "province").where(F.col("name") != F.col("one.name")).groupBy("province").agg(F.min("first").alias("two"))
    table = best.join(second, "province", "left")
    picked = F.when(F.col("name") != F.col("one.name"), F.col("one.first")).otherwise(F.col("two"))
    return c.join(F.broadcast(table), "province").select("k", picked.alias("impostor"))


def report_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decided(spark, folder).select("issuing_province", F.coalesce("province", F.lit("??")).alias("region"), "vehicle_colour", (F.col("decision") == "APPROVED").alias("ok"))
    rows = rows.groupingSets([["region"], ["vehicle_colour"], []], "region", "vehicle_colour")
    return rows.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def colour_family(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.cards(spark, folder).select("request_id", F.array_join(F.sort_array(gates.colour_family(F.col("vehicle_colour"))), ";").alias("family"))


def session_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    p = fixtures.read(spark, folder, "pages")
    return p.select("page_id", text.safe_folder(F.col("url")).alias("folder"), text.valid_key(F.expr("substring(url, 9)")).alias("valid"))


_SAFE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '[/\\]+', '_', 'g'), '\.{{2,}}', '_', 'g'), '[^a-zA-Z0-9_.\-]', '_', 'g'), '^[._]+|[._]+$', '', 'g')"""
_PARSED = "CASE WHEN m IN (11, 12) THEN NULL ELSE {} END"

ORACLES = {
    "gates_decision_by_province": _STAGES + " SELECT coalesce(CASE WHEN m IN (11, 12) THEN cp ELSE of_ END, '??') AS province, CASE WHEN len(reasons) = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision, count(*) AS n, sum(len(reasons))::BIGINT AS n_reasons FROM s GROUP BY 1, 2",
    "gates_reason_counts": _STAGES + ", x AS (SELECT unnest(reasons) AS code FROM s), codes(code, retryable, message) AS (VALUES " + ", ".join("('{}', {}, '{}')".format(c, str(r).lower(), t) for c, r, t in dimensions.REASON_CODES) + ") SELECT code, retryable, message, count(*) AS n FROM x JOIN codes USING (code) GROUP BY ALL",
    "gates_check_rows": _GATES + f""", c AS (SELECT request_id, unnest(CASE WHEN of_ IS NULL THEN [1] ELSE [1, 2, 3, 4, 5, 6, 7] END) AS i, * EXCLUDE (request_id) FROM g WHERE parsed),
        r AS (SELECT request_id, (i - 1)::BIGINT AS ord, ['issuing_province', 'licence_number', 'full_name', 'date_of_birth', 'licence_class', 'issue_date', 'expiry_date'][i] AS field,
        [cp, claim_number, claim_name, claim_dob, claim_class, claim_issue, claim_expiry][i] AS claimed,
        [of_, nullif(daq, ''), {_DOC_NAME}, dob, licence_class, issue, expiry][i] AS decoded, [p1, p2, p3, p4, p5, p6, p7][i] AS passed, name_score FROM c)
        SELECT request_id, ord, field, claimed, decoded, CASE WHEN field = 'full_name' THEN round(name_score, 1) WHEN passed THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
        CASE WHEN field = 'full_name' THEN 90.0::DOUBLE ELSE 100.0::DOUBLE END AS threshold, passed FROM r""",
    "gates_advisories": _STAGES + ", x AS (SELECT unnest(advisories) AS advisory FROM s) SELECT advisory, count(*) AS n FROM x GROUP BY 1",
    "stage_decisions": _STAGES + " SELECT request_id, ran AS stages_ran, array_to_string(reasons, ',') AS reasons, array_to_string(advisories, ',') AS advisories, CASE WHEN len(reasons) = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision FROM s",
    "aamva_parse": _F + " SELECT request_id, " + ", ".join(f"{_PARSED.format(x)} AS {n}" for n, x in [("iin", "issuer"), ("version", "version"), ("n_fields", "12::BIGINT"), ("daq", "daq"), ("full_name", _DOC_NAME), ("dob", "dob::DATE"), ("issued", "issue::DATE"), ("expiry", "expiry::DATE"), ("dcb", "''")]) + " FROM f",
    "name_match_scores": _F + ", " + _names_sql("claim_name", _DOC_NAME) + " SELECT request_id, name_passed AS passed, round(name_score, 6) AS score FROM n",
    "normalise_names": f"SELECT doc_id, {name_sql('text')} AS name FROM documents",
    "plate_match": _F + f" SELECT request_id, {_PLATES} AS matched FROM f",
    "plate_collisions": _F + """, p AS (SELECT DISTINCT plate_number AS plate FROM f), t AS (SELECT plate, translate(plate, 'OIB', '018') AS key FROM p)
        SELECT a.plate, b.plate AS other FROM t a JOIN t b ON a.plate < b.plate AND a.key = b.key AND
        len(list_filter(range(1, 7), lambda i: substr(a.plate, i, 1) <> substr(b.plate, i, 1))) = 1""",
    "province_format_advisory": _F + f" SELECT province, count(*) AS n, count(*) FILTER (WHERE daq <> '' AND NOT regexp_matches(daq, {_PATTERN})) AS n_unusual FROM f GROUP BY 1",
    "date_order_parse": _F + """, r AS (SELECT request_id, k, CASE k % 7 WHEN 0 THEN '20090229' WHEN 1 THEN '19901301' WHEN 2 THEN concat(substr(dob, 6, 2), substr(dob, 9, 2), substr(dob, 1, 4)) WHEN 3 THEN '1990' ELSE replace(dob, '-', '') END AS raw FROM f),
        o AS (SELECT *, length(raw) = 8 AND try_cast(substr(raw, 1, 4) AS INT) BETWEEN 1900 AND 2099 AS h, length(raw) = 8 AND try_cast(substr(raw, 5, 4) AS INT) BETWEEN 1900 AND 2099 AS t FROM r),
        q AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'CCYYMMDD' WHEN k % 5 = 1 THEN 'MMDDCCYY' WHEN h AND NOT t THEN 'CCYYMMDD' WHEN t AND NOT h THEN 'MMDDCCYY' END AS ord FROM o)
        SELECT request_id, ord, CASE WHEN length(raw) = 8 THEN CASE ord WHEN 'CCYYMMDD' THEN try_strptime(raw, '%Y%m%d')::DATE WHEN 'MMDDCCYY' THEN try_strptime(raw, '%m%d%Y')::DATE END END AS day FROM q""",
    "age_on": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 13 = 0 THEN DATE '1980-02-29' ELSE make_date(1960 + o_orderkey % 40, 1 + o_orderkey % 12, 1 + o_orderkey % 28) END AS b FROM orders)
        SELECT o_orderkey, (year(d) - year(b) - CASE WHEN strftime(d, '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END)::BIGINT AS age FROM o""",
    "local_today": _F + " SELECT province, CASE WHEN province IN ('NL', 'NS', 'NB', 'PE') THEN DATE '2024-06-15' ELSE DATE '2024-06-14' END AS today, count(*) AS n FROM f GROUP BY 1, 2",
    "validate_requests": "WITH " + fixtures.sql_steps("orders", fixtures.CARD + FORM) + """ SELECT request_id,
        CASE v WHEN 1 THEN 'MISSING_FIELD' WHEN 2 THEN 'INVALID_FIELD' WHEN 3 THEN 'MISSING_FIELD' WHEN 4 THEN 'CONSENT_REQUIRED' WHEN 5 THEN 'INVALID_FIELD' WHEN 6 THEN 'INVALID_FIELD' WHEN 7 THEN 'CONSENT_REQUIRED'
            WHEN 8 THEN 'MISSING_FIELD' WHEN 9 THEN 'INVALID_FIELD' ELSE CASE WHEN claim_number = '' THEN 'MISSING_FIELD' WHEN v = 10 THEN 'INVALID_FIELD' WHEN v = 11 THEN 'MISSING_FIELD' WHEN v IN (12, 13, 14) THEN 'INVALID_FIELD' END END AS error_code,
        CASE v WHEN 1 THEN 'request_id' WHEN 2 THEN 'request_id' WHEN 3 THEN 'driver_id' WHEN 4 THEN 'consent_at' WHEN 5 THEN 'consent_at' WHEN 6 THEN 'consent_at' WHEN 7 THEN 'consent_at'
            WHEN 8 THEN 'claimed.full_name' WHEN 9 THEN 'claimed.full_name' ELSE CASE WHEN claim_number = '' THEN 'claimed.licence_number' WHEN v IN (10, 11) THEN 'claimed.date_of_birth' WHEN v = 12 THEN 'claimed.issuing_province' WHEN v IN (13, 14) THEN 'claimed.vehicle_year' END END AS error_field FROM f""",
    "impostor_first_other": _F + ", c AS (SELECT k, province, upper(claim_name) AS name FROM f), d AS (SELECT province, name, min(k) AS first FROM c GROUP BY ALL), e AS (SELECT a.province, a.name, min(b.first) AS impostor FROM d a LEFT JOIN d b ON a.province = b.province AND a.name <> b.name GROUP BY ALL) SELECT c.k, e.impostor FROM c JOIN e USING (province, name)",
    "report_grouping_sets": _STAGES + ", t AS (SELECT coalesce(CASE WHEN m IN (11, 12) THEN cp ELSE of_ END, '??') AS region, vehicle_colour, len(reasons) = 0 AS ok FROM s) SELECT region, vehicle_colour, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM t GROUP BY GROUPING SETS ((region), (vehicle_colour), ())",
    "colour_family": _F + f" SELECT request_id, array_to_string(list_sort({_FAMILY_SQL}), ';') AS family FROM f",
    "session_prefixes": "WITH p AS (SELECT page_id, " + _SAFE.format("url") + " AS u, substr(url, 9, 200) AS key FROM pages) SELECT page_id, CASE WHEN u = '' THEN 'unknown' ELSE substr(u, 1, 64) END AS folder, len(list_filter(string_split(key, '/'), lambda g: g = '' OR lower(g) LIKE '%.tmp' OR g <> substr(CASE WHEN " + _SAFE.format("g") + " = '' THEN 'unknown' ELSE " + _SAFE.format("g") + " END, 1, 64))) = 0 AS valid FROM p",
}
QUERIES = {name: globals()[name] for name in ORACLES}
