"""Normalising and matching of names, numbers, plates and paths, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.operators.dimensions import PROVINCE_ALIASES, PROVINCES

#: Pairs of signs that a plate reader mixes up.
CONFUSED = ("O0", "0O", "I1", "1I", "B8", "8B")
NAME_PASS = 90.0


def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character and combining marks, with that character."""
    pairs = []
    for point in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain != chr(point):
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD = _fold_table()


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: Spark has no let, but a lambda's variable is one."""
    return F.get(F.transform(F.array(value), use), 0)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normal_province(c: Column) -> Column:
    """The two-letter code, or null if there is none such."""
    code = F.upper(F.trim(c))
    for old, new in PROVINCE_ALIASES.items():
        code = F.when(code == old, new).otherwise(code)
    return F.when(code.isin(PROVINCES), code)


def normal_class(c: Column) -> Column:
    return F.regexp_replace(F.upper(blank(c)), "[^A-Z0-9]", "")


def normal_licence(c: Column) -> Column:
    return F.regexp_replace(F.upper(blank(c)), "[^A-Z0-9*]", "")


normal_plate = normal_class


def normal_name(c: Column) -> Column:
    """Unaccented capitals and digits in words with one blank between them; combining marks are dropped."""
    folded = F.translate(F.regexp_replace(blank(c), r"\p{M}", ""), *_FOLD)
    return F.trim(F.regexp_replace(F.upper(folded), "[^A-Z0-9]+", " "))


def _chars(c: Column) -> Column:
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""

    def table(x: Column) -> Column:
        left, right, steps = x["left"], x["right"], x["steps"]

        def row(above: Column, c: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                here = F.when(F.get(right, j - 1) == c, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(done, j - 1)))
                return F.concat(done, F.array(here))

            return F.aggregate(steps, F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(left, F.array_repeat(F.lit(0), F.size(right) + 1), row), -1)

    steps = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))
    return bind(F.struct(_chars(a).alias("left"), _chars(b).alias("right"), steps.alias("steps")), table)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 times the indel similarity of the two texts with their words sorted; only differing texts run the table."""
    a, b = (F.array_join(F.array_sort(F.split(x, " ")), " ") for x in (a, b))

    def ratio(x: Column) -> Column:
        total = F.length(x["a"]) + F.length(x["b"])
        return F.when(total == 0, 0.0).when(x["a"] == x["b"], 100.0).otherwise(F.lit(200.0).cast("double") * common_length(x["a"], x["b"]) / total)

    return bind(F.struct(a.alias("a"), b.alias("b")), ratio)


def match_names(claimed: Column, document: Column, threshold: float = NAME_PASS) -> Column:
    """struct<passed, score>: similar enough, or all of at least two words of the shorter name in the longer.

    The normalised names and the score are bound to lambda variables, so each is computed once.
    """
    kind = "struct<passed: boolean, score: double>"
    made = lambda p, s: F.struct(F.lit(p).alias("passed"), s.cast("double").alias("score")).cast(kind)

    def judged(x: Column) -> Column:
        ta, tb = F.array_distinct(F.split(x["a"], " ")), F.array_distinct(F.split(x["b"], " "))
        swap = F.size(ta) > F.size(tb)
        small, large = F.when(swap, tb).otherwise(ta), F.when(swap, ta).otherwise(tb)
        inside = (F.size(small) >= 2) & (F.size(F.array_except(small, large)) == 0)
        return F.when(x["score"] >= threshold, made(True, x["score"])).when(inside, made(True, F.lit(100.0))).otherwise(made(False, x["score"]))

    def scored(x: Column) -> Column:
        none = (F.length(x["a"]) == 0) | (F.length(x["b"]) == 0)
        with_score = F.struct(x["a"].alias("a"), x["b"].alias("b"), token_sort_ratio(x["a"], x["b"]).alias("score"))
        return F.when(none, made(False, F.lit(0.0))).otherwise(bind(with_score, judged))

    return bind(F.struct(normal_name(claimed).alias("a"), normal_name(document).alias("b")), scored)


def match_plates(read: Column, claimed: Column) -> Column:
    """Equal, or of one length with one difference that is a confused pair; an empty side never matches."""
    a, b = normal_plate(read), normal_plate(claimed)
    pairs = F.filter(F.zip_with(_chars(a), _chars(b), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    near = (F.length(a) == F.length(b)) & (F.size(pairs) == 1) & F.coalesce(F.get(pairs, 0).isin(*CONFUSED), F.lit(False))
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | near)


def safe_folder(c: Column) -> Column:
    """A name without separators, dots in a row or odd signs, of at most 64 characters; 'unknown' if nothing is left."""
    clean = F.regexp_replace(F.trim(blank(c)), r"[/\\]+", "_")
    clean = F.regexp_replace(clean, r"\.{2,}", "_")
    clean = F.regexp_replace(clean, r"[^a-zA-Z0-9_\-.]", "_")
    clean = F.regexp_replace(clean, r"^[._]+|[._]+$", "")
    return F.when(clean == "", "unknown").otherwise(F.substring(clean, 1, 64))


def valid_key(c: Column) -> Column:
    """Whether every segment of a storage key is safe as it stands and none is reserved."""
    return F.coalesce(F.forall(F.split(c, "/"), lambda s: (s != "") & (s == safe_folder(s)) & ~F.lower(s).endswith(".tmp")), F.lit(False))


def session_prefix(driver_id: Column, request_id: Column) -> Column:
    return F.concat_ws("/", F.lit("sessions"), safe_folder(driver_id), safe_folder(request_id))


def colour_tokens(c: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(blank(c)), "-/", "  "), r"\s+"), lambda w: w != "")


def sniffed_type(content: Column) -> Column:
    """The kind of picture by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise("bin")
