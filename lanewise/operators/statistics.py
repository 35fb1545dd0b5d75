"""Evaluation statistics: error rates, thresholds, folds, exact intervals, percentiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.sources.folders import Workspace

THRESHOLDS = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
FOLDS = 10
#: The grid of thresholds of the fold accuracy: first value, step, number.
GRID = (-1.0, 0.0025, 800)
BANDS = (-1.0, 0.0, 0.25, 0.35, 0.45, 0.6, 1.01)


def error_rates(scores: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, n_same, n_different, rejected (same, below), accepted (different, at or above), in one aggregation of scores(same, score).

    All thresholds are counted beside one another, so the scores are neither multiplied nor shuffled.
    """
    counts = [F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_different")]
    for i, t in enumerate(thresholds):
        counts += [F.count_if(F.col("same") & (F.col("score") < t)).alias(f"r{i}"), F.count_if(~F.col("same") & (F.col("score") >= t)).alias(f"a{i}")]
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("rejected"), F.col(f"a{i}").alias("accepted")) for i, t in enumerate(thresholds)]
    return scores.agg(*counts).select("n_same", "n_different", F.explode(F.array(*rows)).alias("x")).select("x.threshold", "n_same", "n_different", "x.rejected", "x.accepted")


def _in_parts(rows: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """rows in range parts of (by, order), written once with the number of the part, and for each part the rows of its group before it and in all.

    Only one number a part and group meets in a task, so ranks follow without sorting a group in one place.
    """
    parts = Workspace(rows.sparkSession, "ranks").keep(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "parts")
    own = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_own"))
    group = Window.partitionBy(*by)
    sums = own.select(*by, "_part", (F.sum("_own").over(group.orderBy("_part")) - F.col("_own")).alias("_before"), F.sum("_own").over(group).alias("_all"))
    return parts, sums


def ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, _n, _from, _all: each distinct value of a group with its rows, the rows with smaller values, and all rows; nulls are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    parts, sums = _in_parts(counts, by, value)
    along = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("_upto", F.sum("_n").over(along)).join(F.broadcast(sums), [*by, "_part"]).select(*by, value, "_n", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_from"), "_all")


def _has(rank: Column) -> Column:
    """Whether the rank (from 0) is one of a ranked value's."""
    return (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n"))


def threshold_for(scores: DataFrame, rate: float) -> DataFrame:
    """threshold: the lowest one that accepts at most a share of the different pairs; no row without such pairs."""
    rows = ranked(scores.where(~F.col("same")).select("score"), [], "score")
    allowed = F.floor(F.lit(rate) * F.col("_all"))
    rank = F.greatest(F.col("_all") - 1 - allowed, F.lit(0))
    return rows.where(_has(rank)).select(F.when(allowed < F.col("_all"), F.col("score") + 1e-9).otherwise(F.col("score")).alias("threshold"))


def quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """One row with the exact linear quantile of a column, from the two values around its place."""
    place = F.lit(q) * (F.col("_all") - 1)
    at = lambda rank: F.max(F.when(_has(rank), F.col(value)))
    found = ranked(rows, [], value).agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part"))
    return found.select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))


def accepted_at_rate(scores: DataFrame, rate: float = 1e-3) -> DataFrame:
    """threshold, tar: the share of same pairs above the linear quantile of the different ones."""
    cut = quantile(scores.where(~F.col("same")), "score", 1 - rate).withColumnRenamed("quantile", "threshold")
    return scores.where("same").crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("tar"))


def in_folds(rows: DataFrame, order: str, folds: int) -> DataFrame:
    """rows with fold, from 1: contiguous folds by order, of which the first ones are one row larger."""
    parts, sums = _in_parts(rows.withColumn("_n", F.lit(1)), [], order)
    along = Window.partitionBy("_part").orderBy(order)
    placed = parts.withColumn("_i", F.row_number().over(along)).join(F.broadcast(sums), "_part")
    i, size, more = F.col("_before") + F.col("_i") - 1, F.expr(f"_all div {folds}"), F.col("_all") % folds
    large = more * (size + 1)
    fold = F.when(i < large, F.floor(i / (size + 1))).otherwise(more + F.floor((i - large) / F.greatest(size, F.lit(1))))
    return placed.select(*rows.columns, (fold + 1).cast("int").alias("fold"))


def fold_accuracy(scores: DataFrame, folds: int = FOLDS) -> DataFrame:
    """fold, threshold, accuracy of scores(pair, same, score): each fold judged at the threshold that is best for the others, the lowest one on ties.

    A pair is counted once, at the last grid point that still accepts it; running sums over the 800
    grid points of a fold then give the correct decisions at every threshold.
    """
    first, step, size = GRID
    spots = in_folds(scores.select("pair", "same", "score"), "pair", folds)
    # the last place i with first + i * step <= score, corrected for rounding at either side; -1 if there is none
    at = lambda i: F.lit(first) + i * F.lit(step)
    guess = F.floor((F.col("score") - first) / step).cast("int")
    last = F.when(at(guess + 1) <= F.col("score"), guess + 1).when(at(guess) > F.col("score"), guess - 1).otherwise(guess)
    spots = spots.withColumn("at", F.greatest(F.lit(-1), F.least(F.lit(size - 1), last)))
    held = spots.groupBy("fold", "at").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("other"))
    table = scores.sparkSession.range(size).select(F.col("id").cast("int").alias("at"))
    every = table.union(scores.sparkSession.createDataFrame([(-1,)], "at int")).crossJoin(held.select("fold").distinct())
    full = every.join(held, ["fold", "at"], "left").fillna(0, ["same", "other"])
    down = Window.partitionBy("fold").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("fold").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    right = full.withColumn("right", F.sum("same").over(down) + F.coalesce(F.sum("other").over(below), F.lit(0))).where("at >= 0")
    sizes = held.groupBy("fold").agg(F.sum(F.col("same") + F.col("other")).alias("n"))
    right = right.join(F.broadcast(sizes), "fold")
    total = Window.partitionBy("at")
    others = right.select("fold", "at", "right", "n", (F.sum("right").over(total) - F.col("right")).alias("train"))
    best = others.withColumn("place", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("train").desc(), "at"))).where("place = 1")
    return best.select(F.col("fold").cast("bigint").alias("fold"), at(F.col("at")).alias("threshold"), (F.col("right") / F.col("n")).alias("accuracy"))


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact binomial interval by halving on the tail probabilities."""
    if n <= 0:
        return 0.0, 1.0

    def tail(p: float, at_least: int) -> float:
        if p <= 0:
            return 1.0 if at_least <= 0 else 0.0
        if p >= 1:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(at_least, n + 1)]
        top = max(logs, default=-math.inf)
        return math.exp(top) * sum(math.exp(x - top) for x in logs) if logs else 0.0

    def solve(at_least: int, value: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if tail(mid, at_least) < value else (low, mid)
        return (low + high) / 2

    half = (1 - level) / 2
    return (0.0 if k == 0 else solve(k, half)), (1.0 if k == n else solve(k + 1, 1 - half))


def interval(k: Column, n: Column) -> Column:
    """struct<low, high>: the exact interval of k of n; for aggregated rows only."""

    @F.pandas_udf("struct<low: double, high: double>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([exact_interval(int(x), int(y)) for x, y in zip(a, b, strict=True)], columns=["low", "high"])

    return made(k, n)


def trials_needed(rate: Column, confidence: float = 0.95) -> Column:
    """How many trials without a failure show a rate."""
    return F.ceil(F.log(F.lit(1 - confidence)) / F.log(1 - rate))


def percent_text(k: Column, n: Column, digits: int = 2) -> Column:
    return F.when(n > 0, F.format_string(f"%.{digits}f%% (%d/%d)", 100.0 * k / n, k, n)).otherwise(F.lit("n/a"))


def interval_text(k: Column, n: Column, ends: Column) -> Column:
    """k of n as a percentage with its interval struct<low, high>."""
    return F.when(n > 0, F.format_string("%d/%d = %.2f%% (95%% CI %.2f-%.2f%%)", k, n, 100.0 * k / n, 100 * ends["low"], 100 * ends["high"])).otherwise(F.lit("0/0 (not measured)"))


def disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n_left, n_right, n_shared, n_left_only: how many keys two sets have, share, and only the left one has, in one aggregation by key."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return keys.agg(F.count_if(F.col("l") == 1).alias("n_left"), F.count_if(F.col("r") == 1).alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_shared"), F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_left_only"))


def drift(rows: DataFrame, before: str, after: str) -> DataFrame:
    """max_drift, mean_change of one score against another."""
    change = F.col(after) - F.col(before)
    return rows.agg(F.max(F.abs(change)).alias("max_drift"), F.avg(change).alias("mean_change"))


def adopted(sets: DataFrame, held: int, better: int, least: float = 0.002) -> DataFrame:
    """Whether a new model replaces the old one, from sets(part, fa_new, fa_old, acc_new, acc_old)."""
    rows = sets.agg(
        F.bool_and(F.col("fa_new") <= F.col("fa_old")).alias("no_more_false_accepts"),
        F.bool_and(F.when(F.col("part") == held, F.col("acc_new") >= F.col("acc_old") - least)).alias("no_drop"),
        F.bool_and(F.when(F.col("part") == better, F.col("acc_new") > F.col("acc_old"))).alias("better"),
    )
    return rows.withColumn("adopted", F.col("no_more_false_accepts") & F.col("no_drop") & F.col("better"))


def person_share(person: Column) -> Column:
    """A number from 0 to 0.999 that follows from the person's digest."""
    return (F.conv(F.substring(F.sha2(person.cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 1000) / 1000


def latency(rows: DataFrame, by: list[str], value: str, kind: str, q: float) -> DataFrame:
    """The value at a place of each group's sorted values; the place has three definitions: 'floor', 'trunc' and 'round' (half to even).

    Ranks come from counts of equal values in range parts, so no group is ordered in one task.
    """
    n = F.col("_all")
    place = {"floor": F.floor(F.lit(q) * (n - 1)), "trunc": F.least(n - 1, F.floor(F.lit(q) * n)), "round": F.bround(F.lit(q) * (n - 1))}[kind]
    return ranked(rows, by, value).where(_has(place.cast("bigint"))).select(*by, F.col(value).alias("latency"))
