"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, attach


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"] or 0


def _to_least(work: Workspace, edges: DataFrame, count: int, name: str) -> DataFrame:
    """The small star: the smaller neighbours of a node, and the node, are joined to the smallest of them."""
    least = work.keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-least", count)
    small = attach(edges, least, ["u"], count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    done = work.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name, 2 * count)
    work.drop(f"{name}-least")
    return done


def connected_components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root) for every id of edges(a, b); root is the smallest id that links reach.

    The small star comes first, as it turns the many edges of a large group into about one for each
    node. Then each step takes the large star (the larger neighbours of a node are joined to the
    smallest one of all) and the small star; steps repeat until the edge
    set stays the same, which takes about log(n) of them. A node with very many neighbours (a hub) is
    joined by broadcast of the few hot keys, so no task holds a hub's edges. Loops are ignored and no
    edges give an empty table.
    """
    made = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first = work.keep(made, f"{name}-made")
    now = _to_least(work, first, _state(first)[0], f"{name}-0")
    work.drop(f"{name}-made")
    state, step = _state(now), 0
    while state[0]:
        step += 1
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = work.keep(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")), f"{name}-low", 2 * state[0])
        low = low.withColumn("m", F.least("x", "m"))
        large = work.keep(attach(both, low, ["x"], 2 * state[0]).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large", 2 * state[0])
        then = _to_least(work, large, _state(large)[0], f"{name}-{step}")
        for old in (f"{name}-low", f"{name}-large", f"{name}-{step - 1}"):
            work.drop(old)
        before, state, now = state, _state(then), then
        if state == before:
            break
    tops = now.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(tops)
