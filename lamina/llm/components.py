"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation that sums up on the map side and a join with its result, in which nodes of very many
neighbours are broadcast; no step gathers a node's neighbours, so a node may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet_counted


def _star(edges: DataFrame, count: int, both: bool, scratch: Scratch) -> DataFrame:
    """edges (u, v), u > v, of them count. Links each node's (both: larger; else: smaller) neighbours and itself to the least of all."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = scratch.keep(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    joined = meet_counted(sides, least, ["u"], 2 * count if both else count)
    if both:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.keep(out.where("u <> v").distinct())
    scratch.drop(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: each node that has an edge (a, b of an ordered type) with the least node it is connected to."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e)
    state = _state(e)
    while state[0]:
        large = _star(e, state[0], True, scratch)
        small = _star(large, state[0], False, scratch)
        scratch.drop(e, large)
        e, was, state = small, state, _state(small)
        if state == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
