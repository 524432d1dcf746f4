"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node reachable from it.

    ``edges`` holds pairs of one orderable type; direction, repeats, self loops and nulls don't matter
    (pairs with a null are ignored, a node with only self loops is its own component and isn't returned).
    Each step is a min per node, combined before the shuffle, and a join with it; nothing but a count and a
    checksum reaches the driver. Every step's table is written to the shared folder.
    """
    spark = edges.sparkSession
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    cur = common.written(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
        .select(pair(F.col("a"), F.col("b")).alias("p")).select("p.*").distinct(), "cc")
    state = _state(cur)
    while state[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low2.select("a", F.col("m").alias("b"))).distinct()
        new = common.written(small, "cc")
        new_state = _state(new)
        done = new_state == state
        cur, state = new, new_state
        if done:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
