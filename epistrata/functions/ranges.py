"""Order and ranks over all rows without one task that sees them all: ranges first, places within them then."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a range, and ranges at most: the driver holds their boundaries.
ROWS, MOST = 100_000, 65_536
#: Bytes of the files behind a table for each partition that it is dealt to, and partitions at most.
SHARE, PARTITIONS = 8 << 20, 20_000
#: Ranges that a group's values are cut into on the way to a quantile.
CUTS = 64


def dealt(d: DataFrame, *keys: str) -> DataFrame:
    """``d`` dealt by ``keys`` to partitions whose number follows the size of the files it is read from, so what a task sorts or holds by key doesn't
    grow with the input; left to itself, Spark joins partitions up to a size that takes many times as much in memory."""
    spark = d.sparkSession
    leaves = d._jdf.queryExecution().optimizedPlan().collectLeaves() if not d.isStreaming else None
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())] if leaves is not None else []
    n = int(sum(s for s in sizes if s < 1 << 50) // SHARE)  # what isn't read from files may have no size
    return d.repartition(min(PARTITIONS, max(spark.sparkContext.defaultParallelism, n)), *keys)


def range_of(key: Column, boundaries: list[float]) -> Column:
    """How many of the ascending ``boundaries`` are at or below ``key``: a binary search over one array literal."""
    if not boundaries:
        return F.lit(0)
    at, size = F.lit(np.array(boundaries, dtype="float64")), len(boundaries)
    halves = F.lit(np.array([1 << b for b in reversed(range(size.bit_length()))], dtype="int32"))
    return F.aggregate(halves, F.lit(0), lambda found, half: F.when((found + half <= size) & (F.get(at, found + half - 1) <= key), found + half).otherwise(found))


def numbered(d: DataFrame, key: str, ties: list[str], name: str, rows: int = ROWS) -> DataFrame:
    """``d`` with its rank from 0 by (key, ties), a number without nulls first; ``d`` is evaluated more than once."""
    n = min(MOST, -(-d.count() // rows))
    cuts = [i / n for i in range(1, n)]
    boundaries = sorted(set(d.agg(F.percentile_approx(F.col(key).cast("double"), cuts, 10 * n)).first()[0] or [])) if cuts else []
    ranged = d.withColumn("_range", range_of(F.col(key).cast("double"), boundaries))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return ranged.withColumn("_place", within).join(F.broadcast(offsets), "_range").select(*d.columns, (F.col("_before") + F.col("_place") - 1).cast("long").alias(name))


def nearest_rank(d: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name): the value at index round(q (n - 1)), halves up, of each group's n sorted values.

    Approximate quantiles cut a group into ranges; their exact counts tell which one holds the rank, and only that one is sorted."""
    cuts = d.groupBy(*keys).agg(F.count(value).alias("_n"), F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 100 * CUTS).alias("_cuts"))
    e = d.where(F.col(value).isNotNull()).join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).withColumn(
        "_rank", F.floor((F.col("_n") - 1) * q + 0.5)).drop("_cuts")
    counts = e.groupBy(*keys, "_range", "_rank").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_range"))  # CUTS rows a group at most
    holds = counts.withColumn("_to", upto).where((F.col("_to") - F.col("_k") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
    chosen = e.join(holds.select(*keys, "_range", (F.col("_rank") - F.col("_to") + F.col("_k") + 1).alias("_at")), [*keys, "_range"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return chosen.withColumn("_place", place).where(F.col("_place") == F.col("_at")).select(*keys, F.col(value).alias(name))
