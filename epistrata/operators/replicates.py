"""Merging replicate reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.density import density
from ..functions.ranges import dealt


def merge(reports: list[DataFrame]) -> DataFrame:
    """Counts summed per (chr, position); strand, context and trinucleotide of the first report that has the position.

    Rows are dealt out by position first: the least of several columns is told by sorting, and else a task would sort beside what made the reports."""
    parts = [r.withColumn("_reader", F.lit(i)) for i, r in enumerate(reports)]
    d = dealt(reduce(lambda a, b: a.unionByName(b), parts), "chr", "position")
    first = F.min(F.struct("_reader", "strand", "context", "trinuc")).alias("f")
    g = d.groupBy("chr", "position").agg(first, F.sum("count_m").alias("count_m"), F.sum("count_total").alias("count_total"))
    return g.select("chr", F.col("f.strand").alias("strand"), "position", F.col("f.context").alias("context"), F.col("f.trinuc").alias("trinuc"), "count_m", "count_total",
                    density(F.col("count_m"), F.col("count_total")).alias("density"))
