"""Binomial tests of cytosines and regions, and region categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.density import binom_sf, covered, strand_fits
from .joins import asof_backward

CONTEXTS = ["CG", "CHG", "CHH"]
OPERATORS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def total_stats(cytosines: DataFrame) -> DataFrame:
    """Sites and their mean density p, all contexts together, every site alike."""
    return cytosines.where(covered(F.col("density"))).agg(F.count("*").alias("n_sites"), F.avg("density").alias("p"))


def context_stats(cytosines: DataFrame) -> DataFrame:
    return cytosines.groupBy("context").agg(F.sum("count_m").alias("m"), F.sum("count_total").alias("total"), (F.sum("count_m") / F.nullif(F.sum("count_total"), F.lit(0))).alias("p"))


def site_pvalues(cytosines: DataFrame, min_coverage: int = 2) -> DataFrame:
    """P(X >= m) of each site covered enough, with p from all sites."""
    d = cytosines.where(F.col("count_total") >= min_coverage).crossJoin(F.broadcast(total_stats(cytosines)))  # one row
    p = binom_sf(F.col("count_m"), F.col("count_total"), F.col("p"))
    return d.select("chr", "strand", "position", "context", p.alias("p_value"))


def region_counts(cytosines: DataFrame, regions: DataFrame) -> DataFrame:
    """Counts per region and context: cytosines from the region's start to its downstream end."""
    hit = asof_backward(cytosines, regions, key="start").where(strand_fits(F.col("r_strand"), F.col("strand")))
    keys = [F.col(f"r_{c}").alias(c) for c in ("chr", "strand", "start", "end", "id")]
    return hit.groupBy(*keys, "context").agg(F.sum("count_m").alias("count_m"), F.sum("count_total").alias("count_total"))


def without_duplicates(d: DataFrame) -> DataFrame:
    """Drops all copies of a repeated (chr, strand, start, end, context)."""
    w = Window.partitionBy("chr", "strand", "start", "end", "context")
    return d.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def region_pvalues(cytosines: DataFrame, regions: DataFrame) -> DataFrame:
    """Region counts with P(X >= m) by the context's own p."""
    p = F.broadcast(context_stats(cytosines).select("context", "p"))  # a row per context
    return region_counts(cytosines, regions).join(p, "context").select(
        "chr", "strand", "start", "end", "id", "context", "count_m", "count_total", binom_sf(F.col("count_m"), F.col("count_total"), F.col("p")).alias("p_value"))


def wide(p: DataFrame) -> DataFrame:
    """A row per region; p_value, count_m and count_total in a column per context."""
    return without_duplicates(p).groupBy("chr", "strand", "start", "end", "id").pivot("context", CONTEXTS).agg(
        F.first("p_value").alias("p_value"), F.first("count_m").alias("count_m"), F.first("count_total").alias("count_total")).select(
        "chr", "strand", "start", "end", "id", *[F.col(f"{c}_{m}").alias(f"{m}_context_{c}") for m in ("p_value", "count_m", "count_total") for c in CONTEXTS])


def region_filter(w: DataFrame, context: str, op: str, p_value: float, min_n: int = 0) -> DataFrame:
    if op not in OPERATORS or context not in CONTEXTS:
        raise ValueError("op is one of < <= > >=, context one of CG CHG CHH")
    return w.where(OPERATORS[op](F.col(f"p_value_context_{context}"), p_value) & (F.col(f"count_total_context_{context}") >= min_n))


def categorise(w: DataFrame, context: str = "CG", p: float = 0.05, min_n: int = 0) -> DataFrame:
    """BM, IM or UM by the context's p-value, where it is covered enough and no other context is significant; other regions go."""
    own = F.col(f"p_value_context_{context}")
    others = [F.col(f"p_value_context_{c}") >= p for c in CONTEXTS if c != context]
    ok = F.col(f"count_total_context_{context}") >= min_n
    for o in others:
        ok = ok & o
    kind = F.when(own < p, "BM").when(own >= 1 - p, "UM").otherwise("IM")
    return w.where(ok & own.isNotNull()).withColumn("category", kind)


class Filter:
    """A condition on columns, joined with others by & and |."""

    def __init__(self, condition: Column):
        self.condition = condition

    def __and__(self, other: "Filter") -> "Filter":
        return Filter(self.condition & other.condition)

    def __or__(self, other: "Filter") -> "Filter":
        return Filter(self.condition | other.condition)

    def __call__(self, d: DataFrame) -> DataFrame:
        return d.where(self.condition)


class _On:
    """Compared with a number or a column, a column gives a ``Filter``."""

    def __init__(self, column: Column):
        self.column = column

    def __lt__(self, x):
        return Filter(self.column < x)

    def __le__(self, x):
        return Filter(self.column <= x)

    def __gt__(self, x):
        return Filter(self.column > x)

    def __ge__(self, x):
        return Filter(self.column >= x)

    def __eq__(self, x):
        return Filter(self.column == x)

    __hash__ = None


def p_value_of(context: str) -> _On:
    """The p-values of a context in a ``wide`` table, for filters: ``(p_value_of("CG") < 0.05) & (count_of("CG") >= 10)``."""
    return _On(F.col(f"p_value_context_{context}"))


def count_of(context: str) -> _On:
    return _On(F.col(f"count_total_context_{context}"))
