"""Calls of single reads: counts, quality, and heterogeneity of methylation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import BIN

#: Strand and whether converted, by read and genome conversion; context and state by call.
STRANDS = {"CTCT": ("+", True), "CTGA": ("-", True), "GACT": ("+", False), "GAGA": ("-", False)}
CALLS = {"z": ("CG", 0), "Z": ("CG", 1), "x": ("CHG", 0), "X": ("CHG", 1), "h": ("CHH", 0), "H": ("CHH", 1), "u": ("U", 0), "U": ("U", 1)}


def _map(d: dict, k: int):
    return F.create_map(*[F.lit(x) for key, v in d.items() for x in (key, v[k])])


def exploded_calls(reads: DataFrame) -> DataFrame:
    """A row per call of reads (chr, qname, pos, xm, xr, xg, quals): '.' and unaligned reads go; positions from 1.

    quals: array of qualities along the read."""
    d = reads.where(F.col("pos").isNotNull() & F.col("xm").isNotNull())
    d = d.select("chr", "qname", "pos", F.concat("xr", "xg").alias("strand_conv"), "quals", F.posexplode(F.split("xm", "")).alias("offset", "call")).where(~F.col("call").isin(".", ""))
    return d.select("chr", "qname", (F.col("pos") + F.col("offset")).alias("position"), "call", F.get("quals", F.col("offset")).alias("qual"), "strand_conv")


def decoded(calls: DataFrame, min_qual: int | None = None, context: str | None = None, keep_converted: bool = True) -> DataFrame:
    """Strand, context and state per call; unknown contexts and (unless kept) converted strands go; quality above ``min_qual``."""
    d = calls.select("*", F.element_at(_map(STRANDS, 0), F.col("strand_conv")).alias("strand"), F.element_at(_map(STRANDS, 1), F.col("strand_conv")).alias("converted"),
                     F.element_at(_map(CALLS, 0), F.col("call")).alias("context"), F.element_at(_map(CALLS, 1), F.col("call")).alias("m"))
    d = d.where((F.col("context") != "U") & (F.lit(keep_converted) | ~F.col("converted")))
    if min_qual is not None:
        d = d.where(F.col("qual") > min_qual)
    return d if context is None else d.where(F.col("context") == context)


def in_regions(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls within [upstream, downstream] of a region of their chromosome; once per region."""
    from .joins import _exploded

    r = _exploded(regions, F.col("upstream"), F.col("downstream"), BIN).select(F.col("chr").alias("_c"), "_bin", F.col("upstream").alias("_u"), F.col("downstream").alias("_d"), F.col("id").alias("region"))
    c = calls.withColumn("_b", F.floor(F.col("position") / BIN))
    return c.join(r, (c["chr"] == r["_c"]) & (c["_b"] == r["_bin"]) & F.col("position").between(F.col("_u"), F.col("_d"))).select(*calls.columns, "region")


def where_calls(calls: DataFrame, **values) -> DataFrame:
    """Calls whose columns equal the given values, before any windows are made of them."""
    for k, v in values.items():
        calls = calls.where(F.col(k) == v)
    return calls


def per_slab(reads: DataFrame, slab: int = 1_000_000) -> DataFrame:
    """(chr, slab, reads, mean_qual): how many reads begin in each stretch of a chromosome, and their mean quality."""
    mean = F.aggregate("quals", F.lit(0.0), lambda a, q: a + q) / F.nullif(F.size("quals"), F.lit(0))
    return reads.where("pos is not null").groupBy("chr", F.floor(F.col("pos") / slab).alias("slab")).agg(F.count("*").alias("reads"), F.avg(mean).alias("mean_qual"))


def deduplicated(calls: DataFrame) -> DataFrame:
    """The best call of a read at a position."""
    w = Window.partitionBy("chr", "qname", "position").orderBy(F.col("qual").desc(), "call")
    return calls.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def position_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("chr", "position").agg(F.sum("m").cast("long").alias("count_m"), F.count("m").alias("count_total"), F.min("context").alias("context"), F.min("strand").alias("strand"))


def full_report(index: DataFrame, counts: DataFrame) -> DataFrame:
    """Every cytosine of the index with its counts, 0 where there are none."""
    d = index.join(counts.select("chr", "position", "count_m", "count_total"), ["chr", "position"], "left").fillna(0, ["count_m", "count_total"])
    share = F.when(F.col("count_total") == 0, F.lit(0.0)).otherwise(F.col("count_m") / F.nullif(F.col("count_total"), F.lit(0)))
    return d.withColumn("density", share)


def quality_histogram(reads: DataFrame, by_offset: bool = False) -> DataFrame:
    q = reads.select(F.posexplode("quals").alias("offset", "qual"))
    return q.groupBy(*(["offset"] if by_offset else []), "qual").agg(F.count("*").alias("n"))


def quality_by_offset(reads: DataFrame) -> DataFrame:
    return reads.select(F.posexplode("quals").alias("offset", "qual")).groupBy("offset").agg(F.avg("qual").alias("mean_qual"), F.count("*").alias("n"))


def numbered(calls: DataFrame, by: str) -> DataFrame:
    """(by, position, k): distinct positions numbered from 1 in ascending order. Bins are counted first and numbered within, so a task orders one bin."""
    positions = calls.select(by, "position", F.floor(F.col("position") / BIN).alias("_bin")).distinct()
    bins = positions.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    before = bins.select(by, "_bin", (F.sum("_n").over(Window.partitionBy(by).orderBy("_bin")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_bin").orderBy("position"))
    return positions.withColumn("_k", place).join(before, [by, "_bin"]).select(by, "position", (F.col("_before") + F.col("_k")).alias("k"))


def patterns(calls: DataFrame, length: int = 4, by: str = "chr") -> DataFrame:
    """(by, window, first, last, pattern, n): counts of 0/1 patterns of reads that cover ``length`` consecutive cytosines of ``by``.

    Cytosines are numbered by ``by``; a read's calls that are consecutive in number form its windows, so no matrix is made."""
    d = calls.join(numbered(calls, by), [by, "position"])
    w = Window.partitionBy(by, "qname").orderBy("k").rowsBetween(Window.currentRow, length - 1)
    ahead = d.select(by, "k", "position", F.collect_list(F.col("k")).over(w).alias("ks"), F.collect_list(F.col("position")).over(w).alias("ps"), F.array_join(F.collect_list(F.col("m").cast("string")).over(w), "").alias("pattern"))
    full = ahead.where((F.size("ks") == length) & (F.element_at("ks", -1) == F.col("k") + length - 1))
    return full.groupBy(by, F.col("k").alias("window"), F.col("position").alias("first"), F.element_at("ps", -1).alias("last"), F.col("ps").alias("positions"), "pattern").agg(F.count("*").alias("n"))


def _shares(p: DataFrame, by: str, min_depth: int) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(by, "window"))
    return p.withColumn("share", F.col("n") / total).withColumn("depth", total).where(F.col("depth") >= min_depth)


def methylation_entropy(calls: DataFrame, length: int = 4, min_depth: int = 4, by: str = "chr") -> DataFrame:
    """|(1 / length) sum of share log2 share| over the patterns of each window read ``min_depth`` times or more."""
    d = _shares(patterns(calls, length, by), by, min_depth)
    return d.groupBy(by, "window", "first", "last", "positions").agg(F.abs(F.sum(F.col("share") * F.log2("share")) / length).alias("entropy"), F.first("depth").alias("depth"))


def epipolymorphism(calls: DataFrame, length: int = 4, min_depth: int = 4, by: str = "chr") -> DataFrame:
    """1 - sum of share squared."""
    d = _shares(patterns(calls, length, by), by, min_depth)
    return d.groupBy(by, "window", "first", "last", "positions").agg((1 - F.sum(F.col("share") * F.col("share"))).alias("epipolymorphism"), F.first("depth").alias("depth"))


def discordant_reads(calls: DataFrame, min_calls: int = 4, min_depth: int = 1, by: str = "chr") -> DataFrame:
    """PDR per position: discordant over all reads there with ``min_calls`` calls or more; concordant reads are all 0 or all 1."""
    w = Window.partitionBy(by, "qname")
    d = calls.select(by, "position", (F.min("m").over(w) == F.max("m").over(w)).alias("same"), F.count("*").over(w).alias("calls")).where(F.col("calls") >= min_calls)
    g = d.groupBy(by, "position").agg(F.sum(F.col("same").cast("long")).alias("concordant"), F.sum((~F.col("same")).cast("long")).alias("discordant"))
    return g.where(F.col("concordant") + F.col("discordant") >= min_depth).withColumn("pdr", F.col("discordant") / (F.col("concordant") + F.col("discordant")))
