"""Overlap enrichment of regions in annotation types, and alignment of regions to genes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import savitzky_golay
from .joins import asof_nearest, interval_overlap


def type_lengths(genome: DataFrame) -> DataFrame:
    return genome.groupBy("type").agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def chr_lengths(genome: DataFrame) -> DataFrame:
    """The end of a chromosome's 'region' rows if it has any, else the span of its rows."""
    whole = F.max(F.when(F.col("type") == "region", F.col("end")))
    return genome.groupBy("chr").agg(F.coalesce(whole, F.max("end") - F.min("start")).alias("length"))


def flank_features(genome: DataFrame, flank: int) -> DataFrame:
    """'upstream' and 'downstream' rows beside each gene, swapped on '-'."""
    g = genome.where(F.col("type") == "gene")
    minus = F.col("strand") == "-"
    before = g.withColumn("type", F.when(minus, "downstream").otherwise("upstream")).withColumn("end", F.col("start")).withColumn("start", F.col("start") - flank)
    after = g.withColumn("type", F.when(minus, "upstream").otherwise("downstream")).withColumn("start", F.col("end")).withColumn("end", F.col("end") + flank)
    return before.unionByName(after).select(*genome.columns)


def enrich(dmr: DataFrame, genome: DataFrame) -> DataFrame:
    """(type, length, overlap, enrichment): log2 of a type's share of the regions' length over its share of the chromosomes'.

    'intergene' is the regions that overlap nothing, 'NCDS' genes without their CDS. Types without overlap or length have no row."""
    regions = dmr.select("chr", "start", "end").withColumn("_id", F.xxhash64("chr", "start", "end"))
    hit = interval_overlap(regions, genome.where(F.col("type") != "region").select("chr", "start", "end", "type"))
    over = hit.groupBy(F.col("r_type").alias("type")).agg(F.sum(F.col("ov_end") - F.col("ov_start")).alias("overlap"))
    lengths = type_lengths(genome.where(F.col("type") != "region"))
    free = regions.join(hit.select("_id").distinct(), "_id", "left_anti").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("overlap"))
    both = over.join(lengths, "type")
    pivot = both.agg(*[F.coalesce(F.sum(F.when(F.col("type") == t, F.col(c))), F.lit(0)).alias(f"{t}_{c}") for t in ("gene", "CDS") for c in ("overlap", "length")])
    totals = dmr.agg(F.sum(F.col("end") - F.col("start")).alias("all")).crossJoin(chr_lengths(genome).agg(F.sum("length").alias("genome"))).crossJoin(pivot)  # one row each
    ncds = totals.select(F.lit("NCDS").alias("type"), (F.col("gene_overlap") - F.col("CDS_overlap")).alias("overlap"), (F.col("gene_length") - F.col("CDS_length")).alias("length"))
    gap = free.crossJoin(totals).select(F.lit("intergene").alias("type"), "overlap", (F.col("genome") - F.col("gene_length")).alias("length"))
    rows = both.select("type", "overlap", "length").unionByName(ncds).unionByName(gap).where("overlap > 0 and length > 0")
    scored = rows.crossJoin(F.broadcast(totals.select("all", "genome")))
    return scored.select("type", "length", "overlap", (F.log2(F.col("overlap") / F.col("all")) - F.log2(F.col("length") / F.col("genome"))).alias("enrichment"))


def align(dmr: DataFrame, genes: DataFrame, flank: int) -> DataFrame:
    """Each region with the nearest gene by midpoints, as gene_body, upstream, downstream or intergene by where its midpoint lies."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    a = dmr.select("chr", "start", "end", mid.alias("mid"))
    g = genes.select("chr", "start", "end", "strand", "id", mid.alias("mid"))
    near = asof_nearest(a, g)
    minus = F.col("r_strand") == "-"
    side = F.when(F.col("mid").between(F.col("r_start"), F.col("r_end")), "gene_body").when(
        F.col("mid").between(F.col("r_start") - flank, F.col("r_start")), F.when(minus, "downstream").otherwise("upstream")).when(
        F.col("mid").between(F.col("r_end"), F.col("r_end") + flank), F.when(minus, "upstream").otherwise("downstream")).otherwise("intergene")
    return near.withColumn("target", side)


def align_stats(aligned: DataFrame) -> DataFrame:
    """Count and mean length per class, the most frequent first."""
    return aligned.groupBy("target").agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start")).alias("mean_length")).orderBy(F.col("n").desc(), "target")


def relative_positions(aligned: DataFrame, flank: int) -> DataFrame:
    """(pos, step): starts (+1) and ends (-1) of aligned regions, 0 to 1 along the gene, flanks in units of the flank; mirrored on '-'."""
    d = aligned.where(F.col("target") != "intergene")
    length = F.nullif(F.col("r_end") - F.col("r_start"), F.lit(0))

    def at(x):
        return F.when(x < F.col("r_start"), (x - F.col("r_start")) / flank).when(x > F.col("r_end"), 1 + (x - F.col("r_end")) / flank).otherwise((x - F.col("r_start")) / length)

    a, b = at(F.col("start")), at(F.col("end"))
    minus = F.col("r_strand") == "-"
    lo, hi = F.when(minus, 1 - b).otherwise(a), F.when(minus, 1 - a).otherwise(b)
    return d.select(F.explode(F.array(F.struct(lo.alias("pos"), F.lit(1).alias("step")), F.struct(hi.alias("pos"), F.lit(-1).alias("step")))).alias("e")).select("e.pos", "e.step")


def overlap_positions(dmr: DataFrame, genome: DataFrame, flank: int) -> DataFrame:
    """(pos, step): starts (+1) and ends (-1) of what regions share with genes and their flanks, as shares of the gene's or flank's length, mirrored on
    '-': upstream from -1 to 0, body from 0 to 1, downstream from 1 to 2."""
    genes = genome.where(F.col("type") == "gene")
    hit = interval_overlap(dmr.select("chr", "start", "end"), genes.unionByName(flank_features(genome, flank)).select("chr", "type", "start", "end", "strand"))
    minus, length = F.col("r_strand") == "-", F.nullif(F.col("r_end") - F.col("r_start"), F.lit(0))
    shift = F.when(F.col("r_type") == "upstream", -1).when(F.col("r_type") == "downstream", 1).otherwise(0)
    a = F.when(minus, F.col("r_end") - F.col("ov_end")).otherwise(F.col("ov_start") - F.col("r_start")) / length + shift
    b = F.when(minus, F.col("r_end") - F.col("ov_start")).otherwise(F.col("ov_end") - F.col("r_start")) / length + shift
    d = hit.select(a.alias("a"), b.alias("b")).where((F.col("a") >= -1) & (F.col("b") <= 2))
    return d.select(F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("b").alias("pos"), F.lit(-1).alias("step")))).alias("e")).select("e.pos", "e.step")


def coverage(steps: DataFrame, lo: float = -1.0, hi: float = 2.0, cell: float = 0.01) -> DataFrame:
    """(pos, depth): running sum of the steps within [lo, hi].

    Steps at one rounded position are summed first, all that lie before ``lo`` together, so the one order is over (hi - lo) / cell + 2 rows."""
    first, last = round(lo / cell), round(hi / cell)
    k = F.greatest(F.round(F.col("pos") / cell).cast("long"), F.lit(first - 1))
    d = steps.groupBy(k.alias("k")).agg(F.sum("step").alias("step")).where(F.col("k") <= last)
    depth = F.sum("step").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("k", depth.alias("depth")).where(F.col("k") >= first).select((F.col("k") * cell).alias("pos"), "depth")


def resampled(cov: DataFrame, flank_windows: int, body_windows: int, cell: float = 0.01) -> DataFrame:
    """(window, depth): mean depth per window of [-1, 0), [0, 1) and [1, 2), flanks and body in windows of their own; 0 where there is no step."""
    k = F.round(F.col("pos") / cell).cast("long")
    each = round(1 / cell)
    part, within = F.floor(k / each), F.pmod(k, F.lit(each))
    inner = lambda n: F.floor(within * n / each)
    window = F.when(part == -1, inner(flank_windows)).when(part == 0, flank_windows + inner(body_windows)).when(part == 1, flank_windows + body_windows + inner(flank_windows))
    d = cov.groupBy(window.cast("long").alias("window")).agg(F.avg("depth").alias("depth")).where("window is not null")
    return cov.sparkSession.range(2 * flank_windows + body_windows).withColumnRenamed("id", "window").join(d, "window", "left").fillna(0.0, ["depth"])


def coverage_line(resampled_: DataFrame, smooth: int = 0, norm: bool = False) -> list[float]:
    """The windows' depths on the driver, gaps (NaN) interpolated, smoothed, and as shares of the largest if ``norm``."""
    y = np.array([r["depth"] for r in resampled_.orderBy("window").collect()], dtype=float)
    known = np.flatnonzero(~np.isnan(y))
    y = np.interp(np.arange(len(y)), known, y[known]) if len(known) > 1 else np.zeros(len(y))
    y = savitzky_golay(y, smooth)
    return (y / y.max() if norm and len(y) and y.max() else y).tolist()


def step_line(pos: list[float], depth: list[float]) -> tuple[list[float], list[float]]:
    """The corners of a line that keeps each depth up to the next position: a rise at its own place, a fall at the next one."""
    x, y = [], []
    for a, b, c, d in zip(pos, pos[1:], depth, depth[1:]):
        x += [a] if c == d else [a if d > c else b] * 2
        y += [c] if c == d else [c, d]
    return x, y


def without_types(d: DataFrame, exclude: list[str]) -> DataFrame:
    """Rows of ``enrich`` of other types."""
    return d.where(~F.col("type").isin(*exclude)) if exclude else d


def trimmed(d: DataFrame, value: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    q = d.agg(F.percentile(value, lo).alias("_lo"), F.percentile(value, hi).alias("_hi"))
    return d.crossJoin(F.broadcast(q)).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
