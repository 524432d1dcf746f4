"""Metagenes: cytosines binned along regions and their flanks, and what is drawn from them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.density import covered, strand_fits
from ..functions.stats import savitzky_golay, t_half_width
from ..functions.tables import written
from .joins import asof_backward

KEY = ["chr", "strand", "start", "gene", "id", "context", "fragment"]


@dataclass(frozen=True)
class Metagene:
    """``df``: KEY, sum, count; and the numbers of upstream, body and downstream windows."""

    df: DataFrame
    up: int
    body: int
    down: int

    @property
    def windows(self) -> int:
        return self.up + self.body + self.down

    def of(self, df: DataFrame, **counts) -> "Metagene":
        return replace(self, df=df, **counts)


def fragment(up: int, body: int, down: int, clamp: bool = False) -> Column:
    """Window of a position within upstream, body and downstream. ``clamp``: the last base of a very long body stays in the body."""
    p, s, e = F.col("position"), F.col("r_start"), F.col("r_end")
    before = F.floor((p - F.col("r_upstream")) / F.nullif(s - F.col("r_upstream"), F.lit(0)) * up)
    inside = F.floor((p - s) / (e - s + F.lit(1e-10)) * body) + up
    if clamp:
        inside = F.least(inside, F.lit(up + body - 1))
    after = F.floor((p - e) / (F.col("r_downstream") - e + F.lit(1e-10)) * down) + up + body
    return F.when(p < s, before).when(p <= e, inside).otherwise(after)


SUMMARIES = {
    "wmean": (lambda d: F.sum(d), lambda d: F.count(d)),
    "mean": (lambda d: F.avg(d), None),
    "median": (lambda d: F.median(d), None),
    "min": (lambda d: F.min(d), None),
    "max": (lambda d: F.max(d), None),
    "1pgeom": (lambda d: F.expm1(F.avg(F.log1p(d))), None),
}


def placed(cytosines: DataFrame, regions: DataFrame, mode: str = "asof") -> DataFrame:
    """Covered cytosines with the region they fall in: the nearest begun before, if its strand fits."""
    c = cytosines.where((F.col("count_total") != 0) & covered(F.col("density")))
    hit = asof_backward(c, regions)
    return hit.where(strand_fits(F.col("r_strand"), F.col("strand")))


def metagene(cytosines: DataFrame, regions: DataFrame, up: int = 0, body: int = 2000, down: int = 0, summary: str = "wmean", clamp: bool = False) -> Metagene:
    """Density per region, context and window."""
    if summary not in SUMMARIES:
        raise ValueError(f"summary is one of {', '.join(SUMMARIES)}")
    up, body, down = (max(0, n) for n in (up, body, down))
    total, count = SUMMARIES[summary]
    gene = F.concat(F.col("r_chr"), F.lit(":"), F.col("r_start").cast("string"), F.lit("-"), F.col("r_end").cast("string"))
    d = placed(cytosines, regions).select(
        "chr", F.col("r_strand").alias("strand"), F.col("r_start").alias("start"), gene.alias("gene"), F.col("r_id").alias("id"), "context",
        fragment(up, body, down, clamp).cast("long").alias("fragment"), "density")
    n = count(F.col("density")) if count else F.lit(1)
    return Metagene(d.groupBy(*KEY).agg(total(F.col("density")).alias("sum"), n.cast("long").alias("count")), up, body, down)


def filtered(m: Metagene, context=None, strand=None, chr=None, genome: DataFrame | None = None, ids=None, coords=None) -> Metagene:
    """All given conditions together. ``genome``: rows whose (chr, start) it has."""
    d = m.df
    for name, value in (("context", context), ("strand", strand), ("chr", chr)):
        if value is not None:
            d = d.where(F.col(name) == value)
    if ids is not None:
        d = d.where(F.col("id").isin(list(ids)))
    if coords is not None:
        d = d.where(F.col("gene").isin(list(coords)))
    if genome is not None:
        d = d.join(genome.select("chr", "start").distinct(), ["chr", "start"], "left_semi")
    return m.of(d)


def _summed(d: DataFrame, keys) -> DataFrame:
    return d.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def resize(m: Metagene, to: int | None) -> Metagene:
    """Fewer windows; none or not fewer: unchanged."""
    if to is None or to >= m.windows:
        return m
    step = m.windows // to
    d = m.df.withColumn("fragment", F.floor(F.col("fragment") / m.windows * to).cast("long"))
    return m.of(_summed(d, KEY), up=m.up // step, body=m.body // step, down=m.down // step)


def trim_flank(m: Metagene, upstream: bool = True, downstream: bool = True) -> Metagene:
    d, counts = m.df, {}
    if downstream:
        d, counts["down"] = d.where(F.col("fragment") < m.up + m.body), 0
    if upstream:
        d = d.where(F.col("fragment") > m.up - 1).withColumn("fragment", F.col("fragment") - m.up)
        counts["up"] = 0
    return m.of(d, **counts)


def merged(samples: list[Metagene]) -> Metagene:
    """Sums over samples of equal windows. They are dealt out by region first: else a task would hold the sums of each sample beside those of all."""
    if len({(m.up, m.body, m.down) for m in samples}) > 1:
        raise ValueError("samples differ in their windows")
    d = samples[0].df
    for m in samples[1:]:
        d = d.unionByName(m.df)
    return samples[0].of(_summed(ranges.dealt(d, "chr", "start"), KEY))


def labelled(samples: dict[str, Metagene]) -> DataFrame:
    """One table with a label per sample."""
    out = None
    for label, m in samples.items():
        d = m.df.withColumn("label", F.lit(label))
        out = d if out is None else out.unionByName(d)
    return out


def forward(d: DataFrame) -> DataFrame:
    """Fragments of '-' regions counted from the other end, by the largest fragment seen."""
    last = d.agg(F.max("fragment").alias("_last"))
    return d.crossJoin(F.broadcast(last)).withColumn("fragment", F.when(F.col("strand") == "-", F.col("_last") - F.col("fragment")).otherwise(F.col("fragment"))).drop("_last")


def statistic(name: str) -> Column:
    """The line's value per window out of sum and count: wmean, mean, log or wlog."""
    share = F.col("sum") / F.col("count")
    if name == "wmean":
        return F.sum("sum") / F.sum("count")
    if name == "mean":
        return F.avg(share)
    if name == "log":
        return F.expm1(F.avg(F.log1p(share)))
    if name == "wlog":
        return F.expm1(F.sum(F.log1p(share) * F.col("count")) / F.sum("count"))
    raise ValueError(f"unknown statistic {name}")


def line(m: Metagene, stat: str = "wmean", merge_strands: bool = True, resolution: int | None = None, dense: bool = True, keys=()) -> DataFrame:
    """(keys, fragment, density): every window has a row if ``dense``; those without data are null. ``stat``: see ``statistic``, or qN for
    the N-th percentile of the regions' densities by nearest rank."""
    r = resize(m, resolution)
    d = forward(r.df) if merge_strands else r.df
    if stat[:1] == "q" and stat[1:].isdigit() and int(stat[1:]) <= 100:
        shares = d.select(*keys, "fragment", (F.col("sum") / F.col("count")).alias("share"))
        out = ranges.nearest_rank(shares, [*keys, "fragment"], "share", int(stat[1:]) / 100, "density")
    else:
        out = d.groupBy(*keys, "fragment").agg(statistic(stat).alias("density"))
    if not dense:
        return out
    template = m.df.sparkSession.range(r.windows).withColumnRenamed("id", "fragment")
    if keys:
        template = d.select(*keys).distinct().crossJoin(F.broadcast(template))  # a row per window
    return template.join(out, [*keys, "fragment"], "left")


def confidence_inputs(m: Metagene) -> DataFrame:
    """(fragment, n, average, variance) that a window's interval is made of."""
    share = F.col("sum") / F.col("count")
    return forward(m.df).groupBy("fragment").agg(F.sum("count").alias("n"), F.avg(share).alias("average"), F.pow(F.avg(F.col("sum") - share), 2).alias("variance"))


def line_with_interval(m: Metagene, confidence: float = 0.95) -> DataFrame:
    if not 0 <= confidence < 1:
        warnings.warn("confidence lies in [0, 1); taken as 0", stacklevel=2)
        confidence = 0
    d = confidence_inputs(m).withColumn("half", t_half_width((F.col("n") - 1).cast("double"), F.sqrt(F.col("variance") / F.col("n")), F.lit(float(confidence))))
    return d.select("fragment", "average", (F.col("average") - F.col("half")).alias("lower"), (F.col("average") + F.col("half")).alias("upper"))


def smoothed_line(m: Metagene, smooth: int = 0, **options) -> list[float]:
    """The dense line in percent on the driver: as many numbers as windows."""
    rows = line(m, **options).orderBy("fragment").collect()
    return (savitzky_golay([float("nan") if r.density is None else r.density for r in rows], smooth) * 100).tolist()


def heat_map(m: Metagene, rows: int = 100, columns: int | None = None) -> DataFrame:
    """(row, fragment, density in percent), a dense grid: genes from the densest down, dealt evenly over the rows.

    The rank is over the genes (a row each, after aggregation), by ranges of their density. Shares and weights are read several times on the way, so
    both are written down: cytosines are placed once, and every reading has a gene at the same weight."""
    r = resize(m, columns)
    d = forward(written(r.df.select("gene", "strand", "fragment", (F.col("sum") / F.col("count")).alias("share")), "shares"))
    genes = d.groupBy("gene").agg((F.sum("share") / (r.windows + 1)).alias("weight"))
    keyed = written(genes.select("gene", (-F.round("weight", 9)).alias("key")), "weights")
    ranked = ranges.numbered(keyed, "key", ["gene"], "rank").crossJoin(F.broadcast(keyed.agg(F.count("*").alias("n"))))  # one row
    row = F.floor(F.col("rank") / F.col("n") * rows).cast("long")
    cells = d.join(ranked.select("gene", row.alias("row")), "gene").groupBy("row", "fragment").agg((F.avg("share") * 100).alias("density"))
    spark = m.df.sparkSession
    grid = spark.range(rows).withColumnRenamed("id", "row").crossJoin(F.broadcast(spark.range(r.windows).withColumnRenamed("id", "fragment")))
    return grid.join(cells, ["row", "fragment"], "left").fillna(0.0, ["density"])


def box(m: Metagene) -> DataFrame:
    """Mean density per region."""
    return m.df.groupBy("chr", "start").agg((F.sum("sum") / F.sum("count")).alias("density"), F.min("gene").alias("gene"), F.min("strand").alias("strand"), F.min("id").alias("id"))


def box_stats(d: DataFrame, value: str, keys) -> DataFrame:
    """Quartiles, and the whiskers at the outermost values within 1.5 times their distance."""
    q = d.groupBy(*keys).agg(*[F.percentile(value, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    j = d.join(q, list(keys))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = j.where((F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach))
    return inside.groupBy(*keys, "q1", "median", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def gene_means(samples: DataFrame) -> DataFrame:
    """(gene, label, density) of labelled samples."""
    return samples.groupBy("gene", "label").agg((F.sum("sum") / F.sum("count")).alias("density"))


def sample_matrix(samples: DataFrame, labels: list[str]) -> DataFrame:
    """A row per gene that all samples have, a column per label."""
    return gene_means(samples).groupBy("gene").pivot("label", labels).agg(F.first("density")).dropna()


def variable_rows(matrix: DataFrame, labels: list[str], q: float) -> DataFrame:
    """Rows whose variance over the labels is above the q-quantile of all."""
    n = float(len(labels))
    mean = sum((F.col(x) for x in labels), F.lit(0.0)) / n
    v = matrix.withColumn("variance", sum((F.pow(F.col(x) - mean, 2) for x in labels), F.lit(0.0)) / n)
    limit = v.agg(F.percentile("variance", q).alias("_limit"))
    return v.crossJoin(F.broadcast(limit)).where("variance > _limit").drop("_limit")


def dendrogram_matrix(samples: DataFrame, labels: list[str], q: float = 0.75) -> DataFrame:
    """What samples are clustered by: the rows of ``sample_matrix`` that vary most, those above the q-quantile of variance; q = 0: all."""
    m = sample_matrix(samples, labels)
    return variable_rows(m, labels, q).select("gene", *labels) if q > 0 else m


def ticks(m: Metagene) -> list[float]:
    """Places of the labels upstream, start, body, end and downstream, in windows."""
    return [m.up / 2, m.up, m.windows / 2, m.up + m.body, m.windows - m.down / 2]


def borders(m: Metagene) -> list[int]:
    """Windows at which the body begins and ends."""
    return [m.up, m.up + m.body]
