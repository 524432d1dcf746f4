"""As-of and interval joins as equi-joins on (chromosome, bin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base pairs of a bin. A region is copied once per bin it touches.
BIN = 20_000
#: Base pairs of the stretches in which regions are put in order: as many regions at most that begin apart.
STRETCH = 2_000_000


def _exploded(df: DataFrame, lo: Column, hi: Column, bin_size: int) -> DataFrame:
    first, last = F.floor(lo / bin_size), F.floor(hi / bin_size)
    return df.withColumn("_bin", F.explode(F.sequence(first, last)))


def asof_backward(left: DataFrame, regions: DataFrame, key: str = "upstream", end: str = "downstream", at: str = "position", by: str = "chr", tie: str | list[str] = "id", bin_size: int = BIN, how: str = "inner", prefix: str = "r_", last: DataFrame | None = None) -> DataFrame:
    """Each left row with the one region of its ``by`` whose ``key`` is nearest at or below ``at``, if ``at`` <= its ``end`` (None: any).

    A region's reach ends where the next begins, so the as-of join is a join with disjoint intervals, and the upper limit
    prunes their bins. Regions that begin together: the longest, then the smallest ``tie``. No task holds a chromosome's left rows or
    regions: these are ordered by stretches, and a stretch's last one looks up where the next stretch with regions begins. ``how``: left keeps left rows without region. ``last``: for open ends, one
    row with the largest ``at`` (``_last``), if it is known."""
    known = regions.where(F.col(key).isNotNull()).withColumn("_stretch", F.floor(F.col(key) / STRETCH))
    w = Window.partitionBy(by, "_stretch").orderBy(key, *([F.col(end).desc()] if end else []), *([tie] if isinstance(tie, str) else tie))
    one = known.withColumn("_same", F.lag(key).over(w)).where("_same is null or _same <> `%s`" % key).drop("_same")
    begins = known.groupBy(by, "_stretch").agg(F.min(key).alias("_begin"))  # a row per stretch
    begins = begins.select(by, "_stretch", F.lead("_begin").over(Window.partitionBy(by).orderBy("_stretch")).alias("_begin"))
    one = one.withColumn("_next", F.lead(key).over(Window.partitionBy(by, "_stretch").orderBy(key))).join(begins, [by, "_stretch"], "left").drop("_stretch")
    nxt = F.coalesce(F.col("_next"), F.col("_begin")) - 1
    if end is None:  # open ends: up to the last position of the left side
        last = left.agg(F.max(at).alias("_last")) if last is None else last
        one = one.crossJoin(F.broadcast(last))  # one row
        reach = F.coalesce(nxt, F.greatest(F.col("_last"), F.col(key)))
    else:
        reach = F.least(F.coalesce(nxt, F.col(end)), F.col(end))
    one = one.withColumn("_hi", reach).where(F.col("_hi") >= F.col(key))
    binned = _exploded(one, F.col(key), F.col("_hi"), bin_size).drop("_last")
    r = binned.select(F.col(by).alias("_by"), "_bin", F.col(key).alias("_lo"), "_hi", *[F.col(c).alias(f"{prefix}{c}") for c in regions.columns])
    probe = left.withColumn("_bin", F.floor(F.col(at) / bin_size))
    hit = probe.join(r, (probe[by] == r["_by"]) & (probe["_bin"] == r["_bin"]) & (F.col(at) >= F.col("_lo")) & (F.col(at) <= F.col("_hi")), how)
    return hit.select(*[probe[c] for c in left.columns], *[f"{prefix}{c}" for c in regions.columns])


def asof_nearest(left: DataFrame, right: DataFrame, at: str = "mid", by: str = "chr") -> DataFrame:
    """Each left row with the right row of the smallest |difference| in ``at``; equally near: the lower one. Left rows of a ``by`` unknown to the right have nulls.

    Two as-of joins by bins, one downwards and one, on the mirrored axis, upwards, so no task holds a chromosome's left rows. Right rows at
    one place: the smallest by their other columns in turn, ``id`` first if they have one."""
    rc = [c for c in right.columns if c != by]
    tie = sorted([c for c in rc if c != at], key=lambda c: c != "id")
    neg = "_neg"
    below = asof_backward(left, right, at, None, at, by, tie, how="left", prefix="_b_", last=left.agg(F.max(at).alias("_last")))
    mirrored = right.withColumn(neg, -F.col(at))
    both = asof_backward(below.withColumn(neg, -F.col(at)), mirrored, neg, None, neg, by, tie, how="left", prefix="_a_", last=left.agg(F.max(-F.col(at)).alias("_last")))
    low = F.col(f"_a_{at}").isNull() | (F.col(f"_b_{at}").isNotNull() & (F.col(at) - F.col(f"_b_{at}") <= F.col(f"_a_{at}") - F.col(at)))
    return both.select(*left.columns, *[F.when(low, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(f"r_{c}") for c in rc])


def interval_overlap(left: DataFrame, right: DataFrame, by: str = "chr", start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """All pairs of intervals that share more than an end, with ``ov_start`` and ``ov_end``.

    Both sides are copied into the bins they touch; a pair is kept in the first bin both touch, so it comes out once."""
    a = _exploded(left, F.col(start), F.col(end), bin_size)
    r = _exploded(right, F.col(start), F.col(end), bin_size).select(F.col("_bin").alias("_rbin"), *[F.col(c).alias(f"r_{c}") for c in right.columns])
    first = F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / bin_size)
    hit = a.join(r, (a[by] == r[f"r_{by}"]) & (a["_bin"] == r["_rbin"]) & (F.col(start) < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(end)) & (F.col("_bin") == first))
    return hit.select(*left.columns, *[f"r_{c}" for c in right.columns], F.greatest(start, f"r_{start}").alias("ov_start"), F.least(end, f"r_{end}").alias("ov_end"))


def common_keys(df: DataFrame, key: list[str], label: str, n: int) -> DataFrame:
    """Keys that all ``n`` labels have."""
    return df.select(*key, label).distinct().groupBy(*key).count().where(F.col("count") == n).drop("count")
