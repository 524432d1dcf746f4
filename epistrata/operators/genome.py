"""Regions of an annotation, with flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["chr", "strand", "start", "end", "upstream", "downstream", "id"]


def select_type(genome: DataFrame, kind: str | None, min_length: int, flank: int) -> DataFrame:
    """Rows of a type that lie further in than the flank and are longer than ``min_length`` (both strictly)."""
    d = genome if kind is None else genome.where(F.col("type") == kind)
    return d.where((F.col("start") > flank) & (F.col("end") - F.col("start") > min_length))


def oriented(genome: DataFrame) -> DataFrame:
    """If any row ends before it starts: such rows are swapped to strand '-', all others become '+'. Else unchanged."""
    flag = genome.agg(F.coalesce(F.max(F.col("end") < F.col("start")), F.lit(False)).alias("_any"))
    d = genome.crossJoin(F.broadcast(flag))  # one row
    back = F.col("end") < F.col("start")
    return d.select(*[
        {"start": F.least("start", "end").alias("start"), "end": F.greatest("start", "end").alias("end"),
         "strand": F.when(F.col("_any"), F.when(back, "-").otherwise("+")).otherwise(F.col("strand")).alias("strand")}.get(c, F.col(c)) for c in genome.columns])


def with_flanks(d: DataFrame, flank: int) -> DataFrame:
    return d.select("chr", "strand", "start", "end", (F.col("start") - flank).alias("upstream"), (F.col("end") + flank).alias("downstream"), "id")


def regions(genome: DataFrame, kind: str | None = None, min_length: int = 0, flank: int = 0) -> DataFrame:
    """(chr, strand, start, end, upstream, downstream, id)."""
    return with_flanks(select_type(genome, kind, min_length, flank), flank)


def all_regions(genome, min_length=0, flank=0):
    return regions(genome, None, min_length, flank)


def gene_body(genome, min_length=0, flank=2000):
    return regions(genome, "gene", min_length, flank)


def exon(genome, min_length=100):
    return regions(genome, "exon", min_length, 0)


def cds(genome, min_length=100):
    return regions(genome, "CDS", min_length, 0)


def other(genome, kind, min_length=1000, flank=100):
    return regions(genome, kind, min_length, flank)


def near_tss(genome: DataFrame, min_length: int = 4000, flank: int = 2000) -> DataFrame:
    """The flank on either side of the start, whatever the strand."""
    d = select_type(genome, "gene", min_length, flank)
    return d.select("chr", "strand", "start", (F.col("start") + flank).alias("end"), (F.col("start") - flank).alias("upstream"), (F.col("start") + flank).alias("downstream"), "id")


def near_tes(genome: DataFrame, min_length: int = 4000, flank: int = 2000) -> DataFrame:
    """The flank on either side of the end, whatever the strand."""
    d = select_type(genome, "gene", min_length, flank)
    return d.select("chr", "strand", (F.col("end") - flank).alias("start"), "end", (F.col("end") - flank).alias("upstream"), (F.col("end") + flank).alias("downstream"), "id")


def neighbour_gap(genome: DataFrame) -> DataFrame:
    """Distances to the next and previous region of a chromosome's strand (null at its ends)."""
    w = Window.partitionBy("chr", "strand").orderBy("start", "id")
    return genome.select("chr", "strand", "start", "end", "id", (F.lead("start").over(w) - F.col("end")).alias("gap_after"), (F.col("start") - F.lag("end").over(w)).alias("gap_before"))


def require_rows(d: DataFrame) -> DataFrame:
    """Raises ValueError on an empty table; runs a job."""
    if d.isEmpty():
        raise ValueError("no regions are left; check the type, flank and length limits")
    return d
