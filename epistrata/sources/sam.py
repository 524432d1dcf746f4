"""Alignments with methylation call strings, from SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_lines(lines: DataFrame) -> DataFrame:
    """(chr, qname, pos, xm, xr, xg, quals) of SAM lines in ``value``; tags by name; unaligned reads have no pos."""
    c = F.split("value", "\t")
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:Z:([^\t]*)", 1), F.lit(""))
    pos = F.get(c, 3).cast("long")
    quals = F.transform(F.split(F.get(c, 10), ""), lambda q: F.ascii(q) - 33)
    return lines.where(~F.col("value").startswith("@") & (F.size(c) >= 11)).select(
        F.get(c, 2).alias("chr"), F.get(c, 0).alias("qname"), F.when((pos > 0) & (F.get(c, 2) != "*"), pos).alias("pos"), tag("XM").alias("xm"), tag("XR").alias("xr"), tag("XG").alias("xg"), quals.alias("quals"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))
