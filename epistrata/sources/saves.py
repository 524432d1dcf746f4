"""What analyses leave behind, as tab-separated text or Parquet: tables of metagenes and windows, regions, labels, statistics of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the regions' p-values, in order.
REGION_P = "chr string, start long, end long, id string, strand string, context string, p_value double, count_m long, count_total long"


def save_tsv(d: DataFrame, path: str, gzip: bool = False, header: bool = True) -> None:
    """Spark's part files in the folder ``path``; nulls are empty."""
    d.write.csv(path, sep="\t", header=header, quote="", emptyValue="", compression="gzip" if gzip else "none")


def save_samples(samples: dict[str, DataFrame], path: str, merged: bool = False, gzip: bool = False) -> None:
    """A folder per sample below ``path``, or one table with a ``label`` column."""
    if not merged:
        for label, d in samples.items():
            save_tsv(d, f"{path}/{label}", gzip)
        return
    out = None
    for label, d in samples.items():
        d = d.withColumn("label", F.lit(label))
        out = d if out is None else out.unionByName(d)
    save_tsv(out, path, gzip)


def save_site_pvalues(d: DataFrame, path: str) -> None:
    """Parquet that ``reports.read_report(..., "binom")`` reads."""
    d.select("chr", "strand", "position", "context", "p_value").write.parquet(path)


def save_region_pvalues(d: DataFrame, path: str) -> None:
    """A region and context per line, without header."""
    save_tsv(d.select("chr", "start", "end", "id", "strand", "context", "p_value", "count_m", "count_total"), path, header=False)


def read_region_pvalues(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_region_pvalues`` wrote, to be widened by ``binomial.wide``; a path that isn't there is an error."""
    return spark.read.csv(path, sep="\t", schema=REGION_P, quote="")


def save_regions(wide: DataFrame, path: str) -> None:
    """chr, start, end, id and strand, as browsers read them."""
    save_tsv(wide.select("chr", "start", "end", "id", "strand"), path, header=False)


def save_labels(d: DataFrame, path: str, key: str = "gene") -> None:
    save_tsv(d.select(F.col(key).cast("string").alias("name"), F.col("label").cast("string").alias("label")), path, header=False)


def save_windows(d: DataFrame, path: str, value: str, length: int, by: str = "chr") -> None:
    """A heterogeneity's windows: chromosome, the places of its ``length`` cytosines, the value."""
    save_tsv(d.select(by, *[F.get("positions", F.lit(i)).alias(f"pos{i}") for i in range(length)], F.col(value).alias("value")), path, header=False)


def save_discordance(d: DataFrame, path: str, by: str = "chr") -> None:
    save_tsv(d.select(by, F.col("position").alias("pos"), F.col("pdr").alias("value"), F.col("concordant").alias("ccount"), F.col("discordant").alias("dcount")), path, header=False)
