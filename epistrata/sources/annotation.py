"""Annotations, sequences and sample sheets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density import complement, trinucleotide_context

#: The columns of annotations and sample sheets, and all base codes.
GENOME = ["chr", "type", "start", "end", "strand", "id"]
GFF = "chr string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
BASES = "ACGTUNRYSWKMBDHV"
SHEET = "name string, report_file string, genome_file string, flank_length long, min_length long, region_type string, genome_type string, report_type string"


def from_gff_rows(d: DataFrame) -> DataFrame:
    """id: the attributes' leading ID=...; null if there is none."""
    return d.select("chr", "type", "start", "end", "strand", F.nullif(F.regexp_extract("attributes", "^ID=([^;]+)", 1), F.lit("")).alias("id"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return from_gff_rows(spark.read.csv(path, sep="\t", comment="#", schema=GFF, quote="", mode="DROPMALFORMED"))


def from_columns(d: DataFrame, chr: int = 0, start: int = 1, end: int = 2, strand: int | None = None, id: int | None = None, type: int | None = None, where: Column | str | None = None) -> DataFrame:
    """An annotation from any table by column places; missing ones: id '', type '', strand '.'."""
    if where is not None:
        d = d.where(where)
    at = lambda i, default: F.lit(default) if i is None else F.col(f"`{d.columns[i]}`").cast("string")
    num = lambda i: F.col(f"`{d.columns[i]}`").cast("long")
    return d.select(at(chr, "").alias("chr"), at(type, "").alias("type"), num(start).alias("start"), num(end).alias("end"), at(strand, ".").alias("strand"), at(id, "").alias("id"))


def read_custom(spark: SparkSession, path: str, has_header: bool = False, comment: str = "#", **places) -> DataFrame:
    return from_columns(spark.read.csv(path, sep="\t", header=has_header, comment=comment), **places)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, sequence): a row per record, plain or gzip; records are split by the reader, each held by one task."""
    records = spark.read.text(path, lineSep=">").where(F.length("value") > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    return records.select(name.alias("chr"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("sequence"))


#: Bases that are looked at together; two of the neighbours' come along on either side.
PIECE = 1000


def cytosines(sequences: DataFrame, piece: int = PIECE) -> DataFrame:
    """(chr, position, strand, context, trinuc) of every C with two bases after it, and every G with two before, read on the other strand.

    Sequences are cut into pieces in one pass and the bases of a piece are looked up by place, so the cost grows with the length."""
    cut = sequences.select("chr", F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)).alias("pieces"))
    beside = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    wide = F.transform("pieces", lambda x, i: F.struct(
        F.greatest(i * piece - 2, F.lit(0)).cast("long").alias("first"), F.length(x).alias("size"), F.least(i * 2, F.lit(2)).alias("lead"), F.concat(F.right(beside(i - 1), F.lit(2)), x, F.left(beside(i + 1), F.lit(2))).alias("bases")))
    p = cut.select("chr", F.explode(wide).alias("p")).select("chr", "p.*").where(F.length("bases") >= 3)

    def found(b):
        at = lambda i: F.get(b, i)
        places = F.filter(F.sequence(F.col("lead"), F.col("lead") + F.col("size") - 1), lambda i: at(i).isin("C", "G"))
        return F.transform(places, lambda i: F.struct((F.col("first") + i + 1).alias("position"), (at(i) == "C").alias("strand"), F.when(at(i) == "C", F.concat(at(i), at(i + 1), at(i + 2))).otherwise(F.concat(at(i - 2), at(i - 1), at(i))).alias("three")))

    hits = F.element_at(F.transform(F.array(F.split("bases", "")), found), 1)
    d = p.select("chr", F.explode(hits).alias("h")).select("chr", "h.*").where(F.length("three") == 3)
    context = F.when(F.col("strand"), trinucleotide_context(F.col("three"), True)).otherwise(trinucleotide_context(F.col("three"), False))
    return d.select("chr", "position", "strand", context.alias("context"), F.when(F.col("strand"), F.col("three")).otherwise(F.reverse(complement(F.col("three")))).alias("trinuc"))


def trinucleotides() -> list[str]:
    """C and any two bases or codes."""
    return [f"C{a}{b}" for a in BASES for b in BASES]


def write_index(index: DataFrame, path: str) -> None:
    """A folder per chromosome, its positions in ranges: files have disjoint ones, so that readers skip what they don't need."""
    index.repartitionByRange("chr", "position").sortWithinPartitions("chr", "position").write.partitionBy("chr").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index, or one made from a FASTA file. A path that isn't there is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise
    except Exception as e:
        if "is not a Parquet file" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e) and "FAILED_READ_FILE" not in str(e):
            raise
    return cytosines(read_fasta(spark, path))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sample sheet with its defaults; one genome per name."""
    d = spark.read.csv(path, sep="\t", schema=SHEET, comment="#")
    defaults = {"flank_length": 0, "min_length": 0, "genome_type": "gff", "report_type": "bismark"}
    d = d.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in d.columns])
    mixed = d.groupBy("name").agg(F.countDistinct("genome_file").alias("n")).where("n > 1").limit(1).collect()
    if mixed:
        raise ValueError(f"sample {mixed[0]['name']} has more than one genome")
    return d


def samples(sheet: DataFrame) -> dict[str, list]:
    """name -> its rows of a sheet, replicates together, in the order of names. A sheet has as many rows as an experiment has files."""
    out: dict[str, list] = {}
    for r in sheet.orderBy("name", "report_file").collect():
        out.setdefault(r["name"], []).append(r)
    return out
