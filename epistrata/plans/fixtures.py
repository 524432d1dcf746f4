"""The driver's tables seen as methylation data, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density import density

FLANK, UP, BODY, DOWN = 500, 10, 20, 10
#: Bases that an order's key stands for: genes of a chromosome lie five times as far apart, so all orders are genes and none overlap.
STEP = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def shown(c: str = "density") -> F.Column:
    """A density for output: null where it is NaN."""
    return F.when(~F.isnan(c), F.round(c, 6)).alias(c)


def cytosines(spark, sf, replicate: int | None = None, of: int = 2) -> DataFrame:
    d = table(spark, sf, "lineitem")
    if replicate is not None:
        d = d.where(F.col("l_suppkey") % of == replicate)
    live = F.col("l_tax") != 0
    d = d.select(
        F.concat(F.lit("chr"), (F.col("l_orderkey") % 5 + 1).cast("string")).alias("chr"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("l_orderkey") * STEP + F.col("l_partkey") * 37 % 8000 - 700).alias("position"),
        F.when(F.col("l_returnflag") == "A", "CG").when(F.col("l_returnflag") == "N", "CHG").otherwise("CHH").alias("context"),
        F.when(live, F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("long")).otherwise(0).alias("m"), F.when(live, F.col("l_quantity").cast("long")).otherwise(0).alias("t"))
    d = d.groupBy("chr", "strand", "position", "context").agg(F.sum("m").alias("count_m"), F.sum("t").alias("count_total"))
    return d.select("chr", "strand", "position", "context", F.col("context").alias("trinuc"), "count_m", "count_total", density(F.col("count_m"), F.col("count_total")).alias("density"))


def cyt_sql(name: str = "cyt", where: str = "true") -> str:
    return f"""{name} AS (SELECT *, context AS trinuc, CASE WHEN count_total = 0 THEN 'nan'::DOUBLE ELSE count_m / count_total END AS density FROM (
  SELECT concat('chr', (l_orderkey % 5 + 1)::VARCHAR) AS chr, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
         l_orderkey * {STEP} + l_partkey * 37 % 8000 - 700 AS position, CASE l_returnflag WHEN 'A' THEN 'CG' WHEN 'N' THEN 'CHG' ELSE 'CHH' END AS context,
         sum(CASE WHEN l_tax <> 0 THEN floor(l_quantity * l_discount * 10)::BIGINT ELSE 0 END)::BIGINT AS count_m,
         sum(CASE WHEN l_tax <> 0 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS count_total
  FROM lineitem WHERE {where} GROUP BY 1, 2, 3, 4))"""


def genome(spark, sf) -> DataFrame:
    """Genes, with an exon and a CDS in each."""
    o = table(spark, sf, "orders")
    g = o.select(
        F.concat(F.lit("chr"), (F.col("o_orderkey") % 5 + 1).cast("string")).alias("chr"), (F.col("o_orderkey") * STEP).alias("start"),
        (F.col("o_orderkey") * STEP + 2000 + F.floor("o_totalprice").cast("long") % 4000).alias("end"),
        F.when(F.col("o_orderstatus") == "O", "+").when(F.col("o_orderstatus") == "F", "-").otherwise(".").alias("strand"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    part = lambda t, a, b: g.select("chr", F.lit(t).alias("type"), (F.col("start") + a).alias("start"), b.alias("end"), "strand", "id")
    return part("gene", 0, F.col("end")).union(part("exon", 100, F.col("start") + 900)).union(part("CDS", 300, F.col("start") + 700))


GENOME_SQL = f"""gene0 AS (SELECT concat('chr', (o_orderkey % 5 + 1)::VARCHAR) AS chr, o_orderkey * {STEP} AS start,
  o_orderkey * {STEP} + 2000 + floor(o_totalprice)::BIGINT % 4000 AS "end", CASE o_orderstatus WHEN 'O' THEN '+' WHEN 'F' THEN '-' ELSE '.' END AS strand,
  concat('o', o_orderkey::VARCHAR) AS id FROM orders),
genome AS (SELECT chr, 'gene' AS type, start, "end", strand, id FROM gene0
  UNION ALL SELECT chr, 'exon', start + 100, start + 900, strand, id FROM gene0
  UNION ALL SELECT chr, 'CDS', start + 300, start + 700, strand, id FROM gene0)"""

REG_SQL = GENOME_SQL + f""",
reg AS (SELECT chr, strand, start, "end", start - {FLANK} AS upstream, "end" + {FLANK} AS downstream, id FROM genome
  WHERE type = 'gene' AND start > {FLANK} AND "end" - start > 0)"""

PLACED_SQL = """placed AS (SELECT c.chr, c.position, c.context, c.density, r.strand, r.start, r."end", r.upstream, r.downstream, r.id
  FROM (SELECT * FROM cyt WHERE count_total <> 0 AND NOT isnan(density)) c ASOF JOIN reg r ON c.chr = r.chr AND c.position >= r.upstream
  WHERE c.position <= r.downstream AND (r.strand = '.' OR r.strand = c.strand)),
frag AS (SELECT *, concat(chr, ':', start::VARCHAR, '-', "end"::VARCHAR) AS gene,
  (CASE WHEN position < start THEN floor((position - upstream) / (start - upstream) * {u})
        WHEN position <= "end" THEN floor((position - start) / ("end" - start + 1e-10) * {b}) + {u}
        ELSE floor((position - "end") / (downstream - "end" + 1e-10) * {d}) + {u} + {b} END)::BIGINT AS fragment FROM placed)""".format(u=UP, b=BODY, d=DOWN)


def mg_sql(sum_: str = "sum(density)", count: str = "count(density)") -> str:
    """The metagene table as ``mg``."""
    return f"{cyt_sql()}, {REG_SQL}, {PLACED_SQL}, mg AS (SELECT chr, strand, start, gene, id, context, fragment, {sum_} AS sum, {count}::BIGINT AS count FROM frag GROUP BY ALL)"


def dmr(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    start = F.col("event_id") * 3000 + F.col("event_id") % 11 * 200
    return e.select(F.concat(F.lit("chr"), (F.col("event_id") % 7 % 5 + 1).cast("string")).alias("chr"), start.alias("start"), (start + 50 + (F.col("event_id") % 7) * 100).alias("end"))


DMR_SQL = """dmr AS (SELECT concat('chr', (event_id % 7 % 5 + 1)::VARCHAR) AS chr, event_id * 3000 + event_id % 11 * 200 AS start,
  event_id * 3000 + event_id % 11 * 200 + 50 + (event_id % 7) * 100 AS "end" FROM events)"""


def calls(spark, sf) -> DataFrame:
    d = table(spark, sf, "lineitem")
    return d.groupBy(F.concat(F.lit("chr"), (F.col("l_orderkey") % 5 + 1).cast("string")).alias("chr"), F.col("l_orderkey").cast("string").alias("qname"),
                     (F.col("l_linenumber") * 10 + F.col("l_orderkey") % 40 * 100).cast("long").alias("position")).agg(F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("m"))


CALLS_SQL = """calls AS (SELECT concat('chr', (l_orderkey % 5 + 1)::VARCHAR) AS chr, l_orderkey::VARCHAR AS qname, (l_linenumber * 10 + l_orderkey % 40 * 100)::BIGINT AS position,
  max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS m FROM lineitem GROUP BY 1, 2, 3)"""


def reads(spark, sf) -> DataFrame:
    """Raw reads: a call string, conversion tags and qualities per order."""
    d = table(spark, sf, "lineitem")
    code = F.element_at(F.array(*map(F.lit, "zZxXhHuU.")), (F.col("l_partkey") % 9 + 1).cast("int"))
    g = d.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", code.alias("c"), (F.col("l_quantity").cast("int") % 42).alias("q")))).alias("a"))
    k = F.col("l_orderkey")
    tag = lambda x: F.when(x == 0, "CT").otherwise("GA")
    return g.select(F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chr"), k.cast("string").alias("qname"), F.when(k % 50 != 0, k * STEP + k % 7 * 300 - 100).alias("pos"),
                    F.array_join("a.c", "").alias("xm"), tag(k % 2).alias("xr"), tag(k % 3 % 2).alias("xg"), F.col("a.q").alias("quals"))


READS_SQL = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'zZxXhHuU.'[l_partkey % 9 + 1], l_quantity::INT % 42) - 1 AS "offset" FROM lineitem),
raw AS (SELECT concat('chr', (l_orderkey % 5 + 1)::VARCHAR) AS chr, l_orderkey::VARCHAR AS qname, l_orderkey * {STEP} + l_orderkey % 7 * 300 - 100 + "offset" AS position, "offset", l_quantity::INT % 42 AS qual,
  'zZxXhHuU.'[l_partkey % 9 + 1] AS call, concat(CASE WHEN l_orderkey % 2 = 0 THEN 'CT' ELSE 'GA' END, CASE WHEN l_orderkey % 3 % 2 = 0 THEN 'CT' ELSE 'GA' END) AS conv,
  l_orderkey % 50 <> 0 AS aligned FROM lines),
bam AS (SELECT chr, qname, position, call, qual, CASE WHEN conv IN ('CTCT', 'GACT') THEN '+' ELSE '-' END AS strand,
  CASE lower(call) WHEN 'z' THEN 'CG' WHEN 'x' THEN 'CHG' ELSE 'CHH' END AS context, CASE WHEN call IN ('Z', 'X', 'H') THEN 1 ELSE 0 END AS m
  FROM raw WHERE aligned AND call NOT IN ('.', 'u', 'U') AND conv IN ('GACT', 'GAGA') AND qual > 5)"""


def vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e
