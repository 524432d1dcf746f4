"""Reports, annotations, regions and tests: each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binomial, genome, replicates
from ..sources import annotation, reports
from .fixtures import FLANK, GENOME_SQL, REG_SQL, cyt_sql, cytosines, r6, shown, table
from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UNI = "chr, strand, position, context, trinuc, count_m, count_total, CASE WHEN NOT isnan(density) THEN round(density, 6) END AS density"
COLS = ["chr", "strand", "position", "context", "trinuc", "count_m", "count_total"]


def uni(d):
    return d.select(*COLS, shown())


@query(f"WITH {cyt_sql()} SELECT {UNI} FROM cyt")
def scan_universal(spark, sf):
    return uni(reports.validated(cytosines(spark, sf)))


@query(f"WITH {cyt_sql()} SELECT {UNI} FROM cyt")
def scan_bismark(spark, sf):
    return uni(reports.from_bismark(reports.to_bismark(cytosines(spark, sf))))


@query(f"""WITH {cyt_sql()} SELECT chr, strand, position, context, CASE WHEN context = 'CG' THEN 'CG' ELSE 'CH' || right(context, 1) END AS trinuc,
  count_m, count_total, CASE WHEN NOT isnan(density) THEN round(density, 6) END AS density FROM cyt""")
def scan_cgmap(spark, sf):
    return uni(reports.from_cgmap(reports.to_cgmap(cytosines(spark, sf))))


def _index(c):
    return c.groupBy("chr", "position").agg(F.min("strand").alias("strand"), F.min("context").alias("context"))


INDEX = "ix AS (SELECT chr, position, min(strand) AS strand, min(context) AS context FROM cyt WHERE position % 3 <> 0 GROUP BY 1, 2)"


@query(f"""WITH {cyt_sql()}, {INDEX} SELECT c.chr, ix.strand, c.position, ix.context, ix.context AS trinuc, c.count_m, c.count_total, round(c.density, 6) AS density
  FROM cyt c LEFT JOIN ix ON c.chr = ix.chr AND c.position = ix.position WHERE c.count_total <> 0""")
def scan_coverage(spark, sf):
    c = cytosines(spark, sf)
    return uni(reports.from_coverage(reports.to_coverage(c).withColumnRenamed("start", "position"), _index(c.where("position % 3 <> 0"))))


@query(f"""WITH {cyt_sql()}, ix AS (SELECT chr, position, min(strand) AS strand, min(context) AS context FROM cyt GROUP BY 1, 2), b AS (SELECT *, count_m / count_total * 100 / 100.0 AS x FROM cyt WHERE count_total <> 0),
r AS (SELECT *, list_min(list_transform(range(1, 101), lambda k: {{'off': round(abs(x - floor(x * k + 0.5) / k), 12), 'total': k, 'm': floor(x * k + 0.5)::BIGINT}})) AS r FROM b)
SELECT r.chr, ix.strand, r.position, ix.context, ix.context AS trinuc, r.r.m::BIGINT AS count_m, r.r.total::BIGINT AS count_total, round(x, 6) AS density FROM r LEFT JOIN ix ON r.chr = ix.chr AND r.position = ix.position""")
def scan_bedgraph(spark, sf):
    c = cytosines(spark, sf)
    d = reports.to_bedgraph(c).withColumn("density", F.col("density") * 100)
    return uni(reports.from_bedgraph(d, _index(c)))


BINOM_P = """p0 AS (SELECT avg(density) AS p FROM cyt WHERE NOT isnan(density)), lg AS (SELECT chr, strand, position, context, count_m AS m, count_total AS n, p
  FROM cyt, p0 WHERE count_total >= 2),
pv AS (SELECT chr, strand, position, context, CASE WHEN m <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(m, n + 1),
  lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))))) END AS p_value FROM lg)"""


@query(f"WITH {cyt_sql()}, {BINOM_P} SELECT chr, strand, position, context, round(p_value, 6) AS p_value FROM pv")
def binom_pvalue(spark, sf):
    return binomial.site_pvalues(cytosines(spark, sf)).withColumn("p_value", r6("p_value"))


@query(f"""WITH {cyt_sql()}, {BINOM_P} SELECT chr, strand, position, context, context AS trinuc, (round(p_value, 6) <= 0.05)::BIGINT AS count_m, 1::BIGINT AS count_total,
  (round(p_value, 6) <= 0.05)::BIGINT::DOUBLE AS density FROM pv""")
def scan_binom(spark, sf):
    return uni(reports.from_binom(binom_pvalue(spark, sf)))


@query("SELECT l_orderkey, l_tax FROM lineitem")
def parquet_project(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_tax")


@query("WITH " + GENOME_SQL + """ SELECT chr, type, start, "end", strand, CASE WHEN start % 700 <> 0 THEN id END AS id FROM genome""")
def scan_gff(spark, sf):
    g = fx.genome(spark, sf)
    attributes = F.when(F.col("start") % 700 != 0, F.concat(F.lit("ID="), "id", F.lit(";Name=x"))).otherwise("Name=y;ID=no")
    return annotation.from_gff_rows(g.withColumn("attributes", attributes))


@query("WITH " + GENOME_SQL + """ SELECT chr, '' AS type, start, "end", strand, id FROM genome WHERE type = 'exon'""")
def scan_regions_custom(spark, sf):
    g = fx.genome(spark, sf).select("id", "chr", "start", "end", "strand", "type")
    return annotation.from_columns(g, chr=1, start=2, end=3, strand=4, id=0, where=F.col("type") == "exon")


@query(f"""WITH {cyt_sql('c0', 'l_suppkey % 2 = 0')}, {cyt_sql('c1', 'l_suppkey % 2 = 1')}, a AS (SELECT 0 AS r, * FROM c0 UNION ALL SELECT 1, * FROM c1),
f AS (SELECT *, row_number() OVER (PARTITION BY chr, position ORDER BY r, strand, context, trinuc) AS k FROM a),
s AS (SELECT chr, position, sum(count_m)::BIGINT AS count_m, sum(count_total)::BIGINT AS count_total FROM a GROUP BY 1, 2)
SELECT s.chr, f.strand, s.position, f.context, f.trinuc, s.count_m, s.count_total, CASE WHEN s.count_total <> 0 THEN round(s.count_m / s.count_total, 6) END AS density
FROM s JOIN f ON s.chr = f.chr AND s.position = f.position AND f.k = 1""")
def replicates_merge(spark, sf):
    return uni(replicates.merge([cytosines(spark, sf, i) for i in (0, 1)]))


SEQ_SQL = r"""sq AS (SELECT doc_id::VARCHAR AS chr, upper(regexp_replace(text, '[^A-Za-z]', 'N', 'g')) AS s FROM documents),
b AS (SELECT chr, s, unnest(range(1, length(s) + 1)) AS position FROM sq WHERE length(s) >= 3)"""


@query(rf"""WITH {SEQ_SQL},
x AS (SELECT chr, position, s[position] AS c, s[position:position + 2] AS ahead, s[greatest(position - 2, 1):greatest(position - 2, 1) + 2] AS behind, length(s) AS n FROM b)
SELECT chr, position::BIGINT AS position, true AS strand, CASE WHEN ahead[2] = 'G' THEN 'CG' WHEN ahead[3] = 'G' THEN 'CHG' ELSE 'CHH' END AS context, ahead AS trinuc FROM x WHERE c = 'C' AND position <= n - 2
UNION ALL SELECT chr, position::BIGINT, false, CASE WHEN behind[2] = 'C' THEN 'CG' WHEN behind[1] = 'C' THEN 'CHG' ELSE 'CHH' END,
  reverse(translate(replace(behind, 'M', ''), 'ATGCURYKBDHVN', 'TACGRUKYNNNNN')) FROM x WHERE c = 'G' AND position >= 3""")
def cytosine_index(spark, sf):
    d = table(spark, sf, "documents")
    return annotation.cytosines(d.select(F.col("doc_id").cast("string").alias("chr"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "N")).alias("sequence")))


@query(f"WITH {cyt_sql()} SELECT chr, position, strand, count_m, count_total - count_m AS count_um, context, trinuc FROM cyt")
def to_bismark(spark, sf):
    return reports.to_bismark(cytosines(spark, sf))


@query(f"""WITH {cyt_sql()} SELECT chr, CASE WHEN strand = '+' THEN 'C' ELSE 'G' END AS nuc, position, context, trinuc[1:2] AS dinuc,
  CASE WHEN NOT isnan(density) THEN round(density, 6) END AS density, count_m, count_total FROM cyt""")
def to_cgmap(spark, sf):
    return reports.to_cgmap(cytosines(spark, sf)).withColumn("density", shown())


@query(f"""WITH {cyt_sql()} SELECT chr, position AS start, position + 1 AS "end", round(density, 6) AS density, count_m, count_total - count_m AS count_um FROM cyt WHERE count_total <> 0""")
def to_coverage(spark, sf):
    return reports.to_coverage(cytosines(spark, sf)).withColumn("density", shown())


@query(f"""WITH {cyt_sql()} SELECT chr, position - 1 AS start, position AS "end", round(density, 6) AS density FROM cyt WHERE count_total <> 0""")
def to_bedgraph(spark, sf):
    return reports.to_bedgraph(cytosines(spark, sf)).withColumn("density", shown())


@query(f"WITH {cyt_sql()} SELECT {UNI} FROM cyt WHERE NOT isnan(density)")
def filter_covered(spark, sf):
    return uni(reports.filter_covered(cytosines(spark, sf)))


@query(f"WITH {cyt_sql()} SELECT {UNI} FROM cyt WHERE context = 'CG' AND strand = '-'")
def filter_generic(spark, sf):
    return uni(reports.filter_equal(cytosines(spark, sf), context="CG", strand="-"))


@query(f"WITH {cyt_sql()} SELECT {UNI} FROM cyt WHERE count_total >= 10")
def filter_min_cov(spark, sf):
    return uni(cytosines(spark, sf).where("count_total >= 10"))


def _regions(name, build, select, where):
    @query(f"WITH {GENOME_SQL} SELECT {select} FROM genome WHERE {where}")
    def q(spark, sf):
        return build(fx.genome(spark, sf))

    QUERIES[name] = QUERIES.pop("q")
    ORACLES[name] = ORACLES.pop("q")


def _flanked(f):
    return f'chr, strand, start, "end", start - {f} AS upstream, "end" + {f} AS downstream, id'


_regions("regions_filter", lambda g: genome.select_type(g, "gene", 3000, 500), "*", """type = 'gene' AND start > 500 AND "end" - start > 3000""")
_regions("genome_all", lambda g: genome.all_regions(g, 500, 100), _flanked(100), """start > 100 AND "end" - start > 500""")
_regions("genome_gene_body", lambda g: genome.gene_body(g, 0, 2000), _flanked(2000), """type = 'gene' AND start > 2000 AND "end" - start > 0""")
_regions("genome_exon", lambda g: genome.exon(g, 100), _flanked(0), """type = 'exon' AND start > 0 AND "end" - start > 100""")
_regions("genome_cds", lambda g: genome.cds(g, 100), _flanked(0), """type = 'CDS' AND start > 0 AND "end" - start > 100""")
_regions("genome_other", lambda g: genome.other(g, "exon", 700, 100), _flanked(100), """type = 'exon' AND start > 100 AND "end" - start > 700""")
_regions("genome_near_tss", lambda g: genome.near_tss(g, 4000, 2000), 'chr, strand, start, start + 2000 AS "end", start - 2000 AS upstream, start + 2000 AS downstream, id',
         """type = 'gene' AND start > 2000 AND "end" - start > 4000""")
_regions("genome_near_tes", lambda g: genome.near_tes(g, 4000, 2000), 'chr, strand, "end" - 2000 AS start, "end", "end" - 2000 AS upstream, "end" + 2000 AS downstream, id',
         """type = 'gene' AND start > 2000 AND "end" - start > 4000""")
_regions("genome_neighbour_gap", lambda g: genome.neighbour_gap(g.where("type = 'gene'")),
         """chr, strand, start, "end", id, lead(start) OVER w - "end" AS gap_after, start - lag("end") OVER w AS gap_before""",
         "type = 'gene' WINDOW w AS (PARTITION BY chr, strand ORDER BY start, id)")
_regions("genome_inverted", lambda g: genome.oriented(g.where("type = 'gene'").withColumn("s", F.col("start")).withColumn("start", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))
                                                      .withColumn("end", F.when(F.col("strand") == "-", F.col("s")).otherwise(F.col("end"))).drop("s")),
         """chr, type, start, "end", CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand, id""", "type = 'gene'")


@query(f"WITH {cyt_sql()} SELECT count(*)::BIGINT AS n_sites, round(avg(density), 6) AS p FROM cyt WHERE NOT isnan(density)")
def binom_total_stats(spark, sf):
    return binomial.total_stats(cytosines(spark, sf)).withColumn("p", r6("p"))


@query(f"WITH {cyt_sql()} SELECT context, sum(count_m)::BIGINT AS m, sum(count_total)::BIGINT AS total, round(sum(count_m) / sum(count_total), 6) AS p FROM cyt GROUP BY 1")
def binom_context_stats(spark, sf):
    return binomial.context_stats(cytosines(spark, sf)).withColumn("p", r6("p"))


RC_SQL = f"""{cyt_sql()}, {REG_SQL}, rc AS (SELECT r.chr, r.strand, r.start, r."end", r.id, c.context, sum(c.count_m)::BIGINT AS count_m, sum(c.count_total)::BIGINT AS count_total
  FROM cyt c ASOF JOIN reg r ON c.chr = r.chr AND c.position >= r.start WHERE c.position <= r.downstream AND (r.strand = '.' OR r.strand = c.strand) GROUP BY ALL)"""
RP_SQL = RC_SQL + """, cs AS (SELECT context, sum(count_m) / sum(count_total) AS p FROM cyt GROUP BY 1),
rp AS (SELECT rc.*, CASE WHEN count_m <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(count_m, count_total + 1), lambda k: exp(lgamma(count_total + 1) - lgamma(k + 1)
  - lgamma(count_total - k + 1) + k * ln(p) + (count_total - k) * ln(1 - p))))) END AS p_value FROM rc JOIN cs USING (context))"""
WIDE_SQL = RP_SQL + """, uq AS (SELECT *, count(*) OVER (PARTITION BY chr, strand, start, "end", context) AS k FROM rp), wd AS (SELECT chr, strand, start, "end", id,
  """ + ", ".join(f"max(CASE WHEN context = '{c}' THEN {'round(p_value, 6)' if m == 'p_value' else m} END) AS {m}_context_{c}" for m in ("p_value", "count_m", "count_total") for c in binomial.CONTEXTS) + """
  FROM uq WHERE k = 1 GROUP BY ALL)"""


def _region_frame(spark, sf):
    return genome.gene_body(fx.genome(spark, sf), 0, FLANK)


@query(f"WITH {RC_SQL} SELECT * FROM rc")
def region_counts(spark, sf):
    return binomial.region_counts(cytosines(spark, sf), _region_frame(spark, sf))


@query(f"""WITH {RC_SQL} SELECT chr, strand, start, "end", id, sum(count_total)::BIGINT AS n FROM rc GROUP BY ALL""")
def asof_region_start(spark, sf):
    return region_counts(spark, sf).groupBy("chr", "strand", "start", "end", "id").agg(F.sum("count_total").alias("n"))


@query(f"WITH {RP_SQL} SELECT * REPLACE (round(p_value, 6) AS p_value) FROM rp")
def region_pvalue(spark, sf):
    return binomial.region_pvalues(cytosines(spark, sf), _region_frame(spark, sf)).withColumn("p_value", r6("p_value"))


@query(f"""WITH {RC_SQL}, d AS (SELECT * FROM rc UNION ALL SELECT * FROM rc WHERE start % 300 = 0) SELECT chr, strand, start, "end", id, context, count_m, count_total
  FROM (SELECT *, count(*) OVER (PARTITION BY chr, strand, start, "end", context) AS k FROM d) WHERE k = 1""")
def region_dedup(spark, sf):
    d = region_counts(spark, sf)
    return binomial.without_duplicates(d.union(d.where("start % 300 = 0")))


@query(f"WITH {WIDE_SQL} SELECT * FROM wd")
def region_pivot(spark, sf):
    return binomial.wide(region_pvalue(spark, sf))


@query(f"WITH {WIDE_SQL} SELECT * FROM wd WHERE p_value_context_CG < 0.5 AND count_total_context_CG >= 20")
def region_filter(spark, sf):
    return binomial.region_filter(region_pivot(spark, sf), "CG", "<", 0.5, 20)


@query(f"""WITH {WIDE_SQL} SELECT *, CASE WHEN p_value_context_CG < 0.2 THEN 'BM' WHEN p_value_context_CG >= 1 - 0.2 THEN 'UM' ELSE 'IM' END AS category FROM wd
  WHERE count_total_context_CG >= 20 AND p_value_context_CHG >= 0.2 AND p_value_context_CHH >= 0.2 AND p_value_context_CG IS NOT NULL""")
def categorise(spark, sf):
    return binomial.categorise(region_pivot(spark, sf), "CG", 0.2, 20)
