"""Overlaps, alignment, and single reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrichment as en
from ..operators import joins, reads
from . import fixtures as fx
from .fixtures import CALLS_SQL, DMR_SQL, GENOME_SQL, READS_SQL, REG_SQL, r6

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


OV = f"""{GENOME_SQL}, {DMR_SQL}, ov AS (SELECT d.chr, d.start, d."end", g.type, g.id, greatest(d.start, g.start) AS ov_start, least(d."end", g."end") AS ov_end
  FROM dmr d JOIN genome g ON d.chr = g.chr AND d.start < g."end" AND g.start < d."end")"""


@query(f"WITH {OV} SELECT * FROM ov")
def interval_overlap(spark, sf):
    d = joins.interval_overlap(fx.dmr(spark, sf), fx.genome(spark, sf))
    return d.select("chr", "start", "end", F.col("r_type").alias("type"), F.col("r_id").alias("id"), "ov_start", "ov_end")


EN = OV + """, tl AS (SELECT type, sum("end" - start) AS length FROM genome GROUP BY 1), al AS (SELECT type, sum(ov_end - ov_start) AS overlap FROM ov GROUP BY 1),
bt AS (SELECT type, overlap, length FROM al JOIN tl USING (type)),
tt AS (SELECT (SELECT sum("end" - start) FROM dmr) AS total, (SELECT sum(l) FROM (SELECT max("end") - min(start) AS l FROM genome GROUP BY chr)) AS genome,
  (SELECT coalesce(sum(overlap), 0) FROM bt WHERE type = 'gene') AS go, (SELECT coalesce(sum(length), 0) FROM bt WHERE type = 'gene') AS gl,
  (SELECT coalesce(sum(overlap), 0) FROM bt WHERE type = 'CDS') AS co, (SELECT coalesce(sum(length), 0) FROM bt WHERE type = 'CDS') AS cl),
al2 AS (SELECT * FROM bt UNION ALL SELECT 'NCDS', go - co, gl - cl FROM tt UNION ALL
  SELECT 'intergene', (SELECT coalesce(sum("end" - start), 0) FROM dmr d WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.chr = d.chr AND ov.start = d.start AND ov."end" = d."end")), genome - gl FROM tt),
ec AS (SELECT type, length::BIGINT AS length, overlap::BIGINT AS overlap, round(log2(overlap / total) - log2(length / genome), 6) AS enrichment FROM al2, tt WHERE overlap > 0 AND length > 0)"""


@query(f"WITH {EN} SELECT * FROM ec")
def enrichment(spark, sf):
    return en.enrich(fx.dmr(spark, sf), fx.genome(spark, sf)).withColumn("enrichment", r6("enrichment"))


@query(f"WITH {EN} SELECT * FROM ec WHERE type NOT IN ('exon', 'NCDS')")
def enrich_exclude(spark, sf):
    return en.without_types(enrichment(spark, sf), ["exon", "NCDS"])


@query(f"WITH {EN} SELECT overlap FROM ec WHERE type = 'intergene'")
def enrich_intergene(spark, sf):
    return enrichment(spark, sf).where("type = 'intergene'").select("overlap")


@query(f"""WITH {GENOME_SQL} SELECT type, sum("end" - start)::BIGINT AS length FROM genome GROUP BY 1""")
def enrich_type_lengths(spark, sf):
    return en.type_lengths(fx.genome(spark, sf))


@query(f"""WITH {GENOME_SQL} SELECT chr, (max("end") - min(start))::BIGINT AS length FROM genome GROUP BY 1""")
def enrich_chr_lengths(spark, sf):
    return en.chr_lengths(fx.genome(spark, sf))


@query(f"""WITH {GENOME_SQL} SELECT chr, CASE WHEN strand = '-' THEN 'downstream' ELSE 'upstream' END AS type, start - 300 AS start, start AS "end", strand, id FROM genome WHERE type = 'gene'
UNION ALL SELECT chr, CASE WHEN strand = '-' THEN 'upstream' ELSE 'downstream' END, "end", "end" + 300, strand, id FROM genome WHERE type = 'gene'""")
def enrich_flanks(spark, sf):
    return en.flank_features(fx.genome(spark, sf), 300)


NEAR = f"""{GENOME_SQL}, {DMR_SQL}, a AS (SELECT chr, start, "end", ((start + "end") // 2) AS mid FROM dmr), g AS (SELECT chr, start, "end", strand, id, ((start + "end") // 2) AS mid FROM genome WHERE type = 'gene' QUALIFY row_number() OVER (PARTITION BY chr, (start + "end") // 2 ORDER BY id) = 1),
lo AS (SELECT a.chr, a.start, a."end", a.mid, g.id AS id, g.mid AS gm, g.start AS gs, g."end" AS ge, g.strand AS st FROM a ASOF LEFT JOIN g ON a.chr = g.chr AND a.mid >= g.mid),
hi AS (SELECT a.chr, a.start, a."end", a.mid, g.id AS id, g.mid AS gm, g.start AS gs, g."end" AS ge, g.strand AS st FROM a ASOF LEFT JOIN g ON a.chr = g.chr AND a.mid <= g.mid),
nn AS (SELECT lo.chr, lo.start, lo."end", lo.mid, CASE WHEN k THEN lo.id ELSE hi.id END AS id, CASE WHEN k THEN lo.gs ELSE hi.gs END AS gs, CASE WHEN k THEN lo.ge ELSE hi.ge END AS ge, CASE WHEN k THEN lo.st ELSE hi.st END AS st
  FROM (SELECT lo.*, hi.gm IS NULL OR coalesce(lo.mid - lo.gm <= hi.gm - lo.mid, false) AS k FROM lo JOIN hi ON lo.chr = hi.chr AND lo.start = hi.start AND lo."end" = hi."end") lo
  JOIN hi ON lo.chr = hi.chr AND lo.start = hi.start AND lo."end" = hi."end"),
al AS (SELECT *, CASE WHEN mid BETWEEN gs AND ge THEN 'gene_body' WHEN mid BETWEEN gs - 2000 AND gs THEN CASE WHEN st = '-' THEN 'downstream' ELSE 'upstream' END
  WHEN mid BETWEEN ge AND ge + 2000 THEN CASE WHEN st = '-' THEN 'upstream' ELSE 'downstream' END ELSE 'intergene' END AS target FROM nn)"""


def _aligned(spark, sf):
    return en.align(fx.dmr(spark, sf), fx.genome(spark, sf).where("type = 'gene'"), 2000)


@query(f"""WITH {NEAR} SELECT chr, start, "end", id FROM nn""")
def asof_nearest(spark, sf):
    return _aligned(spark, sf).select("chr", "start", "end", F.col("r_id").alias("id"))


@query(f"""WITH {NEAR} SELECT chr, start, "end", id, target FROM al""")
def align_regions(spark, sf):
    return _aligned(spark, sf).select("chr", "start", "end", F.col("r_id").alias("id"), "target")


@query(f"""WITH {NEAR} SELECT target, count(*)::BIGINT AS n, round(avg("end" - start), 6) AS mean_length FROM al GROUP BY 1""")
def align_stats(spark, sf):
    return en.align_stats(_aligned(spark, sf)).withColumn("mean_length", r6("mean_length"))


@query(f"WITH {NEAR} SELECT DISTINCT id FROM al WHERE target = 'gene_body'")
def align_ids(spark, sf):
    return _aligned(spark, sf).where("target = 'gene_body'").select(F.col("r_id").alias("id")).distinct()


POS = NEAR + """, e AS (SELECT st, CASE WHEN start < gs THEN (start - gs) / 2000 WHEN start > ge THEN 1 + (start - ge) / 2000 ELSE (start - gs) / (ge - gs) END AS x,
  CASE WHEN "end" < gs THEN ("end" - gs) / 2000 WHEN "end" > ge THEN 1 + ("end" - ge) / 2000 ELSE ("end" - gs) / (ge - gs) END AS y FROM al WHERE target <> 'intergene'),
st AS (SELECT CASE WHEN st = '-' THEN 1 - y ELSE x END AS pos, 1 AS step FROM e UNION ALL SELECT CASE WHEN st = '-' THEN 1 - x ELSE y END, -1 FROM e)"""


@query(f"WITH {POS} SELECT round(pos, 6) AS pos, step FROM st")
def align_ref_positions(spark, sf):
    return en.relative_positions(_aligned(spark, sf), 2000).select(r6("pos").alias("pos"), "step")


FLANKS_SQL = """ff AS (SELECT chr, CASE WHEN strand = '-' THEN 'downstream' ELSE 'upstream' END AS type, start - 1500 AS start, start AS "end", strand FROM genome WHERE type = 'gene'
  UNION ALL SELECT chr, CASE WHEN strand = '-' THEN 'upstream' ELSE 'downstream' END, "end", "end" + 1500, strand FROM genome WHERE type = 'gene'
  UNION ALL SELECT chr, type, start, "end", strand FROM genome WHERE type = 'gene')"""


@query(f"""WITH {GENOME_SQL}, {DMR_SQL}, {FLANKS_SQL},
o AS (SELECT f.type, f.strand, f.start AS gs, f."end" AS ge, greatest(d.start, f.start) AS a, least(d."end", f."end") AS b FROM dmr d JOIN ff f ON d.chr = f.chr AND d.start < f."end" AND f.start < d."end"),
p AS (SELECT CASE WHEN strand = '-' THEN ge - b ELSE a - gs END / (ge - gs) + CASE type WHEN 'upstream' THEN -1 WHEN 'downstream' THEN 1 ELSE 0 END AS x,
  CASE WHEN strand = '-' THEN ge - a ELSE b - gs END / (ge - gs) + CASE type WHEN 'upstream' THEN -1 WHEN 'downstream' THEN 1 ELSE 0 END AS y FROM o)
SELECT round(x, 6) AS pos, 1 AS step FROM p WHERE x >= -1 AND y <= 2 UNION ALL SELECT round(y, 6), -1 FROM p WHERE x >= -1 AND y <= 2""")
def enrich_ref_positions(spark, sf):
    return en.overlap_positions(fx.dmr(spark, sf), fx.genome(spark, sf), 1500).select(r6("pos").alias("pos"), "step")


CELLS = """k AS (SELECT greatest(round(round(pos, 6) / 0.01)::BIGINT, -101) AS k, sum(step)::BIGINT AS step FROM st GROUP BY 1), c AS (SELECT k, sum(step) OVER (ORDER BY k)::BIGINT AS depth FROM k)"""


@query(f"""WITH {POS}, {CELLS} SELECT round(k * 0.01, 6) AS pos, depth FROM c WHERE k BETWEEN -100 AND 200""")
def metagene_coverage(spark, sf):
    # cells are hundredths, so two decimals hold a position exactly, as in the SQL
    return en.coverage(align_ref_positions(spark, sf)).select(F.col("pos").cast("decimal(21,2)").alias("pos"), "depth")


@query(f"""WITH {POS}, {CELLS}, w AS (SELECT CASE floor(k / 100) WHEN -1 THEN (k + 100) * 10 // 100 WHEN 0 THEN 10 + k * 15 // 100 ELSE 25 + (k - 100) * 10 // 100 END::BIGINT AS "window", depth FROM c WHERE k BETWEEN -100 AND 199),
av AS (SELECT "window", avg(depth) AS depth FROM w GROUP BY 1) SELECT r.range::BIGINT AS "window", round(coalesce(depth, 0), 6) AS depth FROM range(35) r LEFT JOIN av ON r.range = av."window" """)
def coverage_resampled(spark, sf):
    return en.resampled(metagene_coverage(spark, sf), 10, 15).withColumn("depth", r6("depth"))


@query(f"WITH {READS_SQL} SELECT chr, qname, position, call, qual::INT AS qual, strand, context, m FROM bam")
def bam_calls(spark, sf):
    d = reads.decoded(reads.exploded_calls(fx.reads(spark, sf)), min_qual=5, keep_converted=False)
    return d.select("chr", "qname", "position", "call", "qual", "strand", "context", "m")


@query(f"WITH {READS_SQL} SELECT chr, position, sum(m)::BIGINT AS count_m, count(m)::BIGINT AS count_total, min(context) AS context, min(strand) AS strand FROM bam GROUP BY 1, 2")
def bam_position_counts(spark, sf):
    return reads.position_counts(bam_calls(spark, sf))


@query(f"WITH {READS_SQL}, {REG_SQL} SELECT b.chr, b.qname, b.position, b.m, r.id AS region FROM bam b JOIN reg r ON b.chr = r.chr AND b.position BETWEEN r.upstream AND r.downstream")
def bam_region_filter(spark, sf):
    from ..operators.genome import gene_body

    return reads.in_regions(bam_calls(spark, sf), gene_body(fx.genome(spark, sf), 0, fx.FLANK)).select("chr", "qname", "position", "m", "region")


@query(f"""WITH {READS_SQL}, d AS (SELECT chr, (position // 3)::VARCHAR AS qname, position // 2 AS position, call, qual, m FROM bam)
SELECT chr, qname, position, call, qual::INT AS qual, m FROM (SELECT *, row_number() OVER (PARTITION BY chr, qname, position ORDER BY qual DESC, call) AS k FROM d) WHERE k = 1""")
def bam_dedup(spark, sf):
    d = bam_calls(spark, sf).select("chr", F.floor(F.col("position") / 3).cast("string").alias("qname"), F.floor(F.col("position") / 2).alias("position"), "call", "qual", "m")
    return reads.deduplicated(d)


@query(f"""WITH {READS_SQL}, ix AS (SELECT DISTINCT chr, position FROM raw WHERE aligned), c AS (SELECT chr, position, sum(m)::BIGINT AS m, count(m)::BIGINT AS n FROM bam GROUP BY 1, 2)
SELECT ix.chr, ix.position, coalesce(m, 0)::BIGINT AS count_m, coalesce(n, 0)::BIGINT AS count_total, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE m / n END, 6) AS density FROM ix LEFT JOIN c ON ix.chr = c.chr AND ix.position = c.position""")
def bam_full_report(spark, sf):
    r = fx.reads(spark, sf).where("pos is not null")
    index = r.select("chr", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.length("xm") - 1)).alias("position")).distinct()
    return reads.full_report(index, bam_position_counts(spark, sf)).withColumn("density", r6("density"))


@query(f"WITH {READS_SQL} SELECT qual::INT AS qual, count(*)::BIGINT AS n FROM raw GROUP BY 1")
def bam_qc_hist(spark, sf):
    return reads.quality_histogram(fx.reads(spark, sf))


@query(f"""WITH {READS_SQL} SELECT "offset"::INT AS "offset", qual::INT AS qual, count(*)::BIGINT AS n FROM raw GROUP BY 1, 2""")
def bam_qc_by_offset(spark, sf):
    return reads.quality_histogram(fx.reads(spark, sf), by_offset=True)


@query(f"""WITH {READS_SQL}, r AS (SELECT chr, qname, min(position) - min("offset") AS pos, avg(qual) AS q FROM raw WHERE aligned GROUP BY 1, 2)
SELECT chr, floor(pos / 1000000)::BIGINT AS slab, count(*)::BIGINT AS reads, round(avg(q), 6) AS mean_qual FROM r GROUP BY 1, 2""")
def bam_qc_slabs(spark, sf):
    return reads.per_slab(fx.reads(spark, sf)).withColumn("mean_qual", r6("mean_qual"))


@query(f"""WITH {READS_SQL} SELECT "offset"::INT AS "offset", round(avg(qual), 6) AS mean_qual, count(*)::BIGINT AS n FROM raw GROUP BY 1""")
def bam_qc_by_pos(spark, sf):
    return reads.quality_by_offset(fx.reads(spark, sf)).withColumn("mean_qual", r6("mean_qual"))


PAT = f"""{CALLS_SQL}, ps AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY position) AS k FROM (SELECT DISTINCT chr, position FROM calls)),
cn AS (SELECT c.*, ps.k FROM calls c JOIN ps USING (chr, position)),
wn AS (SELECT a.chr, a.k AS "window", a.position AS first, a.qname, string_agg(b.m::VARCHAR, '' ORDER BY b.k) AS pattern, max(b.position) AS last FROM cn a JOIN cn b ON a.chr = b.chr AND a.qname = b.qname AND b.k BETWEEN a.k AND a.k + 3
  GROUP BY 1, 2, 3, 4 HAVING count(*) = 4),
pn AS (SELECT chr, "window", first, last, pattern, count(*) AS n FROM wn GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY chr, "window") AS share, sum(n) OVER (PARTITION BY chr, "window") AS depth FROM pn)"""


@query(f"""WITH {PAT} SELECT chr, "window", first, last, round(abs(sum(share * log2(share)) / 4), 6) AS entropy, max(depth)::BIGINT AS depth FROM sh WHERE depth >= 4 GROUP BY 1, 2, 3, 4""")
def methylation_entropy(spark, sf):
    return reads.methylation_entropy(fx.calls(spark, sf)).drop("positions").withColumn("entropy", r6("entropy")).withColumn("window", F.col("window").cast("long"))


@query(f"""WITH {PAT} SELECT chr, "window", first, last, round(1 - sum(share * share), 6) AS epipolymorphism, max(depth)::BIGINT AS depth FROM sh WHERE depth >= 4 GROUP BY 1, 2, 3, 4""")
def epipolymorphism(spark, sf):
    return reads.epipolymorphism(fx.calls(spark, sf)).drop("positions").withColumn("epipolymorphism", r6("epipolymorphism")).withColumn("window", F.col("window").cast("long"))


@query(f"""WITH {CALLS_SQL}, r AS (SELECT chr, qname, min(m) = max(m) AS same, count(*) AS n FROM calls GROUP BY 1, 2)
SELECT chr, position, count(*) FILTER (same)::BIGINT AS concordant, count(*) FILTER (NOT same)::BIGINT AS discordant, round(count(*) FILTER (NOT same) / count(*), 6) AS pdr
FROM calls JOIN r USING (chr, qname) WHERE r.n >= 4 GROUP BY 1, 2""")
def pdr(spark, sf):
    return reads.discordant_reads(fx.calls(spark, sf)).withColumn("pdr", r6("pdr"))
