"""Metagenes and chromosome levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chromosomes, clusters, metagene
from ..operators.genome import gene_body
from . import fixtures as fx
from .fixtures import BODY, DOWN, FLANK, PLACED_SQL, REG_SQL, UP, cyt_sql, cytosines, mg_sql, r6

QUERIES, ORACLES = {}, {}
MG = ["chr", "strand", "start", "gene", "id", "context", "fragment", "sum", "count"]
SHOW = 'chr, strand, start, gene, id, context, fragment, round(sum, 6) AS sum, count'


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def frame(spark, sf):
    return gene_body(fx.genome(spark, sf), 0, FLANK)


def base(spark, sf, summary="wmean", replicate=None, of=2):
    return metagene.metagene(cytosines(spark, sf, replicate, of), frame(spark, sf), UP, BODY, DOWN, summary)


def show(d):
    return d.select(*MG).withColumn("sum", r6("sum"))


for _name, _sum, _count in (("wmean", "sum(density)", "count(density)"), ("mean", "avg(density)", "1"), ("median", "median(density)", "1"), ("min", "min(density)", "1"),
                            ("max", "max(density)", "1"), ("1pgeom", "exp(avg(ln(1 + density))) - 1", "1")):
    QUERIES[f"metagene_{_name}"] = lambda spark, sf, s=_name: show(base(spark, sf, s).df)
    ORACLES[f"metagene_{_name}"] = f"WITH {mg_sql(_sum, _count)} SELECT {SHOW} FROM mg"


@query(f"""WITH {cyt_sql()}, {REG_SQL}, {PLACED_SQL} SELECT chr, position, context, round(density, 6) AS density, strand, start, "end", id FROM placed""")
def asof_backward(spark, sf):
    d = metagene.placed(cytosines(spark, sf), frame(spark, sf))
    return d.select("chr", "position", "context", r6("density").alias("density"), F.col("r_strand").alias("strand"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_id").alias("id"))


@query(f"WITH {cyt_sql()}, {REG_SQL}, {PLACED_SQL} SELECT fragment, count(*)::BIGINT AS n FROM frag GROUP BY 1")
def metagene_fragments(spark, sf):
    d = metagene.placed(cytosines(spark, sf), frame(spark, sf))
    return d.groupBy(metagene.fragment(UP, BODY, DOWN).cast("long").alias("fragment")).agg(F.count("*").alias("n"))


@query(f"WITH {mg_sql()} SELECT {SHOW} FROM mg WHERE context = 'CG' AND strand = '+' AND chr = 'chr1'")
def metagene_filter_context(spark, sf):
    return show(metagene.filtered(base(spark, sf), context="CG", strand="+", chr="chr1").df)


@query(f"WITH {mg_sql()} SELECT {SHOW} FROM mg SEMI JOIN (SELECT * FROM genome WHERE type = 'gene' AND start % 6000 = 0) g ON mg.chr = g.chr AND mg.start = g.start")
def metagene_filter_genome(spark, sf):
    g = fx.genome(spark, sf).where("type = 'gene' and start % 6000 = 0")
    return show(metagene.filtered(base(spark, sf), genome=g).df)


@query(f"WITH {mg_sql()} SELECT {SHOW} FROM mg WHERE id IN ('o15', 'o16', 'o17', 'o115', 'o216')")
def metagene_filter_ids(spark, sf):
    return show(metagene.filtered(base(spark, sf), ids=["o15", "o16", "o17", "o115", "o216"]).df)


@query(f"WITH {mg_sql()} SELECT chr, strand, start, gene, id, context, fragment - {UP} AS fragment, round(sum, 6) AS sum, count FROM mg WHERE fragment < {UP + BODY} AND fragment > {UP - 1}")
def metagene_trim_flank(spark, sf):
    return show(metagene.trim_flank(base(spark, sf)).df)


@query(f"""WITH {mg_sql()} SELECT chr, strand, start, gene, id, context, floor(fragment / {UP + BODY + DOWN} * 20)::BIGINT AS fragment, round(sum(sum), 6) AS sum, sum(count)::BIGINT AS count
  FROM mg GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7"))
def metagene_resize(spark, sf):
    return show(metagene.resize(base(spark, sf), 20).df)


def samples_sql(n=2):
    parts = []
    for i in range(n):
        s = mg_sql().replace("mg AS", f"mg{i} AS").replace("FROM frag ", f"FROM frag{i} ").replace("frag AS", f"frag{i} AS").replace("FROM placed)", f"FROM placed{i})").replace("placed AS", f"placed{i} AS")
        s = s.replace("cyt AS", f"cyt{i} AS").replace("FROM cyt WHERE count_total", f"FROM cyt{i} WHERE count_total").replace("WHERE true GROUP", f"WHERE l_suppkey % {n} = {i} GROUP")
        parts.append(s if i == 0 else s.replace(REG_SQL + ", ", ""))
    return ", ".join(parts) + ", ms AS (" + " UNION ALL ".join(f"SELECT 's{i}' AS label, * FROM mg{i}" for i in range(n)) + ")"


def samples(spark, sf, n=2):
    return {f"s{i}": base(spark, sf, replicate=i, of=n) for i in range(n)}


@query(f"WITH {samples_sql()} SELECT chr, strand, start, gene, id, context, fragment, round(sum(sum), 6) AS sum, sum(count)::BIGINT AS count FROM ms GROUP BY 1, 2, 3, 4, 5, 6, 7")
def metagene_merge(spark, sf):
    return show(metagene.merged(list(samples(spark, sf).values())).df)


FWD = "fw AS (SELECT * REPLACE (CASE WHEN strand = '-' THEN (SELECT max(fragment) FROM mg) - fragment ELSE fragment END AS fragment) FROM mg)"
for _stat, _sql in (("wmean", "sum(sum) / sum(count)"), ("mean", "avg(sum / count)"), ("log", "exp(avg(ln(1 + sum / count))) - 1"), ("wlog", "exp(sum(ln(1 + sum / count) * count) / sum(count)) - 1"),
                    ("quantile", "list_sort(list(sum / count))[(floor((count(*) - 1) * 0.75 + 0.5) + 1)::INT]")):
    QUERIES[f"line_plot_{_stat}"] = lambda spark, sf, s=_stat: metagene.line(base(spark, sf), "q75" if s == "quantile" else s, dense=False).withColumn("density", r6("density"))
    ORACLES[f"line_plot_{_stat}"] = f"WITH {mg_sql()}, {FWD} SELECT fragment, round({_sql}, 6) AS density FROM fw GROUP BY 1"


@query(f"WITH {mg_sql()}, {FWD}, l AS (SELECT fragment, round(sum(sum) / sum(count), 6) AS density FROM fw GROUP BY 1) SELECT r.range::BIGINT AS fragment, density FROM range({UP + BODY + DOWN}) r LEFT JOIN l ON r.range = l.fragment")
def line_plot_dense(spark, sf):
    return metagene.line(base(spark, sf)).withColumn("density", r6("density"))


@query(f"WITH {mg_sql()}, {FWD} SELECT context, fragment, round(sum(sum) / sum(count), 6) AS density FROM fw GROUP BY 1, 2")
def line_plot_contexts(spark, sf):
    return metagene.line(base(spark, sf), keys=["context"], dense=False).withColumn("density", r6("density"))


@query(f"WITH {mg_sql()}, {FWD} SELECT fragment, sum(count)::BIGINT AS n, round(avg(sum / count), 6) AS average, round(pow(avg(sum - sum / count), 2), 6) AS variance FROM fw GROUP BY 1")
def line_plot_ci_inputs(spark, sf):
    return metagene.confidence_inputs(base(spark, sf)).withColumn("average", r6("average")).withColumn("variance", r6("variance"))


@query()
def line_plot_interval(spark, sf):
    return metagene.line_with_interval(base(spark, sf))


@query(f"""WITH {mg_sql()}, rz AS (SELECT chr, strand, start, gene, id, context, floor(fragment / {UP + BODY + DOWN} * 20)::BIGINT AS fragment, sum(sum) AS sum, sum(count)::BIGINT AS count FROM mg GROUP BY 1, 2, 3, 4, 5, 6, 7),
fw AS (SELECT * REPLACE (CASE WHEN strand = '-' THEN (SELECT max(fragment) FROM rz) - fragment ELSE fragment END AS fragment), sum / count AS share FROM rz),
g AS (SELECT gene, sum(share) / 21 AS weight FROM fw GROUP BY 1), k AS (SELECT gene, row_number() OVER (ORDER BY round(weight, 9) DESC, gene) - 1 AS rank, count(*) OVER () AS n FROM g),
cells AS (SELECT floor(rank / n * 10)::BIGINT AS row, fragment, avg(share) * 100 AS density FROM fw JOIN k USING (gene) GROUP BY 1, 2)
SELECT r.range::BIGINT AS row, f.range::BIGINT AS fragment, round(coalesce(density, 0), 6) AS density FROM range(10) r CROSS JOIN range(20) f LEFT JOIN cells c ON c.row = r.range AND c.fragment = f.range""")
def heat_map(spark, sf):
    return metagene.heat_map(base(spark, sf), 10, 20).withColumn("density", r6("density"))


@query(f"WITH {mg_sql()} SELECT chr, start, round(sum(sum) / sum(count), 6) AS density, min(gene) AS gene, min(strand) AS strand, min(id) AS id FROM mg GROUP BY 1, 2")
def box_plot(spark, sf):
    return metagene.box(base(spark, sf)).withColumn("density", r6("density"))


@query(f"""WITH {mg_sql()}, b AS (SELECT chr, start, sum(sum) / sum(count) AS v FROM mg GROUP BY 1, 2), q AS (SELECT chr, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM b GROUP BY 1)
SELECT chr, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v), 6) AS low, round(max(v), 6) AS high FROM b JOIN q USING (chr)
WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) GROUP BY chr, q1, median, q3""")
def box_stats(spark, sf):
    d = metagene.box_stats(metagene.box(base(spark, sf)), "density", ["chr"])
    return d.select("chr", *[r6(c).alias(c) for c in ("q1", "median", "q3", "low", "high")])


N = 3
LABELS = [f"s{i}" for i in range(N)]
MATRIX_SQL = f"{samples_sql(N)}, gm AS (SELECT gene, label, sum(sum) / sum(count) AS density FROM ms GROUP BY 1, 2), mx AS (SELECT gene, " + ", ".join(
    f"max(CASE WHEN label = '{x}' THEN density END) AS {x}" for x in LABELS) + f" FROM gm GROUP BY 1 HAVING count(*) = {N})"


def _matrix(spark, sf):
    return metagene.sample_matrix(metagene.labelled(samples(spark, sf, N)), LABELS)


@query(f"WITH {MATRIX_SQL} SELECT * FROM mx")
def pca_matrix(spark, sf):
    return _matrix(spark, sf)


def _varying(q):
    return (f"WITH {MATRIX_SQL}, v AS (SELECT *, ({' + '.join(f'pow({x} - ({' + '.join(LABELS)}) / {N}.0, 2)' for x in LABELS)}) / {N}.0 AS variance FROM mx) "
            f"SELECT gene, {', '.join(LABELS)} FROM v WHERE variance > (SELECT quantile_cont(variance, {q}) FROM v)")


@query(_varying(0.5))
def dendro_var_filter(spark, sf):
    return metagene.variable_rows(_matrix(spark, sf), LABELS, 0.5).select("gene", *LABELS)


@query(_varying(0.75))
def dendro_matrix(spark, sf):
    return metagene.dendrogram_matrix(metagene.labelled(samples(spark, sf, N)), LABELS)


@query()
def pca(spark, sf):
    rows = clusters.principal_components(_matrix(spark, sf), LABELS)
    return spark.createDataFrame(rows, "component int, label string, loading double, explained double")


@query(f"WITH {samples_sql(N)} SELECT gene FROM ms GROUP BY 1 HAVING count(DISTINCT label) = {N}")
def gene_intersection(spark, sf):
    return clusters.shared_genes(metagene.labelled(samples(spark, sf, N)), N)


FW2 = "f2 AS (SELECT * REPLACE (CASE WHEN strand = '-' THEN (SELECT max(fragment) FROM rz WHERE strand IN ('+', '-')) - fragment ELSE fragment END AS fragment) FROM rz WHERE strand IN ('+', '-'))"
RZ8 = f"rz AS (SELECT chr, strand, start, gene, id, context, floor(fragment / {UP + BODY + DOWN} * 4)::BIGINT AS fragment, sum(sum) AS sum, sum(count)::BIGINT AS count FROM {{mg}} GROUP BY 1, 2, 3, 4, 5, 6, 7)"
VEC = "vs AS (SELECT gene, context, fragment, sum(sum) / sum(count) AS v FROM f2 GROUP BY 1, 2, 3)"


def _vectors(m):
    return clusters.matrix(metagene.resize(m, 4).df, 4, fill=0.0)


def _flat(d, keys):
    return d.select(*keys, F.posexplode("vector").alias("i", "v")).select(*keys, F.col("i").cast("long").alias("fragment"), r6("v").alias("v"))


GRID = "gx AS (SELECT DISTINCT gene, context, r.range AS fragment FROM f2 CROSS JOIN range(4) r), gv AS (SELECT gx.*, coalesce(v, 0.0) AS v FROM gx LEFT JOIN vs USING (gene, context, fragment))"


@query(f"WITH {mg_sql()}, {RZ8.format(mg='mg')}, {FW2}, {VEC}, {GRID} SELECT gene, context, fragment::BIGINT AS fragment, round(v, 6) AS v FROM gv")
def cluster_matrix(spark, sf):
    return _flat(_vectors(base(spark, sf)), ["gene", "context"])


def _pair_sql():
    s = samples_sql(2)
    for i in (0, 1):
        s += f", {RZ8.format(mg=f'mg{i}').replace('rz AS', f'rz{i} AS')}, {FW2.replace('f2 AS', f'f2{i} AS').replace('FROM rz', f'FROM rz{i}')}, {VEC.replace('vs AS', f'vs{i} AS').replace('FROM f2', f'FROM f2{i}')}"
        s += ", " + GRID.replace("gx", f"gx{i}").replace("gv AS", f"gv{i} AS").replace("JOIN vs", f"JOIN vs{i}").replace("FROM f2", f"FROM f2{i}")
    return s


@query(f"WITH {_pair_sql()} SELECT a.gene, a.fragment::BIGINT AS fragment, round(b.v - a.v, 6) AS v FROM gv0 a JOIN gv1 b ON a.gene = b.gene AND a.fragment = b.fragment AND a.context = 'CG' AND b.context = 'CG'")
def cluster_compare(spark, sf):
    s = samples(spark, sf)
    a, b = (_vectors(s[k]).where("context = 'CG'") for k in ("s0", "s1"))
    return _flat(clusters.difference(a, b), ["gene"])


def _embeddings(spark, sf):
    return fx.vectors(spark, sf).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


@query("SELECT label, (i - 1)::BIGINT AS i, round(avg(e), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def cluster_centroids(spark, sf):
    return clusters.centroids(_embeddings(spark, sf)).select("label", F.col("i").cast("long").alias("i"), r6("value").alias("value"))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(e) AS m FROM v GROUP BY 1, 2)
SELECT vec_id, label, round(corr(e, m), 6) AS r FROM v JOIN c USING (label, i) GROUP BY 1, 2""")
def module_corr(spark, sf):
    return clusters.module_correlation(_embeddings(spark, sf), "vec_id").withColumn("r", r6("r"))


@query()
def cluster_kmeans(spark, sf):
    return clusters.kmeans(_embeddings(spark, sf).drop("label"), 10, 3).select("vec_id", "label")


WIN = 400_000
LV = f"""{cyt_sql()}, lv AS (SELECT chr, strand, context, floor(position / {WIN})::BIGINT AS "window", sum(density) AS sum, count(density)::BIGINT AS count, min(position) AS start, max(position) AS "end",
  avg(density) AS mean, var_pop(density) AS variance, sum(count_total)::BIGINT AS weight FROM cyt WHERE NOT isnan(density) GROUP BY 1, 2, 3, 4)"""
PLOT = LV + """, pw AS (SELECT chr, "window", context, sum(sum) / sum(count) AS density, min(start) AS start FROM lv GROUP BY 1, 2, 3),
px AS (SELECT *, dense_rank() OVER (ORDER BY chr, "window") - 1 AS fragment FROM pw)"""
LV_COLS = 'chr, strand, context, "window", round(sum, 6) AS sum, count, start, "end", round(mean, 6) AS mean, round(variance, 6) AS variance, weight'


def _levels(d):
    for c in ("sum", "mean", "variance"):
        d = d.withColumn(c, r6(c))
    return d


@query(f"WITH {LV} SELECT {LV_COLS} FROM lv")
def chr_levels(spark, sf):
    return _levels(chromosomes.levels(cytosines(spark, sf), WIN))


@query(f"WITH {LV} SELECT {LV_COLS} FROM lv WHERE context = 'CHG' AND strand = '+'")
def chr_levels_filter(spark, sf):
    return _levels(chromosomes.filtered(chromosomes.levels(cytosines(spark, sf), WIN), context="CHG", strand="+"))


@query(f"WITH {cyt_sql()} SELECT chr, count(*)::BIGINT AS n FROM cyt GROUP BY 1 HAVING max(position) - min(position) >= (SELECT max(position) - 7000 FROM cyt)")
def chr_min_length(spark, sf):
    c = cytosines(spark, sf)
    limit = c.agg(F.max("position")).first()[0] - 7000
    return chromosomes.long_chromosomes(c, limit).groupBy("chr").agg(F.count("*").alias("n"))


@query(f"""WITH {PLOT} SELECT chr, "window", context, start, fragment::BIGINT AS fragment, round(density, 6) AS density FROM px""")
def chr_levels_plot(spark, sf):
    return chromosomes.plot(chromosomes.levels(cytosines(spark, sf), WIN)).withColumn("density", r6("density"))


@query(f"""WITH {PLOT}, b AS (SELECT chr, min(fragment) AS border, max(fragment) AS last FROM px GROUP BY 1)
SELECT chr, border::BIGINT AS border, (border + coalesce(lead(border) OVER (ORDER BY border), last + 1)) / 2 AS tick FROM b""")
def chr_ticks(spark, sf):
    return chromosomes.ticks(chromosomes.plot(chromosomes.levels(cytosines(spark, sf), WIN)))


@query(f"""WITH {LV}, v AS (SELECT chr, context, sum / count AS v FROM lv) SELECT chr, context, count(*)::BIGINT AS n, {", ".join(f"round({e}, 6) AS {c}" for c, e in (
    ("total", "sum(v)"), ("low", "min(v)"), ("q1", "quantile_cont(v, 0.25)"), ("median", "quantile_cont(v, 0.5)"), ("q3", "quantile_cont(v, 0.75)"), ("high", "max(v)")))} FROM v GROUP BY 1, 2""")
def chr_box_plot(spark, sf):
    b = chromosomes.boxes(chromosomes.levels(cytosines(spark, sf), WIN))
    return b.select("chr", "context", "n", *[r6(c).alias(c) for c in ("total", "low", "q1", "median", "q3", "high")])


@query()
def chr_levels_interval(spark, sf):
    return chromosomes.with_interval(chromosomes.levels(cytosines(spark, sf), WIN))
