"""Readers, writers and statistics, and every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from epistrata import cli
from epistrata.functions import ranges, stats
from epistrata.functions.density import binom_sf
from epistrata.operators import clusters, genome, joins, metagene, reads, replicates
from epistrata.plans import fixtures, registry
from epistrata.sources import annotation, reports, sam
from epistrata.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) else v
    return sorted((tuple(show(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    d = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(d.columns) == sorted(want.columns)
    assert rows(d.columns, d.collect()) == rows(want.columns, want.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_reports_round_trip(spark, tmp_path):
    c = fixtures.cytosines(spark, SF)
    for kind in ("bismark", "cgmap"):
        path = str(tmp_path / kind)
        reports.write_report(c, path, kind, gzip=True)
        got = reports.read_report(spark, path, kind)
        assert got.columns == reports.UNIVERSAL and got.count() == c.count()
        assert got.agg(F.sum("count_m")).first() == c.agg(F.sum("count_m")).first()
    index = c.groupBy("chr", "position").agg(F.min("strand").alias("strand"), F.min("context").alias("context"))
    reports.write_report(c, str(tmp_path / "bg"), "bedgraph")
    got = reports.read_report(spark, str(tmp_path / "bg"), "bedgraph", index, percent=False)
    assert got.where("count_total > 100 or count_m > count_total").count() == 0
    with pytest.raises(FileNotFoundError):
        reports.read_report(spark, str(tmp_path / "none"), "bismark")
    with pytest.raises(KeyError):
        reports.read_report(spark, str(tmp_path), "nothing")
    with pytest.raises(KeyError):
        reports.validated(c.drop("trinuc"))


def test_rational(spark):
    d = spark.createDataFrame([(1 / 3,), (0.5,), (float("nan"),), (None,)], "x double").select(stats.rational(F.col("x"), F.lit(100)).alias("r")).collect()
    assert [(r.r.m, r.r.total) if r.r else r.r for r in d][:2] == [(1, 3), (1, 2)] and all(r.r is None or r.r.m is None for r in d[2:])


def test_rational_in_batches(spark):
    """As the SQL tells the nearest fraction, row by row with a limit of its own, ties to the smallest denominator; in batches, and once for both fields."""
    def nearest(x, most):
        def off(k):
            v = abs(x - math.floor(x * k + 0.5) / k) * 1e12
            return (math.floor(v) + (v - math.floor(v) >= 0.5), k)
        k = min(range(1, most + 1), key=off)
        return math.floor(x * k + 0.5), k

    data = [(m / t, most) for t in (1, 2, 3, 7, 64, 99, 100, 101, 250, 9973) for m in range(0, t + 1, max(1, t // 40)) for most in (1, 5, 100, 130)]
    d = spark.createDataFrame(data, "x double, most long").select("x", "most", stats.rational(F.col("x"), F.col("most")).alias("r"))
    assert [(r.r.m, r.r.total) for r in d.collect()] == [nearest(*x) for x in data]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.25,)], "x double").select(stats.rational(F.col("x"), F.lit(100)).alias("r")).collect()
    assert [(r.r.m, r.r.total) for r in odd] == [(None, None)] * 3 + [(5, 4)]
    both = spark.range(9).select((F.col("id") / 8).alias("x")).select(stats.rational(F.col("x"), F.lit(100)).alias("r")).select("r.m", "r.total")
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_regions_ordered_by_stretches(spark, monkeypatch):
    """As of, against brute force, with regions that begin together, empty stretches and places below 0; no task orders a chromosome's regions."""
    monkeypatch.setattr(joins, "STRETCH", 50, raising=False)
    rng = np.random.default_rng(3)
    begin = rng.choice([*range(-120, 0, 7), *range(300, 420), *range(2000, 2600, 40)], 300)
    data = [(f"c{k % 2}", int(b), int(b + rng.integers(0, 160)), f"r{k:03}") for k, b in enumerate(begin)]
    at = [(f"c{k % 2}", int(p)) for k, p in enumerate(rng.integers(-150, 2800, 800))]
    left = spark.createDataFrame(at, "chr string, position long")
    d = joins.asof_backward(left, spark.createDataFrame(data, "chr string, upstream long, downstream long, id string"), bin_size=70)

    def nearest(c, p):
        found = max((r for r in data if r[0] == c and r[1] <= p), key=lambda r: (r[1], r[2], -int(r[3][1:])), default=None)
        return [(c, p, found[3])] if found and p <= found[2] else []

    assert sorted((r.chr, r.position, r.r_id) for r in d.collect()) == sorted(x for c, p in at for x in nearest(c, p))
    leads = [x for x in d._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lead(upstream" in x]
    assert leads and all("windowspecdefinition(chr" in x and ", _stretch" in x.split("windowspecdefinition(")[1] for x in leads)


def test_merged_samples_dealt_by_size(spark, monkeypatch):
    """Tasks of a merge grow in number with the files, not in what they hold."""
    c, r = fixtures.cytosines(spark, SF), genome.gene_body(fixtures.genome(spark, SF), 0, 500)
    m = metagene.metagene(c, r, 1, 2, 1)
    size = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    monkeypatch.setattr(ranges, "SHARE", size // 20, raising=False)
    both = metagene.merged([m, m]).df
    assert both.rdd.getNumPartitions() >= 40
    assert both.agg(F.sum("count")).first()[0] == 2 * m.df.agg(F.sum("count")).first()[0]


def test_heat_map_places_cytosines_once(spark):
    c, r = fixtures.cytosines(spark, SF), genome.gene_body(fixtures.genome(spark, SF), 0, 500)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    m = metagene.metagene(c, r, 2, 4, 2)
    n = m.df.count()
    once = m.of(m.df.withColumn("gene", counted("gene")))
    got = metagene.heat_map(once, 5).collect()
    assert len(got) == 5 * 8 and any(x.density > 0 for x in got)
    assert seen.value == n


def test_merged_reports_dealt_by_size(spark, monkeypatch):
    """Tasks of a merge of reports grow in number with the files, not in what they sort."""
    monkeypatch.setattr(ranges, "SHARE", os.path.getsize(f"{SF}/lineitem.parquet") // 20, raising=False)
    parts = [fixtures.cytosines(spark, SF, i) for i in (0, 1)]
    both = replicates.merge(parts)
    assert both.rdd.getNumPartitions() >= 40
    assert both.agg(F.sum("count_total")).first()[0] == sum(d.agg(F.sum("count_total")).first()[0] for d in parts)


def test_golden_regions(spark):
    g = spark.createDataFrame([("1", "gene", 3631, 5899, "+", "a"), ("1", "exon", 3631, 3913, "+", "b"), ("1", "gene", 2000, 9000, "+", "c"), ("1", "gene", 5000, 5100, "+", "d")], "chr string, type string, start long, end long, strand string, id string")
    one = lambda d, i: {k: v for k, v in d.where(F.col("id") == i).first().asDict().items() if k in ("start", "end", "upstream", "downstream")}
    assert one(genome.gene_body(g, 0, 2000), "a") == {"start": 3631, "end": 5899, "upstream": 1631, "downstream": 7899}
    assert one(genome.near_tss(g, 0, 2000), "a") == {"start": 3631, "end": 5631, "upstream": 1631, "downstream": 5631}
    assert one(genome.near_tes(g, 0, 2000), "a") == {"start": 3899, "end": 5899, "upstream": 3899, "downstream": 7899}
    assert one(genome.exon(g), "b") == {"start": 3631, "end": 3913, "upstream": 3631, "downstream": 3913}
    assert {r.id for r in genome.gene_body(g, 100, 2000).collect()} == {"a"}
    with pytest.raises(ValueError):
        genome.require_rows(genome.other(g, "none"))


def test_asof_takes_the_nearest_then_the_strand(spark):
    r = spark.createDataFrame([("1", "+", 10, 90, 10, 90, "far"), ("1", "-", 40, 60, 40, 60, "near"), ("1", "+", 40, 50, 40, 50, "short")], "chr string, strand string, start long, end long, upstream long, downstream long, id string")
    c = spark.createDataFrame([("1", p, "+", 1.0, 1) for p in (5, 10, 39, 45, 61, 90)], "chr string, position long, strand string, density double, count_total long")
    got = {x.position: x.r_id for x in joins.asof_backward(c, r, bin_size=7).collect()}
    assert got == {10: "far", 39: "far", 45: "near"}
    assert [x.position for x in metagene.placed(c, r).orderBy("position").collect()] == [10, 39]


def test_binomial_tail(spark):
    d = spark.createDataFrame([(3, 10, 0.3), (0, 5, 0.3), (5, 5, 0.3), (4, 4, 1.0), (1, 4, 0.0)], "m long, n long, p double").select(binom_sf(F.col("m"), F.col("n"), F.col("p")).alias("x")).collect()
    want = [sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3, 11)), 1, 0.3**5, 1, 0]
    assert np.allclose([r.x for r in d], want)


def test_student_and_smoothing():
    assert abs(stats.t_quantile(0.975, 10) - 2.228139) < 1e-5 and math.isnan(stats.t_quantile(0.9, 0))
    y = np.arange(20.0) ** 2
    assert np.allclose(stats.savitzky_golay(y, 5)[3:-3], y[3:-3]) and len(stats.savitzky_golay(y, 2)) == 20
    assert np.isnan(stats.savitzky_golay([1, math.nan], 5)).any()
    assert abs(stats.correlation_p(0.5, 20) - 0.0248) < 1e-3
    assert np.allclose(stats.lgamma([0.5, 1, 7.25, 4e5]), [math.lgamma(x) for x in (0.5, 1, 7.25, 4e5)], rtol=1e-13)


def test_resize_and_trim(spark):
    m = metagene.Metagene(spark.createDataFrame([("1", "+", 1, "g", "i", "CG", f, 1.0, 1) for f in range(2000)], "chr string, strand string, start long, gene string, id string, context string, fragment long, sum double, count long"), 500, 1000, 500)
    r = metagene.resize(m, 100)
    assert (r.up, r.body, r.down) == (25, 50, 25) and r.df.count() == 100 and r.df.agg(F.sum("count")).first()[0] == 2000
    t = metagene.trim_flank(m)
    assert (t.up, t.body, t.down, t.df.count()) == (0, 1000, 0, 1000)
    assert len(metagene.smoothed_line(m, 5, resolution=100)) == 100
    with pytest.raises(ValueError):
        metagene.merged([m, r])


def test_heterogeneity(spark):
    c = spark.createDataFrame([("1", f"r{i}", p, int(i >= 2)) for i in range(4) for p in (1, 2, 3, 4)], "chr string, qname string, position long, m int")
    assert reads.methylation_entropy(c).first().entropy == 0.25 and reads.epipolymorphism(c).first().epipolymorphism == 0.5
    assert reads.methylation_entropy(c.withColumn("m", F.lit(1))).first().entropy == 0


def test_fasta_and_sam(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACGTCAGCA\nATTT\n>c2\nGG\n")
    got = {(r.chr, r.position, r.strand): (r.context, r.trinuc) for r in annotation.open_index(spark, str(tmp_path / "a.fa")).collect()}
    assert got[("c1", 2, True)] == ("CG", "CGT") and got[("c1", 5, True)] == ("CHG", "CAG") and got[("c1", 8, True)] == ("CHH", "CAA") and got[("c1", 3, False)] == ("CG", "CGT")
    (tmp_path / "a.sam").write_text("@HD\nq1\t0\tchr1\t7\t9\t3M\t*\t0\t0\tACG\tI5!\tNM:i:0\tXM:Z:Z.h\tXR:Z:CT\tXG:Z:CT\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\tXM:Z:z\n")
    d = reads.decoded(reads.exploded_calls(sam.read_sam(spark, str(tmp_path / "a.sam")))).orderBy("position").collect()
    assert [(r.position, r.call, r.qual, r.strand, r.context, r.m) for r in d] == [(7, "Z", 40, "+", "CG", 1), (9, "h", 0, "+", "CHH", 0)]


def test_sheet(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\tr1\tg1\t\t\tgene\t\t\na\tr2\tg1\t5\t\tgene\t\t\n")
    d = annotation.read_sheet(spark, str(tmp_path / "s.tsv"))
    assert [(r.flank_length, r.genome_type, r.report_type) for r in d.orderBy("report_file").collect()] == [(0, "gff", "bismark"), (5, "gff", "bismark")]
    (tmp_path / "t.tsv").write_text("a\tr1\tg1\na\tr2\tg2\n")
    with pytest.raises(ValueError):
        annotation.read_sheet(spark, str(tmp_path / "t.tsv"))


def test_linkage():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [20.0]])
    label = clusters.linkage_cut(x, 0.5)
    assert label[0] == label[1] and label[2] == label[3] and len(set(label)) == 3


def test_stream_equals_batch(spark, tmp_path):
    c = fixtures.cytosines(spark, SF)
    folder = str(tmp_path / "in")
    reports.write_report(c.repartition(3), folder, "bismark")
    q = windows.levels(windows.read_stream(spark, folder), 20_000).writeStream.outputMode("complete").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("levels").agg(F.count("*"), F.sum("count"), F.round(F.sum("sum"), 6)).first()
    from epistrata.operators import chromosomes

    assert got == chromosomes.levels(c, 20_000).agg(F.count("*"), F.sum("count"), F.round(F.sum("sum"), 6)).first()


def test_command_line(spark, tmp_path):
    reports.write_report(fixtures.cytosines(spark, SF), str(tmp_path / "r"), "bismark")
    g = fixtures.genome(spark, SF).where("type = 'gene'")
    gff = g.select("chr", F.lit("x").alias("a"), "type", "start", "end", F.lit(".").alias("b"), "strand", F.lit(".").alias("c"), F.concat(F.lit("ID="), "id").alias("d"))
    gff.write.csv(str(tmp_path / "g"), sep="\t", quote="")
    for args in (["levels", "--window", "20000"], ["metagene", "--genome", str(tmp_path / "g"), "--flank", "500", "--up", "10", "--body", "20", "--down", "10"], ["category", "--genome", str(tmp_path / "g"), "--flank", "500"]):
        out = str(tmp_path / args[0])
        cli.main([args[0], str(tmp_path / "r"), out, *args[1:]])
        assert spark.read.csv(out, sep="\t", header=True).count() > 0
