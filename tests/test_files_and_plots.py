"""Binary alignments, saved results, drawings, the command line, and what can go wrong with them."""

import struct
import subprocess
import sys
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistrata import cli
from epistrata.functions import ranges
from epistrata.operators import binomial, chromosomes, clusters, enrichment, joins, metagene, reads
from epistrata.operators.genome import gene_body
from epistrata.operators.samples import Samples
from epistrata.plans import fixtures
from epistrata.plots import figures, report, svg
from epistrata.sources import annotation, bam, reports, sam, saves

SF = "/root/testdata/sf0.001"


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(ref, pos, name, xm, xr, xg, quals):
    tags = b"NMC\x03" + b"ABBc" + struct.pack("<i", 2) + b"\1\2" + b"".join(t + b"Z" + v.encode() + b"\0" for t, v in ((b"XM", xm), (b"XR", xr), (b"XG", xg)))
    raw = struct.pack("<iiBBHHHi", ref, pos, len(name) + 1, 9, 0, 1, 0, len(quals)) + struct.pack("<iii", -1, -1, 0)
    raw += name.encode() + b"\0" + struct.pack("<I", len(quals) << 4) + bytes((len(quals) + 1) // 2) + bytes(quals) + tags
    return struct.pack("<i", len(raw)) + raw


def write_bam(path, reads_):
    """Reads (ref, pos, ...) in order; each in a block of its own, two for the long ones. Writes the index as well."""
    names = [(b"chr1", 300_000), (b"chr2", 50_000)]
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", size) for n, size in names)
    out, linear = block(head), [{}, {}]
    for r in reads_:
        raw = record(*r)
        if r[0] >= 0:
            for k in range(r[1] >> 14, (r[1] + len(r[6]) - 1 >> 14) + 1):
                linear[r[0]].setdefault(k, len(out) << 16)
        out += block(raw[:40]) + block(raw[40:]) if len(raw) > 120 else block(raw)
    path.write_bytes(out + block(b""))
    index = b"BAI\1" + struct.pack("<i", 2)
    for at in linear:
        n = max(at, default=-1) + 1
        index += struct.pack("<i", 1) + struct.pack("<Iiqq", 4681, 1, 0, 9) + struct.pack("<i", n) + b"".join(struct.pack("<Q", at.get(k, 0)) for k in range(n))
    (path.parent / f"{path.name}.bai").write_bytes(index)


READS = [(0, 99, "a", "Z..h", "GA", "CT", [30, 31, 32, 33]), (0, 16_380, "b", "z" * 40, "CT", "CT", [20] * 40), (0, 200_000, "c", "X.", "GA", "GA", [40, 41]),
         (1, 5, "d", "Hu", "CT", "GA", [9, 8]), (-1, -1, "e", "z", "CT", "CT", [5])]


def test_bam_equals_its_reads(spark, tmp_path):
    write_bam(tmp_path / "x.bam", READS)
    path = str(tmp_path / "x.bam")
    chr_ = lambda r: ["chr1", "chr2", "*"][r[0]]
    want = sorted((r[2], chr_(r), r[1] + 1, r[3], r[4], r[5], r[6]) for r in READS if r[0] >= 0)
    rows = lambda d: sorted((r.qname, r.chr, r.pos, r.xm, r.xr, r.xg, r.quals) for r in d.collect())
    for slab in (1 << 14, 1 << 16, 1 << 30):
        assert rows(bam.read_bam(spark, path, slab=slab)) == want
    assert bam.read_bam(spark, path, slab=1 << 14).rdd.getNumPartitions() > 2
    assert [r[0] for r in rows(bam.read_bam(spark, path, [("chr1", 150_000, 250_000), ("chr2", 1, 3)], slab=1 << 14))] == ["c"]
    assert [r[0] for r in rows(bam.read_bam(spark, path, [("chr1", 16_400, 16_410), ("chr2", 7, 9)]))] == ["b", "d"]
    (tmp_path / "x.bam.bai").unlink()
    assert sorted((r.qname, r.pos is None) for r in bam.read_bam(spark, path).collect()) == [(x, x == "e") for x in "abcde"]
    with pytest.raises(FileNotFoundError):
        bam.read_bam(spark, str(tmp_path / "none.bam"))
    (tmp_path / "bad.bam").write_bytes(b"nothing like it" * 9)
    with pytest.raises(Exception, match="BGZF"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).collect()


def test_conversions_as_the_format_defines_them(spark):
    """Strand and converted by read and genome conversion, kept or not."""
    calls = spark.createDataFrame([("1", "r", i, "Z", 40, c) for i, c in enumerate(("CTCT", "CTGA", "GACT", "GAGA"))], "chr string, qname string, position int, call string, qual int, strand_conv string")
    got = {r.strand_conv: (r.strand, r.converted) for r in reads.decoded(calls).collect()}
    assert got == {"CTCT": ("+", True), "CTGA": ("-", True), "GACT": ("+", False), "GAGA": ("-", False)}
    assert {r.strand_conv for r in reads.decoded(calls, keep_converted=False).collect()} == {"GACT", "GAGA"}


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    a = [(f"c{rng.integers(3)}", int(x)) for x in rng.integers(0, 10**6, 300)] + [("none", 5), ("c0", 777)]
    b = [(f"c{rng.integers(3)}", int(x), f"g{i:03}") for i, x in enumerate(rng.integers(0, 10**6, 60))] + [("c0", 770, "g900"), ("c0", 784, "g901"), ("c0", 770, "g899")]
    got = joins.asof_nearest(spark.createDataFrame(a, "chr string, mid long"), spark.createDataFrame(b, "chr string, mid long, id string")).collect()
    assert len(got) == len(a)
    for r in got:
        own = sorted((abs(m - r.mid), m, i) for c, m, i in b if c == r.chr)
        assert (r.r_mid, r.r_id) == ((own[0][1], own[0][2]) if own else (None, None))


def test_ranks_without_one_task(spark):
    rng = np.random.default_rng(4)
    data = [(f"k{rng.integers(3)}", float(v)) for v in rng.integers(0, 40, 500)]
    d = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id int, k string, v double")
    order = [r.id for r in ranges.numbered(d, "v", ["id"], "rank", rows=50).orderBy("rank").collect()]
    assert order == sorted(range(500), key=lambda i: (data[i][1], i))
    for q in (0, 0.25, 0.5, 0.9, 1):
        got = {r.k: r.x for r in ranges.nearest_rank(d, ["k"], "v", q, "x").collect()}
        for k in ("k0", "k1", "k2"):
            s = sorted(v for c, v in data if c == k)
            assert got[k] == s[int(np.floor((len(s) - 1) * q + 0.5))]


def test_cytosines_across_pieces(spark):
    rng = np.random.default_rng(5)
    s = "".join(rng.choice(list("ACGTN"), 3001))
    table = str.maketrans("ATGCURYKBDHVN", "TACGRUKYNNNNN", "M")
    context = lambda t: "CG" if t[1] == "G" else "CHG" if t[2] == "G" else "CHH"
    want = {(i + 1, True, s[i : i + 3]) for i in range(len(s) - 2) if s[i] == "C"} | {(i + 1, False, s[i - 2 : i + 1][::-1].translate(table)) for i in range(2, len(s)) if s[i] == "G"}
    d = spark.createDataFrame([("x", s), ("y", "CG"), ("z", ""), ("n", None)], "chr string, sequence string")
    for piece in (7, 1000, 10**6):
        got = [(r.position, r.strand, r.trinuc, r.context) for r in annotation.cytosines(d, piece).where("chr = 'x'").collect()]
        assert {g[:3] for g in got} == want and len(got) == len(want)
        assert all(g[3] == context(g[2]) for g in got if g[1])
    assert annotation.cytosines(d).where("chr <> 'x'").count() == 0
    assert len(annotation.trinucleotides()) == 256


def test_index_file_or_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1\nACGTCAGCA\n")
    made = annotation.open_index(spark, str(tmp_path / "a.fa"))
    annotation.write_index(made, str(tmp_path / "index"))
    rows = lambda d: sorted(tuple(r) for r in d.select("chr", "position", "strand", "context", "trinuc").collect())
    assert rows(annotation.open_index(spark, str(tmp_path / "index"))) == rows(made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        annotation.open_index(spark, str(tmp_path / "none"))


def a_metagene(spark, replicate=None):
    g = gene_body(fixtures.genome(spark, SF).where("type = 'gene'"), 0, 500)
    return metagene.metagene(fixtures.cytosines(spark, SF, replicate), g, 10, 20, 10)


def test_samples_do_to_each(spark, tmp_path):
    s = Samples.of([a_metagene(spark, 0), a_metagene(spark, 1)], ["x", "y"])
    assert s.filtered(context="CG").table().select("context").distinct().count() == 1
    assert s.trim_flank().by_label["y"].windows == 20 and s.resize(20).by_label["x"].windows == 20
    assert s.merged().df.agg(F.sum("count")).first()[0] == s.table().agg(F.sum("count")).first()[0]
    assert s.line().groupBy("label").count().count() == 2 and s.box().count() > 0
    assert s.dendrogram_matrix(0).count() == s.matrix().count() > s.dendrogram_matrix().count() > 0
    with pytest.raises(ValueError):
        Samples({"x": s.by_label["x"], "y": s.trim_flank().by_label["y"]})
    with pytest.raises(ValueError):
        Samples.of([a_metagene(spark)], ["x", "y"])
    for merged in (False, True):
        s.save(str(tmp_path / f"m{merged}"), merged, gzip=True)
    one = spark.read.csv(str(tmp_path / "mTrue"), sep="\t", header=True)
    assert one.count() == s.table().count() == sum(spark.read.csv(str(tmp_path / "mFalse" / x), sep="\t", header=True).count() for x in "xy")


def test_saved_results_come_back(spark, tmp_path):
    c = fixtures.cytosines(spark, SF)
    g = gene_body(fixtures.genome(spark, SF).where("type = 'gene'"), 0, 500)
    at = lambda n: str(tmp_path / n)
    saves.save_site_pvalues(binomial.site_pvalues(c), at("p"))
    assert reports.read_report(spark, at("p"), "binom").count() == c.where("count_total >= 2").count()
    p = binomial.region_pvalues(c, g)
    saves.save_region_pvalues(p, at("r"))
    back = saves.read_region_pvalues(spark, at("r"))
    rows = lambda d: sorted((r.chr, r.start, r.context, r.count_m, round(r.p_value, 9)) for r in d.collect())
    assert rows(back) == rows(p)
    w = binomial.wide(back)
    saves.save_regions(w, at("bed"))
    assert spark.read.csv(at("bed"), sep="\t").count() == w.count()
    both = (binomial.p_value_of("CG") < 0.5) & (binomial.count_of("CG") >= 20)
    assert both(w).count() == w.where("p_value_context_CG < 0.5 and count_total_context_CG >= 20").count()
    either = (binomial.p_value_of("CG") <= 0.1) | (binomial.count_of("CG") == 20)
    assert either(w).count() == w.where("p_value_context_CG <= 0.1 or count_total_context_CG = 20").count()
    saves.save_labels(clusters.identity(w.select(F.col("id").alias("gene"))), at("labels"))
    assert all(r._c0 == r._c1 for r in spark.read.csv(at("labels"), sep="\t").collect())
    calls = fixtures.calls(spark, SF)
    saves.save_windows(reads.methylation_entropy(calls), at("me"), "entropy", 4)
    assert len(spark.read.csv(at("me"), sep="\t").columns) == 6
    saves.save_discordance(reads.discordant_reads(calls), at("pdr"))
    assert len(spark.read.csv(at("pdr"), sep="\t").columns) == 5


def test_coverage_report_from_a_file(spark, tmp_path):
    c = fixtures.cytosines(spark, SF)
    index = c.groupBy("chr", "position").agg(F.min("strand").alias("strand"), F.min("context").alias("context"))
    reports.write_report(c, str(tmp_path / "cov"), "coverage", gzip=True)
    got = reports.read_report(spark, str(tmp_path / "cov"), "coverage", index)
    assert got.columns == reports.UNIVERSAL and got.count() == c.where("count_total <> 0").count()
    assert got.agg(F.sum("count_m"), F.sum("count_total")).first() == c.agg(F.sum("count_m"), F.sum("count_total")).first()


def test_drawings(spark):
    ok = lambda s: ElementTree.fromstring(s).tag.endswith("svg")
    m = a_metagene(spark)
    assert metagene.ticks(m) == [5, 10, 20, 30, 35] and metagene.borders(m) == [10, 30]
    drawn = [figures.line_plot({"a": m}, smooth=5), figures.line_plot({"a": m}, confidence=0.95), figures.contexts_plot(m), figures.heat_map(m, 10, 20), figures.box_plot({"a": m, "b <&": m}),
             figures.levels_plot(chromosomes.levels(fixtures.cytosines(spark, SF), 400_000)), figures.components_plot([(0, "x", 0.5, 0.9), (0, "y", -0.5, 0.9), (1, "x", 0.1, 0.1), (1, "y", 0.2, 0.1)]),
             figures.enrichment_plot(enrichment.enrich(fixtures.dmr(spark, SF), fixtures.genome(spark, SF))), figures.quality_plot(reads.quality_histogram(fixtures.reads(spark, SF)))]
    assert all(map(ok, drawn))
    assert all(map(ok, [svg.line({}), svg.line({"a": [None, float("nan")]}), svg.heat(np.zeros((0, 0))), svg.box({}), svg.points({}), svg.bars({})]))
    assert "&lt;" in report.page("<x>", {"CG": {"c": drawn[0]}})


def test_lines_of_coverage(spark):
    cov = spark.createDataFrame([(-1.0, 2), (-0.95, 4), (0.0, 1), (0.5, 3), (1.99, 7)], "pos double, depth long")
    r = enrichment.resampled(cov, 2, 4)
    assert {x.window: x.depth for x in r.collect()} == {0: 3.0, 1: 0.0, 2: 1.0, 3: 0.0, 4: 3.0, 5: 0.0, 6: 0.0, 7: 7.0}
    assert enrichment.coverage_line(r, norm=True)[-1] == 1.0
    assert enrichment.step_line([0, 1, 2, 3], [1, 2, 2, 0]) == ([0, 0, 1, 3, 3], [1, 2, 2, 2, 0])


def test_command_line_with_sheets_alignments_and_reports(spark, tmp_path):
    c = fixtures.cytosines(spark, SF)
    g = fixtures.genome(spark, SF).where("type = 'gene'")
    g.select("chr", F.lit("x").alias("a"), "type", "start", "end", F.lit(".").alias("b"), "strand", F.lit(".").alias("c"), F.concat(F.lit("ID="), "id").alias("d")).write.csv(str(tmp_path / "g"), sep="\t", quote="")
    for i in (0, 1):
        reports.write_report(fixtures.cytosines(spark, SF, i), str(tmp_path / f"r{i}"), "bismark")
    reports.write_report(c, str(tmp_path / "r"), "bismark")
    row = lambda name, r: f"{name}\t{tmp_path / r}\t{tmp_path / 'g'}\t500\t0\tgene\tgff\tbismark\n"
    (tmp_path / "s.tsv").write_text(row("both", "r0") + row("both", "r1") + row("whole", "r"))
    windows = ["--up", "4", "--body", "8", "--down", "4", "--rows", "5"]
    for args in (["metagene", *windows], ["levels", "--window", "400000"], ["category", *windows]):
        out, html = str(tmp_path / args[0]), tmp_path / f"{args[0]}.html"
        cli.main([args[0], str(tmp_path / "s.tsv"), out, "--sheet", "--html", f"file:{html}", *args[1:]])
        got = spark.read.csv(out, sep="\t", header=True)
        assert {r.label for r in got.select("label").distinct().collect()} == {"both", "whole"}
        assert html.read_text().count("<svg") >= 1
    write_bam(tmp_path / "x.bam", READS)
    (tmp_path / "x.fa").write_text(">chr1\n" + "CG" * 200 + "\n")
    cli.main(["bam", str(tmp_path / "x.bam"), str(tmp_path / "full"), "--fasta", str(tmp_path / "x.fa")])
    full = reports.read_report(spark, str(tmp_path / "full"), "bismark")
    assert full.count() == 398 and full.agg(F.sum("count_total")).first()[0] <= 2
    cli.main(["bam", str(tmp_path / "x.bam"), str(tmp_path / "found"), "--to", "cgmap"])
    assert reports.read_report(spark, str(tmp_path / "found"), "cgmap").agg(F.sum("count_total")).first()[0] == 44
    for stat in ("ME", "EPM", "PDR"):
        cli.main(["bam", str(tmp_path / "x.bam"), str(tmp_path / stat), "--mode", "stats", "--stat", stat, "--min-depth", "1"])
        assert spark.read.csv(str(tmp_path / stat), sep="\t").count() > 0


def test_entry_without_the_text_libraries(tmp_path):
    """The other queries are there when a library of the text operators isn't."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op') for x in q) and set(e.oracle_sql()) <= set(q)"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
