"""python -m epistrata.cli metagene|levels|category|bam: reports, sheets or alignments in; tables and an HTML report out."""

from __future__ import annotations

import argparse
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import binomial, chromosomes, genome, metagene, reads, replicates
from .operators.samples import Samples
from .plots import figures, report
from .sources import annotation, bam, reports, sam, saves

TYPES = {"gene": genome.gene_body, "tss": genome.near_tss, "tes": genome.near_tes}
CONTEXTS = ("CG", "CHG", "CHH")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epistrata")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("metagene", "levels", "category"):
        s = sub.add_parser(name)
        s.add_argument("report", help="a report, or a sample sheet with --sheet")
        s.add_argument("out")
        s.add_argument("--sheet", action="store_true", help="the input is a sheet: rows of one name are replicates, each name a sample")
        s.add_argument("--html", help="also write the drawings to this file")
        s.add_argument("--smooth", type=int, default=0)
        s.add_argument("--confidence", type=float, default=0.0)
        s.add_argument("--kind", default="bismark")
        if name == "levels":
            s.add_argument("--window", type=int, default=100_000)
            s.add_argument("--min-length", type=int, default=0)
            continue
        s.add_argument("--genome", help="an annotation, unless the sheet names one per sample")
        s.add_argument("--regions", choices=[*TYPES, "all", "exon", "cds"], default="gene")
        s.add_argument("--flank", type=int, default=2000)
        s.add_argument("--min-length", type=int, default=0)
        for w, n in (("up", 100), ("body", 200), ("down", 100)):
            s.add_argument(f"--{w}", type=int, default=n)
        s.add_argument("--stat", default="wmean")
        s.add_argument("--rows", type=int, default=100, help="rows of the heat map")
        s.add_argument("--context", default="CG")
        s.add_argument("--p-value", type=float, default=0.05)
        s.add_argument("--min-n", type=int, default=0)
    s = sub.add_parser("bam")
    s.add_argument("alignments", help="BAM (with .bai beside it, if there is one) or SAM")
    s.add_argument("out")
    s.add_argument("--mode", choices=["report", "stats"], default="report")
    s.add_argument("--fasta", help="for reports: the sequences, or a written index of their cytosines")
    s.add_argument("--to", choices=[*reports.WRITERS], default="bismark")
    s.add_argument("--stat", choices=["ME", "EPM", "PDR"], default="ME")
    s.add_argument("--length", type=int, default=4, help="cytosines of a window; for PDR, calls that a read must have")
    s.add_argument("--min-depth", type=int, default=4)
    s.add_argument("--min-qual", type=int)
    s.add_argument("--context")
    s.add_argument("--drop-converted", action="store_true")
    return p


def genome_mapping(region_type: str | None, g: DataFrame, min_length: int, flank: int) -> DataFrame:
    """Regions by a sheet's or option's name for them; any other name is an annotation's type."""
    kind = (region_type or "all").lower()
    if kind in TYPES:
        return TYPES[kind](g, min_length, flank)
    if kind == "all":
        return genome.all_regions(g, min_length, flank)
    return {"exon": lambda: genome.exon(g, min_length), "cds": lambda: genome.cds(g, min_length)}.get(kind, lambda: genome.other(g, region_type, min_length, flank))()


def inputs(spark: SparkSession, a) -> dict[str, tuple[DataFrame, SimpleNamespace]]:
    """Sample -> (its reports, replicates merged; the options that hold for it)."""
    if not a.sheet:
        return {"sample": (reports.read_report(spark, a.report, a.kind), SimpleNamespace(genome=getattr(a, "genome", None), regions=getattr(a, "regions", None), min_length=a.min_length, flank=getattr(a, "flank", 0)))}
    out = {}
    for name, rows in annotation.samples(annotation.read_sheet(spark, a.report)).items():
        found = [reports.read_report(spark, r["report_file"], r["report_type"]) for r in rows]
        first = rows[0]
        out[name] = (found[0] if len(found) == 1 else replicates.merge(found),
                     SimpleNamespace(genome=first["genome_file"] or getattr(a, "genome", None), regions=first["region_type"], min_length=first["min_length"], flank=first["flank_length"]))
    return out


def regions_of(spark: SparkSession, o) -> DataFrame:
    if not o.genome:
        raise ValueError("an annotation is needed: --genome, or a sheet that names one")
    return genome_mapping(o.regions, annotation.read_gff(spark, o.genome), o.min_length, o.flank)


def blocks(found: Samples, a) -> dict[str, dict[str, str]]:
    """Drawings of metagenes by context: lines with their strands apart and together, heat maps, boxes."""
    out = {}
    for c in CONTEXTS:
        own = found.filtered(context=c)
        if all(m.df.isEmpty() for m in own.by_label.values()):
            continue
        drawn = {"all strands": figures.line_plot(own.by_label, a.stat, a.smooth, a.confidence, c)}
        for strand in ("+", "-"):
            side = own.filtered(strand=strand)
            if not any(m.df.isEmpty() for m in side.by_label.values()):
                drawn[f"strand {strand}"] = figures.line_plot(side.by_label, a.stat, a.smooth, title=f"{c} {strand}", merge_strands=False)
        for label, m in own.by_label.items():
            drawn[f"{label}: regions by density"] = figures.heat_map(m, a.rows, None, f"{c}, {label}")
        drawn["regions' means"] = figures.box_plot(own.by_label, c)
        out[c] = drawn
    return out


def run_metagene(spark: SparkSession, a) -> None:
    found = Samples({name: metagene.metagene(d, regions_of(spark, o), a.up, a.body, a.down) for name, (d, o) in inputs(spark, a).items()})
    out = found.line(a.stat, keys=["context"])
    saves.save_tsv(out if a.sheet else out.drop("label"), a.out)
    if a.html:
        report.save(spark, a.html, report.page("Metagenes", blocks(found, a)))


def run_levels(spark: SparkSession, a) -> None:
    found = {name: chromosomes.levels(d, a.window, a.min_length) for name, (d, _) in inputs(spark, a).items()}
    tables = {name: chromosomes.plot(lv) for name, lv in found.items()}
    if a.sheet:
        saves.save_samples(tables, a.out, merged=True)
    else:
        saves.save_tsv(next(iter(tables.values())), a.out)
    if a.html:
        report.save(spark, a.html, report.page("Chromosome levels", {c: {name: figures.levels_plot(lv, c, a.smooth, name) for name, lv in found.items()} for c in CONTEXTS}))


def run_category(spark: SparkSession, a) -> None:
    """All categorised regions in one table, each class by itself below ``out``-classes as browsers read it, and the classes' metagenes."""
    tables, drawn = {}, {}
    for name, (d, o) in inputs(spark, a).items():
        regions = regions_of(spark, o)
        classes = binomial.categorise(binomial.wide(binomial.region_pvalues(d, regions)), a.context, a.p_value, a.min_n)
        tables[name] = classes
        for kind in ("BM", "IM", "UM"):
            saves.save_regions(classes.where(F.col("category") == kind), f"{a.out}-classes/{name}/{kind}")
        if a.html:
            m = metagene.metagene(d, regions, a.up, a.body, a.down)
            per = {kind: metagene.filtered(m, context=a.context, genome=classes.where(F.col("category") == kind)) for kind in ("BM", "IM", "UM")}
            per = {kind: x for kind, x in per.items() if not x.df.isEmpty()}
            drawn[name] = {"classes": figures.line_plot(per, a.stat, a.smooth, title=a.context)} if per else {}
    if a.sheet:
        saves.save_samples(tables, a.out, merged=True)
    else:
        saves.save_tsv(next(iter(tables.values())), a.out)
    if a.html:
        report.save(spark, a.html, report.page("Categories", drawn))


def run_bam(spark: SparkSession, a) -> None:
    raw = sam.read_sam(spark, a.alignments) if a.alignments.lower().endswith(".sam") else bam.read_bam(spark, a.alignments)
    calls = reads.decoded(reads.exploded_calls(raw), a.min_qual, a.context, not a.drop_converted)
    if a.mode == "stats":
        if a.stat == "PDR":
            saves.save_discordance(reads.discordant_reads(calls, a.length, a.min_depth), a.out)
        else:
            measure, value = {"ME": (reads.methylation_entropy, "entropy"), "EPM": (reads.epipolymorphism, "epipolymorphism")}[a.stat]
            saves.save_windows(measure(calls, a.length, a.min_depth), a.out, value, a.length)
        return
    counts = reads.position_counts(calls)
    if a.fasta:
        index = annotation.open_index(spark, a.fasta).withColumn("strand", F.when(F.col("strand"), "+").otherwise("-"))
        d = reads.full_report(index if a.context is None else index.where(F.col("context") == a.context), counts)
    else:
        d = counts.withColumn("trinuc", F.col("context")).withColumn("density", F.col("count_m") / F.col("count_total"))
    reports.write_report(d, a.out, a.to)


def main(argv=None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("epistrata").getOrCreate()
    {"metagene": run_metagene, "levels": run_levels, "category": run_category, "bam": run_bam}[a.command](spark, a)


if __name__ == "__main__":
    main()
