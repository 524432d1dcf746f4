"""Analyses drawn: each brings its few numbers to the driver and returns SVG."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import savitzky_golay
from ..operators import chromosomes, metagene
from ..operators.metagene import Metagene
from . import svg


def region_ticks(m: Metagene) -> dict[float, str]:
    return dict(zip(metagene.ticks(m), ("upstream", "start", "body", "end", "downstream")))


def line_plot(samples: dict[str, Metagene], stat: str = "wmean", smooth: int = 0, confidence: float = 0.0, title: str = "", **options) -> str:
    """Densities in percent along the windows, a line per sample; with ``confidence``, means and their intervals."""
    lines, bands = {}, {}
    for label, m in samples.items():
        if confidence:
            rows = {r["fragment"]: r for r in metagene.line_with_interval(m, confidence).collect()}
            at = lambda c: [rows[i][c] * 100 if i in rows and rows[i][c] is not None else None for i in range(m.windows)]  # noqa: B023, E731
            lines[label], bands[label] = at("average"), (at("lower"), at("upper"))
        else:
            lines[label] = metagene.smoothed_line(m, smooth, stat=stat, **options)
    m = next(iter(samples.values()))
    return svg.line(lines, title, region_ticks(m), metagene.borders(m), bands)


def contexts_plot(m: Metagene, smooth: int = 0, title: str = "") -> str:
    rows = metagene.line(m, keys=["context"]).orderBy("context", "fragment").collect()
    lines = {}
    for r in rows:
        lines.setdefault(r["context"], []).append(float("nan") if r["density"] is None else r["density"])
    return svg.line({c: (savitzky_golay(y, smooth) * 100).tolist() for c, y in lines.items()}, title, region_ticks(m), metagene.borders(m))


def heat_map(m: Metagene, rows: int = 100, columns: int | None = None, title: str = "") -> str:
    small = metagene.resize(m, columns)
    grid = np.full((rows, small.windows), np.nan)
    for r in metagene.heat_map(m, rows, columns).collect():
        grid[r["row"], r["fragment"]] = r["density"]
    return svg.heat(grid, title, region_ticks(small), metagene.borders(small))


def box_plot(samples: dict[str, Metagene], title: str = "") -> str:
    stats = {}
    for label, m in samples.items():
        r = metagene.box_stats(metagene.box(m).withColumn("label", F.lit(label)), "density", ["label"]).first()
        if r:
            stats[label] = tuple(100 * r[c] for c in ("low", "q1", "median", "q3", "high"))
    return svg.box(stats, title)


def levels_plot(lv: DataFrame, context: str = "CG", smooth: int = 0, title: str = "") -> str:
    p = chromosomes.plot(chromosomes.filtered(lv, context=context))
    t = chromosomes.ticks(p).collect()
    return svg.line({context: chromosomes.smoothed(p, context, smooth)}, title, {r["tick"]: r["chr"] for r in t}, [r["border"] for r in t])


def components_plot(rows: list[tuple], title: str = "") -> str:
    """What ``clusters.principal_components`` gives."""
    at: dict[str, list[float]] = {}
    share = {}
    for component, label, loading, explained in rows:
        at.setdefault(label, []).append(loading)
        share[component] = explained
    return svg.points({k: (v[0], v[1] if len(v) > 1 else 0.0) for k, v in at.items()}, title, f"PC1 ({share.get(0, 0):.1%})", f"PC2 ({share.get(1, 0):.1%})")


def enrichment_plot(rows: DataFrame, title: str = "") -> str:
    return svg.bars({r["type"]: r["enrichment"] for r in rows.orderBy("type").collect()}, title)


def quality_plot(histogram: DataFrame, title: str = "") -> str:
    return svg.bars({str(r["qual"]): r["n"] for r in histogram.orderBy("qual").collect()}, title)
