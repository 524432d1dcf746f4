"""Lines, grids, boxes and points as SVG text. All take what an analysis has brought to the driver: some thousands of numbers."""

from __future__ import annotations

import math
from html import escape

import numpy as np

WIDTH, HEIGHT, MARGIN = 640, 400, 56
COLOURS = ("#1f6f8b", "#c8553d", "#588b4a", "#8d6a9f", "#b8860b", "#444444", "#2a9d8f", "#e07a5f")


def _finite(values) -> list[float]:
    return [float(v) for v in values if v is not None and math.isfinite(v)]


class Frame:
    """Maps data to the drawing's places."""

    def __init__(self, x, y, zero: bool = False):
        x, y = _finite(x) or [0.0], _finite(y) or [0.0]
        self.x0, self.x1 = min(x), max(x)
        self.y0, self.y1 = min(y + [0.0] if zero else y), max(y)
        self.x1 += self.x1 == self.x0
        self.y1 += self.y1 == self.y0

    def x(self, v: float) -> float:
        return round(MARGIN + (v - self.x0) / (self.x1 - self.x0) * (WIDTH - 2 * MARGIN), 2)

    def y(self, v: float) -> float:
        return round(HEIGHT - MARGIN - (v - self.y0) / (self.y1 - self.y0) * (HEIGHT - 2 * MARGIN), 2)


def _text(x: float, y: float, s: str, anchor: str = "middle", size: int = 12) -> str:
    return f'<text x="{x}" y="{y}" text-anchor="{anchor}" font-size="{size}">{escape(s)}</text>'


def _drawing(parts: list[str], title: str) -> str:
    return (f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" role="img">'
            f"<title>{escape(title)}</title>{_text(WIDTH / 2, 24, title, size=15)}{''.join(parts)}</svg>")


def _axes(f: Frame, ticks: dict[float, str] | None, borders=(), label: str = "") -> list[str]:
    left, right, low, high = MARGIN, WIDTH - MARGIN, HEIGHT - MARGIN, MARGIN
    out = [f'<path d="M{left} {high}V{low}H{right}" fill="none" stroke="#333"/>']
    for v in np.linspace(f.y0, f.y1, 5):
        out.append(_text(left - 6, f.y(v) + 4, f"{v:.3g}", "end"))
    for v, name in (ticks if ticks is not None else {x: f"{x:.3g}" for x in np.linspace(f.x0, f.x1, 5)}).items():
        out.append(_text(f.x(v), low + 18, name))
    out += [f'<path d="M{f.x(b)} {high}V{low}" stroke="#999" stroke-dasharray="4 3"/>' for b in borders]
    return out + [_text(14, HEIGHT / 2, label, "start")] * bool(label)


def _legend(names) -> list[str]:
    return [f'<rect x="{WIDTH - MARGIN - 110}" y="{MARGIN + 16 * i}" width="10" height="10" fill="{COLOURS[i % len(COLOURS)]}"/>' + _text(WIDTH - MARGIN - 94, MARGIN + 9 + 16 * i, str(n), "start") for i, n in enumerate(names)]


def line(lines: dict[str, list], title: str = "", ticks: dict[float, str] | None = None, borders=(), bands: dict[str, tuple[list, list]] | None = None) -> str:
    """A line per name, broken where a value is missing; ``bands``: lower and upper bounds by name."""
    bands = bands or {}
    every = [v for y in [*lines.values(), *(b for pair in bands.values() for b in pair)] for v in y]
    f = Frame([0, max((len(y) for y in lines.values()), default=1) - 1], every)
    parts = _axes(f, ticks, borders)
    for i, (name, y) in enumerate(lines.items()):
        colour = COLOURS[i % len(COLOURS)]
        if name in bands:
            low, high = bands[name]
            pairs = [(k, a, b) for k, (a, b) in enumerate(zip(low, high)) if a is not None and b is not None and math.isfinite(a) and math.isfinite(b)]
            points = [f"{f.x(k)},{f.y(a)}" for k, a, _ in pairs] + [f"{f.x(k)},{f.y(b)}" for k, _, b in reversed(pairs)]
            parts.append(f'<polygon points="{" ".join(points)}" fill="{colour}" fill-opacity="0.2"/>')
        d, pen = [], False
        for k, v in enumerate(y):
            known = v is not None and math.isfinite(v)
            if known:
                d.append(f"{'L' if pen else 'M'}{f.x(k)} {f.y(v)}")
            pen = known
        parts.append(f'<path d="{"".join(d)}" fill="none" stroke="{colour}" stroke-width="1.6"/>')
    return _drawing(parts + _legend(lines), title)


def heat(grid: np.ndarray, title: str = "", ticks: dict[float, str] | None = None, borders=()) -> str:
    """A cell per number, dark where it is large; missing ones white."""
    rows, columns = grid.shape
    known = _finite(grid.ravel())
    low, high = min(known, default=0.0), max(known, default=1.0)
    f = Frame([0, columns], [0, rows])
    w, h = (WIDTH - 2 * MARGIN) / max(1, columns), (HEIGHT - 2 * MARGIN) / max(1, rows)
    cells = []
    for i in range(rows):
        for j in range(columns):
            v = float(grid[i, j])
            shade = 0.0 if not math.isfinite(v) else (v - low) / ((high - low) or 1)
            cells.append(f'<rect x="{MARGIN + j * w:.2f}" y="{MARGIN + i * h:.2f}" width="{w + 0.1:.2f}" height="{h + 0.1:.2f}" fill="rgb({round(250 - 220 * shade)},{round(250 - 150 * shade)},{round(250 - 90 * shade)})"/>')
    return _drawing(cells + _axes(f, ticks, borders) + [_text(WIDTH - MARGIN, MARGIN - 8, f"{low:.3g} to {high:.3g}", "end")], title)


def box(stats: dict[str, tuple[float, float, float, float, float]], title: str = "") -> str:
    """(low whisker, first quartile, median, third quartile, high whisker) per name."""
    f = Frame([-0.5, len(stats) - 0.5], [v for s in stats.values() for v in s])
    parts = _axes(f, {i: n for i, n in enumerate(stats)})
    half = (f.x(0.3) - f.x(0)) if stats else 0
    for i, (low, q1, median, q3, high) in enumerate(stats.values()):
        x, c = f.x(i), COLOURS[i % len(COLOURS)]
        parts.append(f'<path d="M{x} {f.y(low)}V{f.y(q1)}M{x} {f.y(q3)}V{f.y(high)}" stroke="{c}"/><rect x="{x - half:.2f}" y="{f.y(q3)}" width="{2 * half:.2f}" height="{f.y(q1) - f.y(q3):.2f}" fill="{c}" fill-opacity="0.3" stroke="{c}"/>'
                     f'<path d="M{x - half:.2f} {f.y(median)}H{x + half:.2f}" stroke="{c}" stroke-width="2"/>')
    return _drawing(parts, title)


def points(places: dict[str, tuple[float, float]], title: str = "", x: str = "", y: str = "") -> str:
    """A named point each, as for principal components."""
    f = Frame([p[0] for p in places.values()], [p[1] for p in places.values()])
    parts = _axes(f, None, label=y) + [_text(WIDTH / 2, HEIGHT - 12, x)]
    for i, (name, (a, b)) in enumerate(places.items()):
        parts.append(f'<circle cx="{f.x(a)}" cy="{f.y(b)}" r="5" fill="{COLOURS[i % len(COLOURS)]}"/>' + _text(f.x(a), f.y(b) - 8, name))
    return _drawing(parts, title)


def bars(values: dict[str, float], title: str = "") -> str:
    """A bar per name, from zero."""
    f = Frame([-0.5, len(values) - 0.5], values.values(), zero=True)
    f.y1 = max(f.y1, 0.0)
    half = f.x(0.35) - f.x(0) if values else 0
    parts = _axes(f, {i: n for i, n in enumerate(values)})
    for i, v in enumerate(values.values()):
        top, bottom = min(f.y(v), f.y(0)), max(f.y(v), f.y(0))
        parts.append(f'<rect x="{f.x(i) - half:.2f}" y="{top}" width="{2 * half:.2f}" height="{bottom - top:.2f}" fill="{COLOURS[i % len(COLOURS)]}"/>')
    return _drawing(parts, title)
