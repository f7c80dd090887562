"""Plots of scans as SVG text. Spark thins the points to one for each pixel, so the driver gets a picture's worth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, MARGIN = 1000, 400, 40
#: Two shades for neighbouring chromosomes, and that of highlighted points.
SHADES, MARK = ("#30638e", "#8fa9bf"), "#d1495b"


def _log(p: str) -> Column:
    return -F.log10(F.greatest(F.col(p), F.lit(1e-300)))


def _svg(points: list[tuple[float, float, str]], lines: list[tuple[float, float, float, float]] = (), labels: list[tuple[float, float, str]] = (), height: int = HEIGHT) -> str:
    body = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" font-family="sans-serif" font-size="11">', f'<rect width="{WIDTH}" height="{height}" fill="white"/>']
    body += [f'<line x1="{a:.1f}" y1="{b:.1f}" x2="{c:.1f}" y2="{d:.1f}" stroke="#999" stroke-dasharray="4"/>' for a, b, c, d in lines]
    body += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="2" fill="{colour}"/>' for x, y, colour in points]
    body += [f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="middle">{text}</text>' for x, y, text in labels]
    return "\n".join([*body, "</svg>"])


def chromosome_order(name: Column) -> Column:
    """Numbers in their order, then names."""
    plain = F.regexp_replace(name, "(?i)^chr", "")
    return F.coalesce(plain.try_cast("int"), F.when(F.upper(plain) == "X", 1000).when(F.upper(plain) == "Y", 1001).when(F.upper(plain).isin("M", "MT"), 1002), F.lit(1003))


def layout(scan: DataFrame) -> list[tuple[str, float, float]]:
    """(chromosome, start, width) along a line of length one, by each chromosome's last position."""
    ends = scan.groupBy("chr").agg(F.max("pos").alias("end"), chromosome_order(F.first("chr")).alias("k")).orderBy("k", "chr").collect()
    total = sum(r["end"] for r in ends) or 1
    out, at = [], 0.0
    for r in ends:
        out.append((r["chr"], at, r["end"] / total))
        at += r["end"] / total
    return out


def _pixels(scan: DataFrame, value: Column, places: list[tuple[str, float, float]], top: float) -> list[tuple[str, float, float]]:
    """(chromosome, place, height) in shares of the plot, one point for each pixel."""
    start = F.coalesce(*(F.when(F.col("chr") == c, a) for c, a, _ in places))
    ends = {r["chr"]: r["e"] for r in scan.groupBy("chr").agg(F.max("pos").alias("e")).collect()}
    share = F.coalesce(*(F.when(F.col("chr") == c, F.col("pos") / max(ends[c], 1) * w) for c, _, w in places))
    x, y = F.round((start + share) * (WIDTH - 2 * MARGIN)), F.round(F.least(value / top, F.lit(1.0)) * (HEIGHT - 2 * MARGIN))
    rows = scan.select("chr", x.alias("x"), y.alias("y")).where("y IS NOT NULL AND NOT isnan(y)").distinct().collect()
    return [(r["chr"], r["x"] / (WIDTH - 2 * MARGIN), r["y"] / (HEIGHT - 2 * MARGIN)) for r in rows]


def _top(*scans: DataFrame, p: str = "p") -> float:
    return max(2.0, *(min(s.agg(F.max(_log(p)).alias("m")).first()["m"] or 2.0, 320.0) * 1.05 for s in scans))


def manhattan(scan: DataFrame, p: str = "p", threshold: float = 5e-8) -> str:
    """-log10 p along the genome; scan: (chr, pos, p)."""
    places, top = layout(scan), _top(scan, p=p)
    order = {c: k for k, (c, _, _) in enumerate(places)}
    x, y = (lambda v: MARGIN + v * (WIDTH - 2 * MARGIN)), (lambda v: HEIGHT - MARGIN - v * (HEIGHT - 2 * MARGIN))
    cut = -math.log10(threshold) / top
    points = [(x(a), y(b), MARK if b >= cut else SHADES[order[c] % 2]) for c, a, b in _pixels(scan, _log(p), places, top)]
    lines = [(MARGIN, y(cut), WIDTH - MARGIN, y(cut))] if cut <= 1 else []
    return _svg(points, lines, [(x(a + w / 2), HEIGHT - MARGIN / 2, c) for c, a, w in places])


def miami(upper: DataFrame, lower: DataFrame, p: str = "p") -> str:
    """Two scans, one up and one down, on one line of chromosomes."""
    places, top = layout(upper.select("chr", "pos").unionByName(lower.select("chr", "pos"))), _top(upper, lower, p=p)
    order = {c: k for k, (c, _, _) in enumerate(places)}
    half = HEIGHT - MARGIN
    x = lambda v: MARGIN + v * (WIDTH - 2 * MARGIN)
    points = [(x(a), half - b * (half - MARGIN), SHADES[order[c] % 2]) for c, a, b in _pixels(upper, _log(p), places, top)]
    points += [(x(a), half + b * (half - MARGIN), SHADES[order[c] % 2]) for c, a, b in _pixels(lower, _log(p), places, top)]
    return _svg(points, [(MARGIN, half, WIDTH - MARGIN, half)], [(x(a + w / 2), half + 4, c) for c, a, w in places], 2 * half)


def circular(scan: DataFrame, p: str = "p") -> str:
    """-log10 p around a circle of chromosomes."""
    places, top = layout(scan), _top(scan, p=p)
    order = {c: k for k, (c, _, _) in enumerate(places)}
    centre, inner, outer = WIDTH / 2, 150.0, 420.0

    def at(share: float, radius: float) -> tuple[float, float]:
        angle = 2 * math.pi * share - math.pi / 2
        return centre + radius * math.cos(angle), centre + radius * math.sin(angle)

    points = [(*at(a, inner + b * (outer - inner)), SHADES[order[c] % 2]) for c, a, b in _pixels(scan, _log(p), places, top)]
    return _svg(points, (), [(*at(a + w / 2, outer + 25), c) for c, a, w in places], WIDTH)


def qq(scan: DataFrame, p: str = "p") -> str:
    """Observed against expected -log10 p, by counts of observed values in fine steps."""
    step = 0.01
    counts = scan.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(F.round(_log(p) / step).cast("long").alias("k")).count().orderBy(F.col("k").desc()).collect()
    n = sum(r["count"] for r in counts)
    points, above = [], 0
    far = max([r["k"] * step for r in counts] + [math.log10(max(n, 2)), 1.0])
    scale = lambda v: v / far
    for r in counts:
        expected = -math.log10((above + (r["count"] + 1) / 2) / (n + 1))
        above += r["count"]
        points.append((MARGIN + scale(expected) * (WIDTH - 2 * MARGIN), HEIGHT - MARGIN - scale(r["k"] * step) * (HEIGHT - 2 * MARGIN), SHADES[0]))
    return _svg(points, [(MARGIN, HEIGHT - MARGIN, WIDTH - MARGIN, MARGIN)])


def trumpet(scan: DataFrame, af: str = "af", beta: str = "beta") -> str:
    """Effect against minor allele frequency on a log scale, one point for each pixel."""
    maf = F.greatest(F.least(F.col(af), 1 - F.col(af)), F.lit(1e-4))
    most = scan.agg(F.max(F.abs(beta)).alias("m")).first()["m"] or 1.0
    x = F.round((F.log10(maf) + 4) / (4 + math.log10(0.5)) * (WIDTH - 2 * MARGIN))
    y = F.round(F.col(beta) / most * (HEIGHT / 2 - MARGIN))
    rows = scan.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)").distinct().collect()
    return _svg([(MARGIN + r["x"], HEIGHT / 2 - r["y"], SHADES[0]) for r in rows], [(MARGIN, HEIGHT / 2, WIDTH - MARGIN, HEIGHT / 2)])


def triangle(pairs: DataFrame, variants: DataFrame, most: int = 400) -> str:
    """LD of neighbouring variants as a triangle of squares; at most ``most`` variants, as more can't be told apart."""
    names = [r["v_idx"] for r in variants.orderBy("chr", "pos", "v_idx").limit(most + 1).select("v_idx").collect()]
    if len(names) > most:
        raise ValueError(f"a triangle of more than {most} variants can't be read; choose a region")
    place = {v: k for k, v in enumerate(names)}
    size = (WIDTH - 2 * MARGIN) / max(len(names), 1)
    body = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {WIDTH / 2}">']
    for r in pairs.where(F.col("i").isin(names) & F.col("j").isin(names)).select("i", "j", "r").collect():
        a, b = sorted((place[r["i"]], place[r["j"]]))
        x, y = MARGIN + (a + b + 1) / 2 * size, MARGIN + (b - a) / 2 * size
        shade = round(255 * (1 - min(r["r"] ** 2, 1.0)))
        h = size / 2
        body.append(f'<polygon points="{x:.1f},{y - h:.1f} {x + h:.1f},{y:.1f} {x:.1f},{y + h:.1f} {x - h:.1f},{y:.1f}" fill="rgb(255,{shade},{shade})"/>')
    return "\n".join([*body, "</svg>"])
