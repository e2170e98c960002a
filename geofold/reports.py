"""HTML reports from small results, drawn with tables and inline SVG."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

from geofold.functions.classes import COLORS, CLASSES, NAMES

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:4px 8px;text-align:right}"


def table(df: DataFrame, limit: int = 200) -> str:
    """Rows of a small result; beyond ``limit`` the number left out is told."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    body = "".join("<tr>" + "".join(f"<td>{escape(cell(v))}</td>" for v in r) + "</tr>" for r in rows[:limit])
    more = f"<p>more than {limit} rows</p>" if len(rows) > limit else ""
    return f"<table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>{body}</table>{more}"


def matrix(shares: DataFrame) -> str:
    """(t, p, share) as a shaded square."""
    cells = {(r["t"], r["p"]): r["share"] for r in shares.select("t", "p", "share").collect()}
    ks = sorted({k for tp in cells for k in tp})
    name = lambda k: NAMES.get(k, f"class_{k}")
    side, left = 44, 80
    out = [f'<text x="{left + i * side + 4}" y="14" font-size="11">{escape(name(k))}</text><text x="2" y="{40 + i * side}" font-size="11">{escape(name(k))}</text>' for i, k in enumerate(ks)]
    for i, t in enumerate(ks):
        for j, p in enumerate(ks):
            v = cells.get((t, p), 0.0)
            out.append(f'<rect x="{left + j * side}" y="{20 + i * side}" width="{side}" height="{side}" fill="#0b559f" fill-opacity="{v:.3f}" stroke="#ccc"/><text x="{left + j * side + 8}" y="{46 + i * side}" font-size="11">{v:.2f}</text>')
    size = left + side * len(ks)
    return f'<svg width="{size}" height="{size}" role="img" aria-label="confusion matrix, rows are the truth">{"".join(out)}</svg>'


def bars(rows: list[tuple[str, float]], colors: list[str] | None = None) -> str:
    """Values from 0 to 1 as horizontal bars."""
    out = []
    for i, (label, v) in enumerate(rows):
        color = colors[i] if colors else "#0b559f"
        out.append(f'<text x="0" y="{16 + i * 22}" font-size="12">{escape(label)}</text><rect x="110" y="{4 + i * 22}" width="{300 * max(0.0, min(1.0, v)):.1f}" height="16" fill="{color}"/><text x="420" y="{16 + i * 22}" font-size="12">{v:.3f}</text>')
    return f'<svg width="480" height="{8 + 22 * len(rows)}" role="img" aria-label="values">{"".join(out)}</svg>'


def density_map(cells: DataFrame, grid: int) -> str:
    """(row, col, rate) of a grid, row 0 at the bottom; cells without points stay empty."""
    side = 20
    out = [f'<rect x="{r["col"] * side}" y="{(grid - 1 - r["row"]) * side}" width="{side}" height="{side}" fill="#b00" fill-opacity="{r["rate"]:.3f}" stroke="#ddd"/>' for r in cells.collect()]
    return f'<svg width="{grid * side}" height="{grid * side}" role="img" aria-label="error density">{"".join(out)}</svg>'


def page(title: str, *parts: str) -> str:
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>"


def accuracy_report(metrics: DataFrame, per_class: DataFrame, shares: DataFrame, warnings: DataFrame, density: DataFrame | None = None, grid: int = 10) -> str:
    rows = per_class.select("class", "f1").orderBy("class").collect()
    colors = [COLORS.get(CLASSES.get(r["class"], -1), "#888") for r in rows]
    parts = ["<h2>Overall</h2>", table(metrics), "<h2>Classes</h2>", table(per_class), bars([(r["class"], r["f1"]) for r in rows], colors), "<h2>Confusion</h2>", matrix(shares)]
    if not warnings.isEmpty():
        parts += ["<h2>Small samples</h2>", table(warnings)]
    if density is not None:
        parts += ["<h2>Errors by place</h2>", density_map(density, grid)]
    return page("Accuracy", *parts)


def comparison_report(ranking: DataFrame, pairs: DataFrame) -> str:
    rows = ranking.orderBy("rank").collect()
    return page("Models compared", "<h2>Ranking</h2>", table(ranking.orderBy("rank")), bars([(r["model"], r["accuracy"]) for r in rows]), "<h2>Agreement</h2>", table(pairs))
