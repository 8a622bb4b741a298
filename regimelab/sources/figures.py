"""Charts of small tables as SVG: lines with bands and shading, bars, and heat maps. A chart's rows are days, signals or features, and are gathered by the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLOURS = ("#c0392b", "#2471a3", "#229954", "#d68910", "#7d3c98", "#17a589", "#566573", "#a04000", "#1a5276", "#7b7d7d", "#b03a2e", "#117864")
SHADES = {"Low": "#2ca02c", "Medium": "#ff7f0e", "High": "#d62728"}
WIDE, HIGH, EDGE = 420, 190, 42


@dataclass
class Panel:
    """Lines (a name, and points x, y) on common axes; band: points x, low, high; spans: x from, x to, colour."""

    title: str
    lines: list[tuple[str, list[tuple[float, float]]]]
    band: list[tuple[float, float, float]] = field(default_factory=list)
    spans: list[tuple[float, float, str]] = field(default_factory=list)
    log: bool = False


def _finite(v) -> bool:
    return v is not None and math.isfinite(v)


def _panel(p: Panel, left: float, top: float) -> str:
    scale = (lambda v: math.log10(v)) if p.log else (lambda v: v)
    lines = [(name, [(x, scale(y)) for x, y in points if _finite(y) and (y > 0 or not p.log)]) for name, points in p.lines]
    band = [b for b in p.band if _finite(b[1]) and _finite(b[2])]
    xs = [x for _, pts in lines for x, _ in pts] + [b[0] for b in band]
    ys = [y for _, pts in lines for _, y in pts] + [v for b in band for v in b[1:]]
    out = [f'<text x="{left + WIDE / 2}" y="{top - 6}" text-anchor="middle" font-size="11">{escape(p.title)}</text>', f'<rect x="{left}" y="{top}" width="{WIDE}" height="{HIGH}" fill="none" stroke="#888"/>']
    if not xs:
        return "".join(out)
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    at = lambda x, y: (left + WIDE * (x - x0) / ((x1 - x0) or 1), top + HIGH - HIGH * (y - y0) / ((y1 - y0) or 1))
    dots = lambda pts: " ".join(f"{a:.1f},{b:.1f}" for a, b in (at(*q) for q in pts))
    for a, z, colour in p.spans:
        lo, hi = at(max(a, x0), y0)[0], at(min(z, x1), y0)[0]
        out.append(f'<rect x="{lo:.1f}" y="{top}" width="{max(0.0, hi - lo):.1f}" height="{HIGH}" fill="{colour}" opacity="0.15"/>')
    if band:
        out.append(f'<polygon points="{dots([(x, hi) for x, _, hi in band] + [(x, lo) for x, lo, _ in reversed(band)])}" fill="#999" opacity="0.3"/>')
    for i, (name, points) in enumerate(lines):
        colour = COLOURS[i % len(COLOURS)]
        out.append(f'<polyline points="{dots(points)}" fill="none" stroke="{colour}" stroke-width="1"/>')
        if len(lines) > 1:
            out.append(f'<text x="{left + 5}" y="{top + 11 + 10 * i}" font-size="8" fill="{colour}">{escape(name)}</text>')
    label = lambda v: f"{10**v:.3g}" if p.log else f"{v:.3g}"
    out += [f'<text x="{left - 4}" y="{y}" text-anchor="end" font-size="8">{label(v)}</text>' for v, y in ((y1, top + 8), (y0, top + HIGH))]
    out += [f'<text x="{x}" y="{top + HIGH + 10}" text-anchor="{side}" font-size="8">{v:g}</text>' for v, x, side in ((x0, left, "start"), (x1, left + WIDE, "end"))]
    return "".join(out)


def _page(width: float, height: float, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif"><rect width="100%" height="100%" fill="white"/>{body}</svg>'


def line_chart(panels: list[Panel], columns: int = 1) -> str:
    rows = -(-len(panels) // columns)
    wide, high = WIDE + 2 * EDGE, HIGH + EDGE
    return _page(columns * wide, rows * high + EDGE, "".join(_panel(p, (i % columns) * wide + EDGE, (i // columns) * high + EDGE / 1.5) for i, p in enumerate(panels)))


def bar_chart(title: str, names: list[str], series: list[tuple[str, dict[str, float]]]) -> str:
    """Horizontal bars, one for each series of a name."""
    values = [v for _, held in series for v in held.values() if _finite(v)] or [0.0]
    low, high, each, left = min(0.0, *values), max(0.0, *values), 10, 150
    at = lambda v: left + WIDE * (v - low) / ((high - low) or 1)
    out, y = [f'<text x="{left}" y="16" font-size="11">{escape(title)}</text>'], 28
    for name in names:
        out.append(f'<text x="{left - 5}" y="{y + each * len(series) / 2 + 3}" text-anchor="end" font-size="9">{escape(name)}</text>')
        for i, (_, held) in enumerate(series):
            v = held.get(name)
            if _finite(v):
                a, b = sorted((at(0.0), at(v)))
                out.append(f'<rect x="{a:.1f}" y="{y + i * each}" width="{b - a:.1f}" height="{each - 1}" fill="{COLOURS[i]}"><title>{v:.4g}</title></rect>')
        y += each * len(series) + 4
    out += [f'<text x="{left + 120 * i}" y="{y + 14}" font-size="9" fill="{COLOURS[i]}">{escape(name)}</text>' for i, (name, _) in enumerate(series)]
    return _page(left + WIDE + EDGE, y + 24, "".join(out))


def heat_map(title: str, rows: list[str], columns: list[str], cells: dict[tuple[str, str], float], low: float, high: float) -> str:
    each, left, top, out = 34, 130, 130, [f'<text x="10" y="16" font-size="11">{escape(title)}</text>']
    for i, r in enumerate(rows):
        out.append(f'<text x="{left - 5}" y="{top + each * i + 20}" text-anchor="end" font-size="9">{escape(r)}</text>')
        for j, c in enumerate(columns):
            v = cells.get((r, c))
            share = min(1.0, max(0.0, (v - low) / (high - low))) if _finite(v) else 0.5
            red, blue = round(255 * min(1.0, 2 * share)), round(255 * min(1.0, 2 - 2 * share))
            x, y = left + each * j, top + each * i
            out.append(f'<rect x="{x}" y="{y}" width="{each}" height="{each}" fill="rgb({red},{min(red, blue)},{blue})"/><text x="{x + each / 2}" y="{y + 20}" text-anchor="middle" font-size="8">{"" if not _finite(v) else f"{v:.2f}"}</text>')
    out += [f'<text x="{left + each * j + 20}" y="{top - 5}" font-size="9" transform="rotate(-60 {left + each * j + 20} {top - 5})">{escape(c)}</text>' for j, c in enumerate(columns)]
    return _page(left + each * len(columns) + 20, top + each * len(rows) + 20, "".join(out))


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text as one file, in any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def curves(df: DataFrame, x: str, ys: list[str]) -> dict[str, list[tuple[float, float]]]:
    """Points of each column by x; a date counts in years."""
    at = F.col(x) if dict(df.dtypes)[x] != "date" else F.round(F.year(x) + F.dayofyear(x) / 366, 4)
    rows = df.select(at.cast("double").alias("x"), *[F.col(f"`{y}`").cast("double").alias(f"y{i}") for i, y in enumerate(ys)]).orderBy("x").collect()
    return {y: [(r[0], r[i + 1]) for r in rows] for i, y in enumerate(ys)}


def grouped(df: DataFrame, key: str, x: str, *ys: str) -> dict[str, list[tuple]]:
    """Rows (x, ys) of each key, by x."""
    out: dict[str, list[tuple]] = {}
    for r in df.select(F.col(key).cast("string"), F.col(x).cast("double"), *[F.col(y).cast("double") for y in ys]).orderBy(key, x).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def study_figures(study) -> dict[str, object]:
    """The study's charts by file name: functions of the study that return an SVG text."""

    def signals(s):
        table = s.signal_chart()
        names = [c for c in table.columns if c != "date"]
        return line_chart([Panel(n, [(n, points)]) for n, points in curves(table, "date", names).items()])

    def regimes(s):
        table = s.regime_chart()
        held = curves(table, "date", ["close", "P_High", "P_High_wf"])
        named = table.select(F.round(F.year("date") + F.dayofyear("date") / 366, 4).alias("x"), "regime_hmm").orderBy("x").collect()
        spans, start = [], 0
        for i in range(1, len(named) + 1):
            if i == len(named) or named[i].regime_hmm != named[start].regime_hmm:
                spans.append((named[start].x, named[min(i, len(named) - 1)].x, SHADES[named[start].regime_hmm]))
                start = i
        return line_chart([Panel("Price by hidden regime", [("close", held["close"])], spans=spans, log=True), Panel("P(High)", [(n, held[n]) for n in ("P_High", "P_High_wf")])])

    def transition(s):
        rows = s.transition_matrix().collect()
        names = ["Low", "Medium", "High"]
        return heat_map("Regime transition matrix", names, names, {(r["now"], c): r[c] for r in rows for c in names}, 0.0, 1.0)

    def _importance(s, title, scopes):
        held = {scope: {} for scope in scopes}
        for r in s.state_importance.where(F.col("scope").isin(*scopes)).collect():
            held[r.scope][r.feature] = r.importance
        first = held[scopes[0]] or next((h for h in held.values() if h), {})
        return bar_chart(title, sorted(first, key=lambda f: -first[f]), list(held.items()))

    def equity(s):
        from ..operators.backtest import equity as of

        return line_chart([Panel("Equity, net of costs", list(grouped(of(s.held), "model", "pos", "equity").items()), log=True)])

    def path(s):
        held = grouped(s.onset_path(), "signal", "t", "mean", "low", "high", "placebo")
        return line_chart([Panel(n, [("onsets", [(r[0], r[1]) for r in rows]), ("placebo days", [(r[0], r[4]) for r in rows])], [(r[0], r[2], r[3]) for r in rows]) for n, rows in held.items()], 2)

    def decay(s):
        return line_chart([Panel(title, list(grouped(s.factor_decay(rest), "feature", "h", "ic").items())) for title, rest in (("Rank IC", False), ("Rank IC of what the baseline leaves", True))], 2)

    def redundancy(s):
        return heat_map("Spearman correlation of features", s.inputs, s.inputs, {(r.a, r.b): r.rho for r in s.feature_corr().collect()}, -1.0, 1.0)

    def movers(s):
        held = grouped(s.event_study(), "signal", "t", "mean", "low", "high")
        return line_chart([Panel(n, [("mean", [(r[0], r[1]) for r in rows])], [(r[0], r[2], r[3]) for r in rows]) for n, rows in held.items()], 3)

    return {
        "fig1_signals.svg": signals, "fig2_regimes.svg": regimes, "fig3_transition.svg": transition,
        "fig4_importance.svg": lambda s: _importance(s, "Permutation importance, one day ahead", ["all"]), "fig5_equity.svg": equity, "fig6_event_study.svg": path,
        "fig7_ic_decay.svg": decay, "fig8_feature_corr.svg": redundancy, "fig9_who_moves_first.svg": movers,
        "fig11_importance_by_state.svg": lambda s: _importance(s, "Permutation importance, five days ahead", ["transition", "calm"]),
    }


def write_figures(study, folder: str) -> dict[str, str]:
    """What became of each chart, written to folder; one that fails leaves the others alone."""
    step = lambda name, make: lambda s: write_text(s.spark, make(s), f"{folder}/{name}")
    return study.run({name: step(name, make) for name, make in study_figures(study).items()})
