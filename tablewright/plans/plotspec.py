"""Vega-Lite specifications of the engine's plots, as plain dictionaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"
#: Size of a chart, and ticks along x.
WIDTH, HEIGHT, TICKS = 480, 300, 6


def short(n: int) -> str:
    """1234567 as 1M, 12345 as 12k."""
    for size, sign in ((10**6, "M"), (10**3, "k")):
        if n >= size:
            return f"{n // size}{sign}"
    return str(n)


def log_ticks(low: float, high: float, n: int = TICKS) -> list[int]:
    """About ``n`` round values at equal ratios."""
    out = set()
    for k in range(n):
        value = 2 ** (math.log2(low) + (math.log2(high) - math.log2(low)) * k / max(1, n - 1))
        out.add(int(round(value, 0 if value < 100 else -1 if value < 1000 else -2)))
    return sorted(out)


def count_ticks(most: int) -> list[int]:
    return list(range(0, most + 1, max(1, most // 5)))


def _axis(values: list[int], **more) -> dict:
    return {"values": values, "format": "~s", **more}


def log_histogram(rows: Sequence, column: str, dataset: str, low: float, high: float) -> dict:
    """A bar chart of histogram rows (bin_left, bin_right, bin_center, count) over a logarithmic axis."""
    ticks = log_ticks(low, high)
    return {
        "$schema": SCHEMA,
        "title": f"Histogram of '{column}' in {dataset}",
        "width": WIDTH,
        "height": HEIGHT,
        "data": {"values": [{k: r[k] for k in ("bin_left", "bin_right", "bin_center", "count")} for r in rows]},
        "mark": {"type": "bar", "width": WIDTH / (2 * max(1, len(rows)))},
        "encoding": {
            "x": {"field": "bin_center", "type": "quantitative", "title": column, "scale": {"type": "log"}, "axis": _axis(ticks, tickCount=len(ticks))},
            "y": {"field": "count", "type": "quantitative", "title": "Count", "axis": _axis(count_ticks(max((r["count"] for r in rows), default=0)))},
            "tooltip": [{"field": f, "type": "quantitative"} for f in ("bin_left", "bin_right", "count")],
        },
    }


def linear_histogram(rows: Sequence, column: str, dataset: str) -> dict:
    return {
        "$schema": SCHEMA,
        "title": f"Histogram of '{column}' in {dataset}",
        "data": {"values": [{k: r[k] for k in ("bin_left", "bin_right", "count")} for r in rows]},
        "mark": "bar",
        "encoding": {
            "x": {"field": "bin_left", "type": "quantitative", "bin": {"binned": True}, "title": column},
            "x2": {"field": "bin_right"},
            "y": {"field": "count", "type": "quantitative", "title": "Count"},
        },
    }


def boxplot(row, column: str, dataset: str) -> dict:
    """A box with whiskers from the one row of statistics."""
    layers = (
        ({"type": "rule"}, {"y": {"field": "low_whisker", "type": "quantitative", "title": column}, "y2": {"field": "high_whisker"}}),
        ({"type": "bar", "size": 14}, {"y": {"field": "q1", "type": "quantitative"}, "y2": {"field": "q3"}}),
        ({"type": "tick", "color": "white", "size": 14}, {"y": {"field": "median", "type": "quantitative"}}),
    )
    return {
        "$schema": SCHEMA,
        "title": f"Box plot of '{column}' in {dataset}",
        "data": {"values": [{k: row[k] for k in ("min", "low_whisker", "q1", "median", "q3", "high_whisker", "max")}]},
        "layer": [{"mark": m, "encoding": e} for m, e in layers],
    }


def line(rows: Sequence, column: str, dataset: str) -> dict:
    """A line over time from rows (start, rows, total), and the number of rows beside it."""
    values = [{"start": r["start"].isoformat(), "rows": r["rows"], "total": r["total"]} for r in rows]
    return {
        "$schema": SCHEMA,
        "title": f"'{column}' over time in {dataset}",
        "data": {"values": values},
        "mark": {"type": "line", "point": True},
        "encoding": {
            "x": {"field": "start", "type": "temporal", "title": "Time"},
            "y": {"field": "total", "type": "quantitative", "title": column},
            "tooltip": [{"field": f} for f in ("start", "rows", "total")],
        },
    }
