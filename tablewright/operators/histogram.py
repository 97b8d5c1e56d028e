"""Histograms and box-plot statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.plans.errors import BadRequest

#: Edges of a logarithmic histogram; bins of a linear one.
LOG_EDGES, LINEAR_BINS = 50, 20


def _numeric(df: DataFrame, column: str | None) -> str:
    if column not in df.columns:
        raise BadRequest(f"a plot needs a column of the table, not {column!r}")
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise BadRequest(f"a plot needs a number, {column} is {df.schema[column].dataType.simpleString()}")
    return column


def extent(df: DataFrame, column: str) -> tuple[float, float]:
    """Least and greatest finite value."""
    x = F.col(_numeric(df, column)).cast("double")
    low, high = df.agg(F.min(F.when(~F.isnan(x), x)), F.max(F.when(~F.isnan(x), x))).first()
    if low is None:
        raise BadRequest(f"{column} has no values")
    return low, high


def log_edges(low: float, high: float, n: int = LOG_EDGES) -> list[float]:
    """``n`` edges at equal ratios, the first and last being the extent itself; one edge where both are equal."""
    if low <= 0:
        raise BadRequest("a logarithmic histogram needs positive values")
    if n < 1:
        raise BadRequest("a histogram needs at least one edge")
    if low == high or n == 1:
        return [low]
    a, b = math.log2(low), math.log2(high)
    return [low, *(2 ** (a + (b - a) * k / (n - 1)) for k in range(1, n - 1)), high]


def _edges_below(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending ``bounds`` are less than ``x``.

    Edges at equal ratios are found by a logarithm, which rounding may put one edge off; so the two edges on either side are compared too.
    """
    def counted(first: int, last: int) -> Column:
        return sum(((F.lit(e) < x).cast("int") for e in bounds[first:last]), F.lit(0))

    if len(bounds) < 5 or not _equal_ratios(bounds):
        return counted(0, len(bounds))
    low, step = math.log2(bounds[0]), (math.log2(bounds[-1]) - math.log2(bounds[0])) / (len(bounds) - 1)
    guess = F.floor((F.log2(x) - low) / step).cast("int")
    first = F.greatest(F.lit(0), F.least(guess - 1, F.lit(len(bounds) - 4)))
    steps = F.array(*map(F.lit, bounds))
    near = sum(((F.get(steps, first + k) < x).cast("int") for k in range(4)), first)
    return F.when(x <= bounds[0], 0).otherwise(near)


def _equal_ratios(bounds: list[float]) -> bool:
    want = log_edges(bounds[0], bounds[-1], len(bounds)) if 0 < bounds[0] < bounds[-1] else []
    return len(want) == len(bounds) and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(want, bounds))


def log2_histogram(df: DataFrame, column: str = "token_count", edges: int = LOG_EDGES, bounds: list[float] | None = None) -> DataFrame:
    """Non-empty bins of a logarithmic histogram: bin, bin_left, bin_right, bin_width, bin_center, count.

    Bins are closed on the right; bin 0 reaches up to the first edge, and its left end is shown as 1. What lies beyond the last edge
    gets the width of the bin before. Nulls and NaN are left out.
    """
    x = F.col(_numeric(df, column)).cast("double")
    bounds = [float(e) for e in bounds or log_edges(*extent(df, column), edges)]
    steps = F.array(*map(F.lit, bounds))
    below = _edges_below(F.col("x"), bounds)
    counts = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(below.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    left = F.when(F.col("bin") == 0, F.lit(1.0)).otherwise(F.get(steps, F.col("bin") - 1))
    right = F.get(steps, F.col("bin"))
    shaped = counts.select("bin", "count", left.alias("bin_left"), right.alias("r"))
    before = F.lag(F.col("r") - F.col("bin_left")).over(Window.orderBy("bin"))  # at most one row per bin
    width = F.coalesce(F.col("r") - F.col("bin_left"), before, F.col("bin_left"))
    shaped = shaped.withColumn("bin_width", width).withColumn("bin_right", F.col("bin_left") + F.col("bin_width"))
    return shaped.select("bin", "bin_left", "bin_right", "bin_width", F.sqrt(F.col("bin_left") * F.col("bin_right")).alias("bin_center"), "count").orderBy("bin")


def linear_histogram(df: DataFrame, column: str, bins: int = LINEAR_BINS) -> DataFrame:
    """Non-empty bins of equal width, closed on the left, the last on both sides: bin, bin_left, bin_right, count."""
    low, high = extent(df, column)
    width = (high - low) / bins or 1.0
    x = F.col(column).cast("double")
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_left"), (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_right"), "count").orderBy("bin")


def order_statistics(df: DataFrame, column: str, ranks: list[int], cells: int = 1024) -> dict[int, float]:
    """The exact values at the given ranks (from 0) of a column in ascending order, nulls and NaN left out.

    Each pass is one scan: it counts the values in ``cells`` equal cells of each span that may still hold a rank, and keeps the cells that do, until
    their values are all one. A pass combines on the map side, so memory and shuffle stay small whatever the number of values.
    """
    x = F.col(_numeric(df, column)).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        raise BadRequest(f"{column} has no values")
    open_, out = {(low, high, 0): sorted(set(ranks))}, {}
    while open_:
        for (a, b, _), own in open_.items():
            if a == b:
                out.update(dict.fromkeys(own, a))
        spans = [s for s in open_ if s[0] < s[1]]
        span, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (a, b, _) in enumerate(spans):  # they don't overlap
            # Halves first, so that the cell's width can't overflow.
            place = F.least(F.floor((F.col("x") / 2 - a / 2) / (b / 2 - a / 2) * cells), F.lit(cells - 1))
            inside = F.col("x").between(a, b)
            span, cell = F.when(inside, k).otherwise(span), F.when(inside, place).otherwise(cell)
        found = []
        if spans:
            counted = values.select("x", span.alias("span"), cell.alias("cell")).filter("span is not null").groupBy("span", "cell")
            found = counted.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("span", "cell").collect()
        following: dict[tuple[float, float, int], list[int]] = {}
        for k, (a, b, before) in enumerate(spans):
            for r in (r for r in found if r["span"] == k):
                if own := [t for t in open_[spans[k]] if before <= t < before + r["n"]]:
                    following[(r["low"], r["high"], before)] = own
                before += r["n"]
        open_ = following
    return out


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours."""
    x = F.col(_numeric(df, column)).cast("double")
    n = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).count()
    places = [(n - 1) * s for s in shares]
    at = order_statistics(df, column, [int(k) for p in places for k in (math.floor(p), math.ceil(p))])
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, q1, median, q3, max, and the whiskers, 1.5 times the quartiles' distance at most beyond them."""
    q1, q2, q3 = quantiles(df, column, [0.25, 0.5, 0.75])
    x = F.col(column).cast("double")
    inside = F.when(x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)), x)
    return df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(x).alias("min"),
        F.min(inside).alias("low_whisker"),
        F.lit(q1).alias("q1"),
        F.lit(q2).alias("median"),
        F.lit(q3).alias("q3"),
        F.max(inside).alias("high_whisker"),
        F.max(x).alias("max"),
    )
