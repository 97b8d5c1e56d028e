"""How a measure's distribution changes over time: each period against the one before it.

Exactly, from counts of values: the Kolmogorov-Smirnov distance (greatest difference of the two cumulative shares) and the population stability index over bins, sum of (p - q) ln(p / q). Values
are counted by period first, so what goes on is a row for each period and distinct value; for continuous values of large tables there are sketches instead: KLL quantile sketches by period, which merge
(a period's from those of its days), give the distance at a fixed grid of quantiles, within the sketches' rank error.

Null and NaN values and rows without a time are left out; a period without values has no row, and the one before is the last that has some. Infinite values are values. Of equal values each counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bins of the stability index: quantiles of the first of the two periods. Shares are at least ``FLOOR``, so that empty bins count but not without bound.
BINS, FLOOR = 10, 1e-4
#: A KLL sketch's size; the rank of a quantile is wrong by 0.9 % for one sketch and by 1.65 % at most in 99 % of cases, both sides doubled for a distance of two.
KLL_K, KLL_ERROR = 400, 0.0165


def counts(df: DataFrame, period: Column, value: Column) -> DataFrame:
    """(period, v, n): rows by period and value."""
    made = df.select(period.alias("period"), value.cast("double").alias("v"))
    return made.filter(F.col("period").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")).groupBy("period", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _neighbours(periods: DataFrame) -> DataFrame:
    """(period, before) of periods; as many rows as periods."""
    return periods.withColumn("before", F.lag("period").over(Window.orderBy("period"))).filter(F.col("before").isNotNull())


def ks(counted: DataFrame) -> DataFrame:
    """(period, before, rows, rows_before, ks) of the values counted by ``counts``.

    Both periods' values of a pair are put in one order, with a running count of each; a pair's distinct values are sorted in one task, pairs are spread.
    """
    totals = counted.groupBy("period").agg(F.sum("n").alias("total"))
    pairs = F.broadcast(_neighbours(totals.select("period")))  # a row a period
    own = counted.join(pairs, "period").select("period", "before", "v", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    old = counted.withColumnRenamed("period", "before").join(pairs, "before").select("period", "before", "v", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    both = own.unionAll(old).groupBy("period", "before", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = Window.partitionBy("period", "before").orderBy("v")
    run = both.select("period", "before", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    sizes = lambda name, n: F.broadcast(totals.select(F.col("period").alias(name), F.col("total").alias(n)))  # noqa: E731  a row a period
    run = run.join(sizes("period", "rows"), "period").join(sizes("before", "rows_before"), "before")
    far = F.max(F.abs(F.col("a") / F.col("rows") - F.col("b") / F.col("rows_before"))).alias("ks")
    return run.groupBy("period", "before").agg(F.max("rows").alias("rows"), F.max("rows_before").alias("rows_before"), far)


def psi(counted: DataFrame, edges: list[float], floor: float = FLOOR) -> DataFrame:
    """(period, before, psi) over the bins that ascending ``edges`` cut, each with its upper edge; values above the last edge are in one more."""
    bins = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("v")))
    binned = counted.groupBy("period", bins.alias("bin")).agg(F.sum("n").alias("n"))
    whole = binned.groupBy("period").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("of"))  # a row a period, an entry a bin
    shares = F.transform(F.sequence(F.lit(0), F.lit(len(edges))), lambda b: F.greatest(F.coalesce(F.element_at("of", b), F.lit(0)) / F.col("total"), F.lit(floor)))
    each = whole.select("period", shares.alias("p"))
    pairs = each.withColumns({"before": F.lag("period").over(Window.orderBy("period")), "q": F.lag("p").over(Window.orderBy("period"))}).filter(F.col("before").isNotNull())
    terms = F.zip_with("p", "q", lambda p, q: (p - q) * F.log(p / q))
    return pairs.select("period", "before", F.aggregate(terms, F.lit(0.0), lambda t, x: t + x).alias("psi"))


def sketches(df: DataFrame, period: Column, value: Column) -> DataFrame:
    """(period, n, sketch): a KLL sketch of each period's values, some kB each; they merge by ``kll_merge_agg_double``."""
    made = df.select(period.alias("period"), value.cast("double").alias("v")).filter(F.col("period").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return made.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", KLL_K).alias("sketch"))


def merged(sketched: DataFrame, period: Column) -> DataFrame:
    """Sketches of longer periods from those of shorter ones."""
    return sketched.groupBy(period.alias("period")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def ks_of_sketches(sketched: DataFrame, points: int = 200) -> DataFrame:
    """(period, before, ks): the distance as seen at ``points`` quantiles of each of the two, so wrong by 1 / points and the sketches' rank errors at most."""
    last = Window.orderBy("period")
    pairs = sketched.withColumns({"before": F.lag("period").over(last), "old": F.lag("sketch").over(last)}).filter(F.col("before").isNotNull())
    at = F.array(*[F.lit((k + 0.5) / points) for k in range(points)])
    cut = pairs.select("period", "before", *[F.kll_sketch_get_quantile_double(c, at).alias(n) for c, n in (("sketch", "p"), ("old", "q"))])
    upto = lambda values, x: F.size(F.filter(values, lambda y: y <= x)) / F.lit(points)
    return cut.select("period", "before", F.array_max(F.transform(F.array_union("p", "q"), lambda x: F.abs(upto(F.col("p"), x) - upto(F.col("q"), x)))).alias("ks"))
