"""Token-length outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Shorter than this is too short, longer than that too long; the quantile of outliers.
SHORT, LONG = 5, 10_000
QUANTILE = 0.99


def short_and_long(tokens: Column) -> list[Column]:
    return [F.count_if(tokens < SHORT).alias("too_short"), F.count_if(tokens > LONG).alias("too_long")]


def ends(column: str) -> list[Column]:
    """Aggregates: least and greatest value (0 of nothing), too short and too long ones."""
    return [
        F.coalesce(F.min(column), F.lit(0)).cast("long").alias("min_tokens"),
        F.coalesce(F.max(column), F.lit(0)).cast("long").alias("max_tokens"),
        *short_and_long(F.col(column)),
    ]


def nearest_quantile(df: DataFrame, column: str = "token_count", q: float = QUANTILE) -> DataFrame:
    """One row: ``p99_tokens``, the value at the index nearest to (n - 1) q (halves up), and ``above_p99``, the rows beyond it.

    Both come from the counts of values, of which there are few however many rows; an all-null column gives 0 and 0.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return upto_counts(counts).agg(*nearest_of_counts(q))


def upto_counts(counts: DataFrame) -> DataFrame:
    """``counts`` (v, n) with ``upto``, the rows up to each value, and ``all``. Null values are left out of both; a value may have several counts, which have the same ``upto``."""
    n = F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)
    upto = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"upto": F.sum(n).over(upto), "all": F.sum(n).over(Window.partitionBy())})


def nearest_of_counts(q: float = QUANTILE) -> list[Column]:
    """The aggregates ``p99_tokens`` and ``above_p99`` over what ``upto_counts`` gives."""
    index = F.floor((F.col("all") - 1) * F.lit(q) + F.lit(0.5))
    least = lambda c: F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > index), F.col(c)))
    return [
        F.coalesce(least("v"), F.lit(0)).cast("long").alias("p99_tokens"),
        F.coalesce(F.max("all") - least("upto"), F.lit(0)).cast("long").alias("above_p99"),
    ]


def outliers(df: DataFrame, column: str = "token_count") -> DataFrame:
    """One row: min, max, p99, rows above it, too short and too long ones; 0 where there is nothing."""
    return df.agg(*ends(column)).crossJoin(F.broadcast(nearest_quantile(df, column)))  # one row each


def outlier_rows(df: DataFrame, column: str = "token_count") -> DataFrame:
    """The rows above the p99 themselves."""
    edge = F.broadcast(nearest_quantile(df, column).select("p99_tokens"))  # one row
    return df.join(edge, F.col(column) > F.col("p99_tokens")).drop("p99_tokens")
