"""Repeated words and what a sample says of them: flag, proportion, Wilson interval."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a word five times or more in a row, nothing but white space between. Four repeats are enough to tell: what follows them is the
# end of the match or white space, a word's border either way. More would cost a stack frame each, and nothing is gained by giving characters back.
REPEATED = r"(?iuU)\b(\w++)(?:\s++\1){4}\b"
# Fixed value: the 95 % quantile of the interval.
Z = 1.96


def repeats(text: Column) -> Column:
    return F.coalesce(text.rlike(REPEATED), F.lit(False))


def wilson(count: Column, n: Column, total: Column) -> Column:
    """Struct of sample_n, sample_count, sample_prop, lower, upper, estimate_total, ci_low, ci_high; zeros for an empty sample."""
    n_, zz = n.cast("double"), Z * Z
    p = F.coalesce(F.try_divide(count.cast("double"), n_), F.lit(0.0))
    scale = F.try_divide(F.lit(1.0), 1 + F.try_divide(F.lit(zz), n_))
    middle = (p + F.try_divide(F.lit(zz / 2), n_)) * scale
    reach = Z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(zz / 4), n_), n_)) * scale
    # greatest() and least() pass over nulls, so an empty sample is told apart by itself.
    lower = F.when(n > 0, F.greatest(F.lit(0.0), middle - reach)).otherwise(0.0)
    upper = F.when(n > 0, F.least(F.lit(1.0), middle + reach)).otherwise(0.0)

    def whole(x: Column) -> Column:
        return F.bround(x * total, 0).cast("long")

    return F.struct(
        n.cast("long").alias("sample_n"),
        count.cast("long").alias("sample_count"),
        p.alias("sample_prop"),
        lower.alias("lower"),
        upper.alias("upper"),
        whole(p).alias("estimate_total"),
        whole(lower).alias("ci_low"),
        whole(upper).alias("ci_high"),
    )
