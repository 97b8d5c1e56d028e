"""Aggregate columns with the engine's null and NaN rules.

Nulls are skipped, the sum of nothing is 0, a float maximum ignores NaN, and null counts as one distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

OPERATIONS = ("row_count", "sum", "mean", "min", "max", "distinct_count")


def row_count() -> Column:
    return F.count(F.lit(1))


def null_count(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def _number(name: str, kind: T.DataType) -> Column:
    return F.col(name).cast("int") if isinstance(kind, T.BooleanType) else F.col(name)


def total(name: str, kind: T.DataType) -> Column:
    return F.coalesce(F.sum(_number(name, kind)), F.lit(0))


def mean(name: str, kind: T.DataType) -> Column:
    return F.avg(_number(name, kind))


_FLOATS = (T.FloatType, T.DoubleType)


def least(name: str, kind: T.DataType) -> Column:
    # Adding 0 makes -0.0 plain 0, whichever of the two comes first.
    return F.min(F.col(name) + F.lit(0.0).cast(kind)) if isinstance(kind, _FLOATS) else F.min(name)


def greatest(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, _FLOATS):
        value = F.col(name) + F.lit(0.0).cast(kind)
        return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))
    return F.max(name)


def distinct_key(name: str, kind: T.DataType) -> Column:
    """What to count in place of a column's value: long texts are counted by 128 hash bits and their length, which keeps
    them out of the shuffle."""
    value = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.when(value.isNotNull(), F.struct(F.xxhash64(value), F.xxhash64(F.lit("second"), value), F.length(value)))
    return value


def distinct_count(name: str, kind: T.DataType) -> Column:
    has_null = F.coalesce(F.max(F.col(name).isNull().cast("int")), F.lit(0))
    return F.count_distinct(distinct_key(name, kind)) + has_null


BY_OPERATION = {"sum": total, "mean": mean, "min": least, "max": greatest, "distinct_count": distinct_count}
NEEDS_NUMBER = ("sum", "mean")
