"""Column profiles: declarative aggregates in one job, null and distinct counts, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions import aggregates as A
from tablewright.plans.errors import BadRequest

#: Where the row count of a request goes.
ROW_COUNT = "_row_count"


def checked(df: DataFrame, operations: Sequence[dict]) -> list[tuple[str, str | None]]:
    """The (op, column) pairs of a request, if they fit the table."""
    kinds, out = {f.name: f.dataType for f in df.schema.fields}, []
    for operation in operations:
        op, column = operation.get("op"), operation.get("column")
        if op not in A.OPERATIONS:
            raise BadRequest(f"unknown operation {op!r}")
        if op == "row_count":
            out.append((op, None))
            continue
        if column not in kinds:
            raise BadRequest(f"operation {op} needs a column of the table, not {column!r}")
        if op in A.NEEDS_NUMBER and not isinstance(kinds[column], (T.NumericType, T.BooleanType)):
            raise BadRequest(f"{op} needs a number, {column} is {kinds[column].simpleString()}")
        if isinstance(kinds[column], (T.MapType, T.VariantType)) or (op in ("min", "max") and isinstance(kinds[column], (T.StructType, T.ArrayType))):
            raise BadRequest(f"{op} is not defined for {kinds[column].simpleString()}")
        out.append((op, column))
    return list(dict.fromkeys(out))


def aggregate(df: DataFrame, operations: Sequence[dict]) -> DataFrame:
    """One row with a column ``<op>_<column>`` (or ``row_count``) for each operation; one job whatever their number."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = checked(df, operations)
    if not pairs:
        raise BadRequest("a request needs at least one operation")
    return df.agg(
        *[
            A.row_count().alias("row_count") if column is None else A.BY_OPERATION[op](column, kinds[column]).alias(f"{op}_{column}")
            for op, column in pairs
        ]
    )


def run_operations(df: DataFrame, operations: Sequence[dict]) -> dict[str, dict]:
    """Results by column; the row count under ``_row_count`` as ``sum``."""
    pairs = checked(df, operations)
    row, out = aggregate(df, operations).first(), {}
    for op, column in pairs:
        if column is None:
            out.setdefault(ROW_COUNT, {})["sum"] = row["row_count"]
        else:
            out.setdefault(column, {})[op] = row[f"{op}_{column}"]
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column."""
    wide = df.agg(*[A.null_count(c).alias(c) for c in df.columns])
    return _long(wide, df.columns, "nulls")


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_count, rows, share) of the given columns, or all; null counts as one value."""
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(A.row_count().alias("__rows"), *[A.distinct_count(c, kinds[c]).alias(c) for c in columns])
    long = _long(wide, columns, "distinct_count", "__rows").withColumnRenamed("__rows", "rows")
    return long.withColumn("share", F.coalesce(F.try_divide("distinct_count", "rows"), F.lit(0.0)))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """One row: rows beyond the distinct values of ``column`` (null is one); 0 where the table has no such column."""
    if column not in df.columns:
        return df.agg(F.lit(0).cast("long").alias("duplicates"))
    return df.agg((A.row_count() - A.distinct_count(column, df.schema[column].dataType)).alias("duplicates"))


def _long(wide: DataFrame, columns: Sequence[str], value: str, *kept: str) -> DataFrame:
    """One line for each of ``columns`` of a one-row frame."""
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias(value)) for c in columns])
    return wide.select(*kept, F.explode(lines).alias("x")).select("x.*", *kept)
