"""Views of tables as the canonical text corpus: id, source, added, created, text, token_count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.text import token_count


#: Input below so many bytes for each core is dealt out anew before costly work on texts.
SMALL_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is so small that its files may keep only a few of them busy.

    A file of one row group is one task, however long its texts; the shuffle that mends this is cheap for little data, and larger inputs,
    which have row groups enough, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_PER_CORE else df


def corpus(df: DataFrame, id_: str, text: str, source: str | None = None) -> DataFrame:
    """``df`` with the canonical columns; tokens are runs of non-space characters."""
    null = F.lit(None).cast("string")
    return df.select(
        F.col(id_).cast("string").alias("id"),
        (F.col(source).cast("string") if source else null).alias("source"),
        null.alias("added"),
        null.alias("created"),
        F.col(text).cast("string").alias("text"),
        token_count(F.col(text)).alias("token_count"),
    )
