"""Streams: watching a dataset folder, and running or windowed aggregates over what arrives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions import aggregates as A
from tablewright.operators.profile import checked
from tablewright.plans.errors import BadRequest


def arrivals(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they appear under ``folder`` (or below it), with the file they came in."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.parquet(folder).select("*", F.col("_metadata.file_path").alias("source_file"))


def on_arrival(stream: DataFrame, act: Callable[[list[str]], None], checkpoint: str) -> StreamingQuery:
    """Call ``act`` with the new files of each batch, for instance to refresh a catalogue."""

    def batch(rows: DataFrame, _: int) -> None:
        files = [r["source_file"] for r in rows.select("source_file").distinct().collect()]
        if files:
            act(files)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, operations: Sequence[dict]) -> DataFrame:
    """Aggregates over all that has arrived; write it in complete mode. Exact distinct counts need all rows and are refused."""
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    pairs = checked(stream, operations)
    if any(op == "distinct_count" for op, _ in pairs):
        raise BadRequest("a stream has no exact distinct count")
    return stream.groupBy().agg(*[A.row_count().alias("row_count") if c is None else A.BY_OPERATION[op](c, kinds[c]).alias(f"{op}_{c}") for op, c in pairs])


def trend(events: DataFrame, time: str = "ts", value: str = "value", every: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, rows, total) by time window; ``late`` is how long a stream waits for stragglers.

    A stream's watermark needs an instant, so there a time without zone is read in the session's zone.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late and events.isStreaming else events
    grouped = timed.groupBy(F.window(time, every).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "rows", "total")
