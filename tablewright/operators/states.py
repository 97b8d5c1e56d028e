"""Quality reports from partial states that merge: each file's counts are taken once, when it arrives, and a report over any set of files adds them up.

A file's state has three parts. Counts by token length and language hold all that adds up, and with the lengths the exact quantile. Keys, 128 bits for each distinct id and each distinct
text, give exact numbers of duplicates across files; they take 16 bytes a row, and no text is read again. Sketches (HyperLogLog, 2^14 registers) estimate those numbers where keys aren't kept, with a
standard error of 0.8 % of the distinct values. States are tables, rows of all files together, so merging is a group-by of short rows.

Null ids and texts count as one value each, as in the report over whole tables. Files whose columns differ can't be merged and are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tablewright.functions import language, scoring
from tablewright.operators import quality
from tablewright.plans.errors import BadRequest

LG_REGISTERS = 14


def counts(df: DataFrame, file: Column, text: str = "text", token_count: str = "token_count", detector: language.Detector = language.detected) -> DataFrame:
    """Counts by file, token length and language."""
    return quality.counted(df, text, token_count, detector, file.alias("file"))


def _digests(df: DataFrame, file: Column, columns: Sequence[str]) -> DataFrame:
    """(file, what, h1, h2): two hashes of each value of ``columns``; those of null are 0 and null."""
    of = lambda c: F.struct(F.lit(c).alias("what"), F.xxhash64(F.lit(1), F.col(f"`{c}`")).alias("h1"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(2), F.col(f"`{c}`"))).alias("h2"))
    return df.select(file.alias("file"), F.explode(F.array(*[of(c) for c in columns])).alias("d")).select("file", "d.*")


def keys(df: DataFrame, file: Column, columns: Sequence[str]) -> DataFrame:
    """The distinct values of ``columns`` in each file, as hashes."""
    return _digests(df, file, columns).distinct()


def sketches(df: DataFrame, file: Column, columns: Sequence[str]) -> DataFrame:
    """(file, what, sketch): a sketch of the values of each column in each file; null is a value."""
    value = F.coalesce(F.xxhash64("h1", "h2"), F.lit(0))
    return _digests(df, file, columns).groupBy("file", "what").agg(F.hll_sketch_agg(value, LG_REGISTERS).alias("sketch"))


def merged(counts: DataFrame, columns: int) -> DataFrame:
    """Counts of all files together."""
    nulls = F.array(*[F.sum(F.col("nulls")[k]) for k in range(columns)]).alias("nulls")
    others = [F.sum(c).alias(c) for c in counts.columns if c not in ("file", "v", "lang", "nulls")]
    return counts.groupBy("v", "lang").agg(nulls, *others)


def report(counts: DataFrame, distinct: DataFrame, columns: list[str], id_: str = "id", text: str = "text") -> DataFrame:
    """The quality report over all files of ``counts``, whose tables have ``columns``. ``distinct`` holds the same files' keys, for exact numbers of duplicates, or their sketches."""
    whole = quality.summed(merged(counts, len(columns)), columns)
    pairs = ((id_, "duplicate_ids"), (text, "duplicate_texts"))
    if "sketch" in distinct.columns:
        found = distinct.groupBy("what").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    else:
        found = distinct.select("what", "h1", "h2").distinct().groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    numbers = found.agg(*[F.coalesce(F.max(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(f"distinct_{c}") for c, _ in pairs])
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    # An estimate may exceed the rows.
    copies = numbers.crossJoin(F.broadcast(rows)).select(*[(F.greatest(F.col("rows") - F.col(f"distinct_{c}"), F.lit(0)) if c in columns else F.lit(0)).cast("long").alias(n) for c, n in pairs])  # one row each
    return scoring.insights(scoring.scored(quality.with_copies(whole, copies)))


class Store:
    """States of Parquet files, kept in a folder. ``add`` reads only files that it doesn't know yet, or that have changed; ``report`` reads no file but the states.

    An addition is one batch: its states are written first, the list of its files last, and states of no listed batch don't count, so one that breaks off leaves nothing behind that is read. ``adapt``
    makes the canonical corpus from what a file holds.
    """

    def __init__(self, spark: SparkSession, folder: str, adapt=None, exact: bool = True, id_: str = "id", text: str = "text", token_count: str = "token_count", detector: language.Detector = language.detected):
        self.spark, self.folder, self.exact = spark, folder.rstrip("/"), exact
        self._adapt, self._id, self._text, self._tokens, self._detector = adapt or (lambda df: df), id_, text, token_count, detector
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def _stamp(self, path: str) -> str | None:
        """A file's name with its size and time, or nothing if it's gone."""
        fs = self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._path(path)):
            return None
        status = fs.getFileStatus(self._path(path))
        return json.dumps([path, status.getLen(), status.getModificationTime()])

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def files(self) -> dict[str, tuple[str, list[str]]]:
        """(batch, columns) by stamp of all files that have a state."""
        listed = self._table("files")
        return {} if listed is None else {r["stamp"]: (r["batch"], r["columns"]) for r in listed.collect()}

    def add(self, paths: Sequence[str]) -> list[str]:
        """Take the states of those of ``paths`` that are new; returns them."""
        known = self.files()
        stamps = {p: self._stamp(p) for p in dict.fromkeys(paths)}
        new = {p: s for p, s in stamps.items() if s is not None and s not in known}
        if not new:
            return []
        frames, columns = [], None
        for path, stamp in new.items():
            df = self._adapt(self.spark.read.parquet(path))
            columns = columns or next((c for _, c in known.values()), df.columns)
            if df.columns != columns:
                raise BadRequest(f"{path} has columns {df.columns}, not {columns}")
            frames.append(df.withColumn("__stamp", F.lit(stamp)))
        rows = frames[0]
        for df in frames[1:]:
            rows = rows.unionByName(df)
        file, plain = F.col("__stamp"), [c for c in (self._id, self._text) if c in columns]
        batch = f"b-{uuid.uuid4().hex}"  # a name that Spark doesn't take for a number
        quality_counts = quality.counted(rows, self._text, self._tokens, self._detector, file.alias("file"))
        quality_counts = quality_counts.withColumn("nulls", F.slice("nulls", 1, len(columns)))
        quality_counts.coalesce(1 + len(new) // 100).write.parquet(f"{self.folder}/counts/batch={batch}")
        (keys if self.exact else sketches)(rows, file, plain).write.parquet(f"{self.folder}/distinct/batch={batch}")
        listed = self.spark.createDataFrame([(s, batch, columns) for s in new.values()], "stamp string, batch string, columns array<string>")
        listed.coalesce(1).write.mode("append").parquet(f"{self.folder}/files")
        return list(new)

    def report(self, paths: Sequence[str] | None = None) -> DataFrame:
        """The report over ``paths``, or over all files that have a state and are still as they were."""
        known = self.files()
        stamps = [s for s in known if self._stamp(json.loads(s)[0]) == s] if paths is None else [self._stamp(p) for p in paths]
        if missing := [s for s in stamps if s not in known]:
            raise BadRequest(f"no state of {missing[0]}")
        if not stamps:
            raise BadRequest("no file has a state")
        live = F.broadcast(self.spark.createDataFrame([(s, known[s][0]) for s in stamps], "file string, batch string"))  # a row a file
        of = lambda name: self._table(name).join(live, ["file", "batch"]).drop("batch")
        return report(of("counts"), of("distinct"), known[stamps[0]][1], self._id, self._text)
