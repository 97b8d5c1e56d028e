"""Keyed upsert into a sorted table of files by copy on write: files without a changed row stay as they are.

The table is a folder of Parquet files, each sorted by the key, all key ranges one after the other. To write it, rows are range-sorted over all tasks; the counts of the
partitions, added up, tell each row its rank in the table, and the rank its file. A change's home is the file in whose range its key falls, found by a binary search in the
broadcast first keys of the files. The last change of a key wins (``row_number``, of which Spark keeps one row a task and key before it shuffles), winners and the
rows of their homes meet in a full outer join, and only homes in which a row then differs, nulls being equal, are written anew; the ranks of their rows, again from partition counts,
say by arithmetic into which file each goes. What tasks, driver and broadcasts hold beyond rows in passing is a row a file or partition; a table has at most
``MOST_FILES`` files. One task writes one file, streaming.

Rows and changes without a key are left out. Changes that tie in all that orders them are told apart by their other columns. Rows that share a key are all updated or deleted;
a table without files takes no changes. A home whose rows all go leaves no file. Extra columns of changes have no effect; columns that a change doesn't set are null in
inserted rows. Texts of any length are only carried along.

A folder belongs to one call of ``write_table`` and the upserts on it. New files are complete before old ones go; a call that breaks off between leaves both, so start anew then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablewright.llm.common import Folder, cut, private, shipped

#: Files of a table at most; first keys and sizes of so many are broadcast or brought to the driver.
MOST_FILES = 1001

Decide = Callable[[Column], tuple[Column, Column]]


def file_rows(rows: int) -> int:
    """Rows a file has at most, so that ``rows`` make up no more than a thousand files."""
    return 1 + rows // 1000


def _ranked(ordered: DataFrame, rank: str) -> DataFrame:
    """``ordered``, a checkpointed frame sorted over its partitions, with each row's place from 0: the rows of the partitions before, and its place in its own."""
    at, nth, before = private("at"), private("nth"), private("before")
    sizes = sorted(ordered.groupBy(F.spark_partition_id().alias(at)).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for partition, n in sizes:
        offsets.append((partition, total))
        total += n
    offset = ordered.sparkSession.createDataFrame(offsets, f"`{at}` int, `{before}` long")
    placed = ordered.withColumns({at: F.spark_partition_id(), nth: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return placed.join(F.broadcast(offset), at).withColumn(rank, F.col(before) + F.col(nth)).drop(at, nth, before)


def _write_files(rows: DataFrame, file: str, n: int, key: str, folder: str) -> None:
    """Add ``n`` files to ``folder``; column ``file`` says which one a row is in."""
    dealt = rows.repartitionById(n, F.col(file).cast("int")).drop(file)
    dealt.sortWithinPartitions(key).write.mode("append").option("maxRecordsPerFile", 0).parquet(folder)


def write_table(rows: DataFrame, key: str, folder: str, most: int) -> None:
    """Write ``rows``, sorted by ``key``, as files of ``most`` rows, the last of the rest."""
    rank = private("rank")
    ordered = cut(rows.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key))
    n = -(-ordered.count() // most)
    if n > MOST_FILES:
        raise ValueError(f"{n} files of {most} rows; a table has {MOST_FILES} at most, so its files must be larger")
    if n == 0:
        ordered.write.mode("append").parquet(folder)
        for name in Folder(rows.sparkSession, folder).files():
            Folder(rows.sparkSession, folder).delete(name)
        return
    _write_files(_ranked(ordered, rank).withColumn(rank, F.floor(F.col(rank) / F.lit(most))), rank, n, key, folder)


def table_rows(spark: SparkSession, folder: str, schema: T.StructType, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of all files, or of those named, with the name of their file as ``file_name``."""
    paths = [folder] if names is None else [f"{folder}/{n}" for n in names]
    if not Folder(spark, folder).files():
        return spark.createDataFrame([], schema).withColumn("file_name", F.lit(None).cast("string"))
    return spark.read.schema(schema).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names], F.col("_metadata.file_name").alias("file_name"))


def files_of(spark: SparkSession, folder: str, schema: T.StructType, key: str) -> list[tuple]:
    """(first key, name) of each file, in order."""
    rows = table_rows(spark, folder, schema).groupBy("file_name").agg(F.min(key).alias("first"))
    return sorted((r["first"], r["file_name"]) for r in rows.collect())


def home(key: Column, firsts: Column, n: int) -> Column:
    """Place of the last of ``n`` ascending ``firsts`` at or below ``key``, by binary search; 0 if there is none."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(firsts, at + step) <= key), at + step).otherwise(at))


def winners(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last change of each key by ``order``; ties by the other columns, nulls lowest."""
    nth = private("nth")
    rest = [c for c in changes.columns if c != key and c not in order]
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(F.col(f"`{c}`")) for c in (*order, *rest)])
    return changes.filter(F.col(key).isNotNull()).withColumn(nth, F.row_number().over(last)).filter(F.col(nth) == 1).drop(nth)


def layout(sizes: Sequence[int | None], most: int) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of rewritten homes go: for each (home, first file, rows, small size, number of files one larger), files counted from 0.

    ``sizes`` has each home's rows, None where the home stays. A home fills the fewest files, sizes one apart at most, the larger first. Then each file in turn joins the one left of
    it, if that was rewritten too and both have ``most`` rows at most together. Two files of one home never join, as fewer would have done for it.
    """
    out, left, nth = [], None, 0
    for at, n in enumerate(sizes):
        if n is None:
            left = None
        elif n:
            files = -(-n // most)
            small, larger = divmod(n, files)
            first = small + (larger > 0)
            joins = left is not None and left + first <= most
            start = nth - 1 if joins else nth
            out.append((at, start, n, small, larger))
            nth = start + files
            left = small if files > 1 else first + (left if joins else 0)
    return out


def upsert(spark: SparkSession, folder: str, schema: T.StructType, key: str, changes: DataFrame, order: Sequence[str], sets: Sequence[str], decide: Decide, most: int) -> set[str]:
    """Apply the last change of each key to the table in ``folder``; returns the names of files that stayed.

    ``decide`` takes the first key of a change's home and gives two conditions over the columns of ``changes``: whether the change counts, and whether it deletes; other changes set
    the columns ``sets``, inserting keys that the table lacks.
    """
    files = files_of(spark, folder, schema, key)
    if not files:
        return set()
    kind = schema[key].dataType.simpleString()
    at, first, firsts, deletes, changed, alive, rank, old = (private(x) for x in ("home", "first", "firsts", "deletes", "changed", "alive", "rank", "old"))
    fences = spark.createDataFrame([([f for f, _ in files],)], T.StructType([T.StructField(firsts, T.ArrayType(schema[key].dataType))]))
    last = winners(changes, key, order).crossJoin(F.broadcast(fences))  # one row
    last = last.withColumn(at, home(F.col(key).cast(kind), F.col(firsts), len(files))).withColumn(first, F.get(firsts, F.col(at)))
    counts, deleting = decide(F.col(first))
    last = last.filter(F.coalesce(counts, F.lit(False))).withColumn(deletes, F.coalesce(deleting, F.lit(False)))
    last = cut(last.select(F.col(key).cast(kind).alias(key), at, deletes, *[F.col(f"`{c}`").cast(schema[c].dataType) for c in sets]))
    touched = sorted(r[0] for r in last.select(at).distinct().collect())
    if not touched:
        return {name for _, name in files}

    homes = spark.createDataFrame([(files[k][1], k) for k in touched], f"file_name string, `{at}` int")
    rows = table_rows(spark, folder, schema, [files[k][1] for k in touched]).join(F.broadcast(homes), "file_name")
    rows = rows.select(F.col(key), F.col(at).alias(f"{old}_home"), F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias(old))
    met = rows.join(last, key, "full_outer")
    stood, comes = F.col(old).isNotNull(), F.col(deletes).isNotNull() & ~F.col(deletes)
    same = F.lit(True)
    for c in sets:
        same = same & F.col(old)[c].eqNullSafe(F.col(f"`{c}`"))
    fields = [F.when(comes, F.col(f"`{c}`")).otherwise(F.col(old)[c]).alias(c) if c in sets else (F.col(key) if c == key else F.col(old)[c].alias(c)) for c in schema.names]
    met = met.select(
        *fields,
        F.coalesce(f"{old}_home", at).alias(at),
        F.when(comes, ~stood | ~same).otherwise(F.coalesce(F.col(deletes), F.lit(False)) & stood).alias(changed),
        (comes | (stood & F.col(deletes).isNull())).alias(alive),
    )
    ordered = cut(met.repartitionByRange(at, key).sortWithinPartitions(at, key))
    sizes: list[int | None] = [None] * len(files)
    for r in ordered.groupBy(at).agg(F.bool_or(changed).alias("dirty"), F.count_if(alive).alias("n")).collect():
        if r["dirty"]:
            sizes[r[at]] = r["n"]
    plan = layout(sizes, most)
    if plan:
        places, before = [], 0
        for k, start, n, small, larger in plan:
            places.append((k, start, before, small, larger))
            before += n
        start, skip, small, larger = (private(x) for x in ("start", "skip", "small", "larger"))
        where = spark.createDataFrame(places, f"`{at}` int, `{start}` int, `{skip}` long, `{small}` long, `{larger}` long")
        new = ordered.join(F.broadcast(where), at).filter(alive).select(*schema.names, start, skip, small, larger)
        new = _ranked(new, rank).withColumn(rank, F.col(rank) - F.col(skip))
        wide = F.col(larger) * (F.col(small) + 1)
        nth = F.when(F.col(rank) < wide, F.expr(f"`{rank}` div (`{small}` + 1)")).otherwise(F.col(larger) + F.floor((F.col(rank) - wide) / F.col(small)))
        new = new.withColumn(rank, F.col(start) + nth).drop(start, skip, small, larger)
        _write_files(new, rank, max(p[1] - (-p[2] // most) for p in plan), key, folder)
    gone = {files[k][1] for k, n in enumerate(sizes) if n is not None}
    for name in gone:
        Folder(spark, folder).delete(name)
    return {name for _, name in files} - gone


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(file_name, keys_sha256) of ``table_rows``: SHA-256 of a file's keys, comma-joined in order; a task goes through its files as a stream."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            done = []
            for file, part in batch.groupby("file_name", sort=False):
                text = ",".join(map(str, part["k"].tolist()))
                if file == name:
                    state.update(("," + text).encode())
                else:
                    if name is not None:
                        done.append((name, state.hexdigest()))
                    name, state = file, hashlib.sha256(text.encode())
            yield pd.DataFrame(done, columns=["file_name", "keys_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["file_name", "keys_sha256"])

    keys = shipped(rows).select("file_name", F.col(key).alias("order"), F.col(key).cast("string").alias("k"))
    return keys.repartition("file_name").sortWithinPartitions("file_name", "order").drop("order").mapInPandas(hashed, "file_name string, keys_sha256 string")


def columns_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the columns as the first file by name holds them."""
    names = Folder(spark, folder).files()
    return spark.read.parquet(f"{folder}/{names[0]}").columns if names else []


def report(spark: SparkSession, folder: str, schema: T.StructType, stayed: set[str]) -> DataFrame:
    """A row for each file of a table of clients: its first id, rows, sum of balances in cents, checksums, columns, path, and whether it was rewritten."""
    rows = table_rows(spark, folder, schema)
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    finite = F.col("balance").isNotNull() & ~F.isnan("balance") & (F.abs("balance") < float("inf"))
    line = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    sums = rows.groupBy("file_name").agg(
        F.min("client_id").alias("first_id"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(finite, cents).otherwise(0)).alias("cents"),
        F.sum(F.crc32(line.cast("binary"))).alias("rows_crc"),
    )
    names = spark.createDataFrame([(n,) for n in sorted(stayed)], "file_name string").withColumn("stayed", F.lit(True))  # a row a file
    found = sums.join(digests(rows, "client_id"), "file_name").join(F.broadcast(names), "file_name", "left")
    return found.select(
        "first_id",
        "n_rows",
        "cents",
        "rows_crc",
        F.col("keys_sha256").alias("ids_sha256"),
        F.lit(",".join(columns_of(spark, folder))).alias("columns"),
        F.concat(F.lit(f"{folder}/"), "file_name").alias("path"),
        F.col("stayed").isNull().alias("rewritten"),
    )
