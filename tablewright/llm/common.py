"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.sources.shipping import shipped  # noqa: F401  operators of this package take it from here

#: Characters of text that numpy code turns into code points at once; bounds a Python worker's memory.
BLOCK_CHARS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a single-machine session (as in tests) gets a folder of its own in its warehouse, which goes when the program ends; a cluster
    without the setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            warehouse = re.sub(r"^file:/*", "/", spark.conf.get("spark.sql.warehouse.dir"))
            folder = f"{warehouse}/_tablewright-{context.applicationId}"
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


class Folder:
    """A folder of written tables, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._top = spark.sparkContext._jvm, path
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, part: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(part))

    def path(self, part: str) -> str:
        return f"{self._top}/{part}" if part else self._top

    def whole(self, part: str) -> bool:
        """Whether a table was written to its end."""
        return bool(self._fs.exists(self._path(f"{part}/_SUCCESS")))

    def delete(self, part: str) -> None:
        self._fs.delete(self._path(part), True)

    def files(self) -> list[str]:
        """Names of the data files directly in the folder."""
        if not self._fs.exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isFile())
        return sorted(n for n in names if not n.startswith(("_", ".")))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def private(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_blocks(texts: list[str | None], most: int = BLOCK_CHARS):
    """Yield (first, last) slices of ``texts`` holding about ``most`` characters each; a longer text stands alone."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def text_parts(text: str, most: int = BLOCK_CHARS):
    """Yield (first, last) slices that make up ``text``, each of ``most`` characters at most, cut after white space where there is any."""
    lo = 0
    while lo < len(text):
        hi = min(lo + most, len(text))
        if hi < len(text):
            hi = next((k for k in range(hi, lo, -1) if text[k - 1].isspace()), hi)
        yield lo, hi
        lo = hi


def least_ids(ids: DataFrame, n: int, column: str = "doc_id") -> DataFrame:
    """The ``n`` rows of ``ids``, in which no id repeats, whose ids' hashes are least.

    They are counted first, and only those with a hash in the share that holds ``n`` (with room for chance: ten standard deviations) go on, so few rows travel.
    """
    order = F.xxhash64(F.lit("sample"), column)
    share = (n + 10 * n**0.5 + 10) / max(1, ids.count())
    if share < 1:
        ids = ids.filter(order <= F.lit(int(share * 2**64) - 2**63))
    return ids.orderBy(order).limit(n)
