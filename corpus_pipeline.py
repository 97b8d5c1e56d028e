"""A corpus from raw documents: quality, language, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and hands
on what it reads back. All but the last return the columns of the documents they got.

A stage's result is deleted once the next one's is written whole; what stays is the last one's. A run that has a name goes on, when it is called again,
after the last stage that was written whole, provided its input and stages are still the same: names, sizes and times of the tables' files and the stages' names are written in a folder beside its own. Where they
differ, the run starts anew. A run without a name has a folder of its own, which goes with the program (the rows that it returns are read from there until then).

Every stage takes null and empty texts, texts of any length, ties, repeated rows, empty tables and extra columns as its operator does; the modules in ``tablewright.llm`` say how.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bestfit, decontaminate, langid, quality, simhash
from tablewright.llm.common import Folder, private, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = private("quality")
    return quality.scored(docs, model, into).filter(F.col(into)["score"] >= quality.KEEP_AT).select(*docs.columns)


#: Languages that the corpus is to hold; None stands for all that the labelled documents show.
LANGUAGES: tuple[str, ...] | None = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a wanted language by what naive Bayes finds: not ``und``, not unlike all that was learned, not surely in another language than they state."""
    model = langid.train(docs)
    into = private("language")
    found = docs.withColumn(into, langid.predicted(docs, model))
    return found.filter(langid.accepted(F.col(into), F.col("lang"), model, LANGUAGES)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return simhash.one_of_each(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return bestfit.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("leaks", leak_stage),
    ("packing", packing_stage),
]

#: No SQL: three of the stages are trained or packed. tests/llm/test_pipeline.py holds it against plain Python.
ORACLE_SQL = None


#: Tables that the stages read.
TABLES = ("documents", "labels", "benchmark")


def _input(spark: SparkSession, sf_dir: str) -> list[str]:
    """What tells an input and these stages from others: name, bytes and time of every file of the tables, and the stages' names."""
    jvm, found = spark.sparkContext._jvm, [f"stage {k} {stage}" for k, (stage, _) in enumerate(STAGES)]
    for table in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(found)


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``. ``name`` tells runs apart, and lets one that broke off go on; without it each call is a run of its own."""
    name, own = name or uuid.uuid4().hex, name is None
    folder, of = Folder(spark, f"{shared_folder(spark)}/pipeline-{name}"), Folder(spark, f"{shared_folder(spark)}/pipeline-{name}-input")
    at = [f"{k}-{stage}" for k, (stage, _) in enumerate(STAGES)]
    if own:
        atexit.register(_forget, folder, of)
    now, done = _input(spark, sf_dir), -1
    if of.whole("files") and sorted(r[0] for r in spark.read.parquet(of.path("files")).collect()) == now:
        done = max((k for k, part in enumerate(at) if folder.whole(part)), default=-1)
    else:
        folder.delete("")
        spark.createDataFrame([(x,) for x in now], "file string").coalesce(1).write.mode("overwrite").parquet(of.path("files"))
    for k, (_, stage) in enumerate(STAGES):
        if k <= done:
            continue
        docs = spark.read.parquet(folder.path(at[k - 1]) if k else f"{sf_dir}/documents.parquet")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(folder.path(at[k]))
        if k:
            folder.delete(at[k - 1])
    return spark.read.parquet(folder.path(at[-1]))


def _forget(*folders: Folder) -> None:
    """Delete a run's folders, unless the session has ended, and with it the way to them."""
    for folder in folders:
        with contextlib.suppress(Py4JError, OSError):
            folder.delete("")
