"""Where results go: files by Spark's writers, JSON texts, and job messages for a queue."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from tablewright.plans.errors import BadRequest

#: Formats that keep nested values, and the one that doesn't.
NESTED, FLAT = ("parquet", "json", "orc"), ("csv",)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write ``df`` under ``path``; for csv, nested columns become JSON texts."""
    if kind not in NESTED + FLAT:
        raise BadRequest(f"unknown format {kind!r}")
    if kind in FLAT:
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
        df.write.mode(mode).option("header", "true").csv(path)
    else:
        df.write.mode(mode).format(kind).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


@dataclass(frozen=True)
class JobRequest:
    """A cleaning job over one file, as a message for another program."""

    input_file: str
    output_file: str
    excluded_file: str
    text_column: str
    id_column: str

    def message(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def submit(request: JobRequest, send: Callable[[str], None]) -> None:
    """Hand the request's message to ``send``, whatever queue that speaks to."""
    send(request.message())
