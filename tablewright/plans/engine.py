"""The engine: catalogue, aggregate requests, previews, plots and quality reports over datasets, by name."""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tablewright.operators import expressions, histogram, profile, quality, sampling
from tablewright.plans import plotspec
from tablewright.plans.cache import Cache, TTL_SECONDS, request_key
from tablewright.plans.errors import BadRequest
from tablewright.sources.catalog import Catalog
from tablewright.streaming.watch import trend


class Engine:
    """Requests name a dataset, variant and version; results are plain dictionaries and are kept for ``ttl_seconds``.

    A result is kept under its request and the file's size and time, so a changed file is read anew. With ``same_schema`` requests on a version whose columns
    differ from those of the version before are refused; ``strict`` refuses version folders with more than one file.
    """

    def __init__(self, spark: SparkSession, root: str, ttl_seconds: float | None = TTL_SECONDS, sample_rows: int = sampling.SAMPLE_ROWS, same_schema: bool = False, strict: bool = False):
        self.spark, self.catalog, self.sample_rows, self.same_schema = spark, Catalog(spark, root, strict), sample_rows, same_schema
        self.analyses, self.reports = Cache(ttl_seconds), Cache(ttl_seconds)

    # Catalogue

    def health(self) -> dict:
        return {"status": "ok"}

    def readiness(self) -> dict:
        ready = self.catalog.ready()
        return {"status": "ok" if ready else "not_ok", "root": self.catalog.root}

    def datasets(self) -> list[dict]:
        return [dataclasses.asdict(d) for d in self.catalog.datasets()]

    def dataset(self, slug: str) -> dict:
        return dataclasses.asdict(self.catalog.dataset(slug))

    def versions(self, slug: str, variant: str) -> list[dict]:
        return [dataclasses.asdict(v) for v in self.catalog.versions(slug, variant)]

    def version(self, slug: str, variant: str, version: str) -> dict:
        return dataclasses.asdict(self.catalog.version(slug, variant, version))

    def read(self, dataset: str, version: str, variant: str = "original") -> DataFrame:
        return self.spark.read.parquet(self._file(dataset, variant, version))

    def _file(self, dataset: str, variant: str, version: str) -> str:
        path = self.catalog.file_path(dataset, variant, version)
        if self.same_schema:
            self.catalog.demand_schema(dataset, variant, version)
        return path

    def sweep(self) -> int:
        """Drop results whose time is over; returns how many."""
        return self.analyses.sweep() + self.reports.sweep()

    # Requests

    def analyse(self, dataset: str, version: str, operations: list[dict], variant: str = "original", filters: list | None = None, where: dict | None = None, derived: list[dict] | None = None) -> dict:
        """{"key", "columns": {column: {operation: value}}, "metrics": rows and nulls seen, the file's bytes, seconds}, over the rows that meet ``where`` and with the columns ``derived`` (``operators.expressions``). ``filters`` is accepted and has no effect."""
        path = self._file(dataset, variant, version)
        request = {"dataset": dataset, "variant": variant, "version": version, "operations": operations, "filters": filters} | ({"where": where} if where else {}) | ({"derived": derived} if derived else {})
        key = request_key(request, self.catalog.stamp(path))
        if not self.analyses.has(key):
            df = expressions.derived(self.spark.read.parquet(path), derived or [])
            df = expressions.where(df, where) if where else df
            # The metrics come with the request's own job.
            seen, began = Observation(), time.perf_counter()
            named = [c for c in dict.fromkeys(o.get("column") for o in operations) if c in df.columns]
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()).alias(f"null {c}") for c in named])
            columns, counts = profile.run_operations(df, operations), seen.get
            metrics = {"rows": counts["rows"], "nulls": {c: counts[f"null {c}"] for c in named}, "file_bytes": self.catalog.stamp(path)[0], "seconds": time.perf_counter() - began}
            self.analyses.set(key, {"key": key, "columns": columns, "metrics": metrics})
        return self.analyses.get(key)

    def cached(self, key: str) -> dict | None:
        """The result kept under a key, of either kind."""
        return self.analyses.get(key) or self.reports.get(key)

    def preview(self, dataset: str, version: str, variant: str = "original", rows: int = sampling.PREVIEW_ROWS, seed: int = 0) -> list[dict]:
        return [r.asDict() for r in sampling.preview(self.read(dataset, version, variant), rows, seed).collect()]

    def plot(self, dataset: str, version: str, operations: list[dict], variant: str = "original") -> dict:
        """The Vega-Lite specification of one plot: log_histogram (also: histogram), linear_histogram, boxplot, or line (with ``time`` and ``every``)."""
        if len(operations) != 1:
            raise BadRequest("a plot takes exactly one operation")
        operation, df = operations[0], self.read(dataset, version, variant)
        op, column = operation.get("op"), operation.get("column")
        if not column:
            raise BadRequest("a plot needs a column")
        if op in ("histogram", "log_histogram"):
            low, high = histogram.extent(df, column)
            edges = histogram.log_edges(low, high, operation.get("bins", histogram.LOG_EDGES))
            return plotspec.log_histogram(histogram.log2_histogram(df, column, bounds=edges).collect(), column, dataset, low, high)
        if op == "linear_histogram":
            return plotspec.linear_histogram(histogram.linear_histogram(df, column, operation.get("bins", histogram.LINEAR_BINS)).collect(), column, dataset)
        if op == "boxplot":
            return plotspec.boxplot(histogram.box_stats(df, column).first(), column, dataset)
        if op == "line":
            if operation.get("time") not in df.columns or column not in df.columns:
                raise BadRequest("a line needs a column and a column of times")
            rows = trend(df, operation["time"], column, operation.get("every", "1 day")).orderBy("start")
            return plotspec.line(rows.collect(), column, dataset)  # one row for each window of time
        raise BadRequest(f"unknown plot {op!r}")

    def quality(self, dataset: str, version: str, variant: str = "original") -> dict:
        """The quality report, with score and grade, insights, and the key under which it is kept."""
        path = self._file(dataset, variant, version)
        key = request_key({"dataset": dataset, "variant": variant, "version": version}, "quality", self.catalog.stamp(path))
        if not self.reports.has(key):
            row = quality.report(self.spark.read.parquet(path), sample_rows=self.sample_rows).first().asDict(recursive=True)
            self.reports.set(key, shaped(row) | {"key": key})
        return self.reports.get(key)


def shaped(row: dict) -> dict:
    """A report's row in nested form."""

    def part(*names: str) -> dict:
        return {n: row[n] for n in names}

    estimate = dict(row["repetition_estimate"])
    estimate["ci_total"] = (estimate.pop("ci_low"), estimate.pop("ci_high"))
    return {
        "row_count": row["total_rows"],
        "missing_value_count": row["missing"],
        "duplicate_ids": row["duplicate_ids"],
        "duplicate_texts": row["duplicate_texts"],
        "encoding_issues": part("replacement_char", "mojibake", "control_chars"),
        "token_outliers": part("min_tokens", "max_tokens", "p99_tokens", "too_short", "too_long", "above_p99"),
        "non_alpha_ratio": row["non_alpha_ratio"],
        "repetition": estimate | {"total_rows": row["total_rows"]},
        "html_code_log": part("html_like", "code_like", "log_like"),
        "lang_dist": dict(sorted((row["lang_dist"] or {}).items(), key=lambda kv: (-kv[1], kv[0]))),
        "quality_score": row["score"],
        "quality_grade": row["grade"],
        "insights": part("issues", "strengths", "recommendations"),
    }
