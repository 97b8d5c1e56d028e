"""The catalogue: datasets found under a root folder as <slug>/<variant>/<version>/<file>.parquet, on any file system that Spark reads."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.plans.errors import BadRequest, NotFound


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    dtype: str
    nullable: bool


@dataclass(frozen=True)
class DatasetFile:
    path: str
    size_bytes: int
    modified_at: str


@dataclass(frozen=True)
class DatasetVersion:
    version: str
    path: str
    file: DatasetFile
    file_schema: tuple[ColumnSchema, ...]
    row_count: int


@dataclass(frozen=True)
class DatasetVariant:
    variant: str
    versions: tuple[DatasetVersion, ...] = field(default=())


@dataclass(frozen=True)
class Dataset:
    slug: str
    path: str
    variants: tuple[DatasetVariant, ...] = field(default=())


@dataclass(frozen=True)
class _Found:
    slug: str
    variant: str
    version: str
    folder: str
    file: DatasetFile


#: Schema jobs that run at a time while a catalogue is read.
SCHEMA_JOBS = 16
_NAME = re.compile(r"[^/\\\x00]+")


def semantic(version: str) -> tuple:
    """Sort key that puts v1.10.0 after v1.9.0."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", version) if p)


class Catalog:
    """Datasets under ``root``; read once, and again by ``refresh``.

    ``strict`` demands that a version folder holds one Parquet file at most; else the first by name counts.
    """

    def __init__(self, spark: SparkSession, root: str, strict: bool = False):
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict
        self._datasets: dict[str, Dataset] | None = None
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(self._fs.listStatus(path), key=lambda s: s.getPath().getName())

    def _folders(self, folder: str) -> Iterator[tuple[str, str]]:
        for status in self._list(folder):
            if status.isDirectory():
                yield status.getPath().getName(), status.getPath().toString()

    def ready(self) -> bool:
        """Whether the root exists and is a folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return bool(self._fs.exists(path) and self._fs.getFileStatus(path).isDirectory())

    def _walk(self) -> Iterator[_Found]:
        for slug, slug_path in self._folders(self.root):
            for variant, variant_path in self._folders(slug_path):
                for version, folder in self._folders(variant_path):
                    files = [s for s in self._list(folder) if s.getPath().getName().endswith(".parquet")]
                    if len(files) > 1 and self.strict:
                        raise BadRequest(f"{slug}/{variant}/{version} holds {len(files)} Parquet files, not one")
                    if files:
                        time = datetime.fromtimestamp(files[0].getModificationTime() / 1000, timezone.utc).isoformat()
                        yield _Found(slug, variant, version, folder, DatasetFile(files[0].getPath().toString(), files[0].getLen(), time))

    def _counts(self, paths: list[str]) -> dict[str, int]:
        """Rows by file, in one job that reads no column; a file may also be a folder of part files."""
        if not paths:
            return {}
        rows = self.spark.read.schema("__none int").parquet(*paths)
        found = rows.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        whole, by_tail = dict.fromkeys(paths, 0), {_tail(p): p for p in paths}
        for r in found:
            tail = _tail(r["f"])
            own = by_tail.get(tail) or by_tail[tail.rpartition("/")[0]]
            whole[own] += r["n"]
        return whole

    def schema(self, path: str) -> tuple[ColumnSchema, ...]:
        return tuple(ColumnSchema(f.name, f.dataType.simpleString(), f.nullable) for f in self.spark.read.parquet(path).schema.fields)

    def refresh(self) -> None:
        """Read the tree again. Versions are sorted by name, last first; variants without a version, and versions without a file, are left out."""
        found = list(self._walk())
        paths = [f.file.path for f in found]
        counts = self._counts(paths)
        # Each file's footer is read by a job of its own; many jobs at a time, as one leaves the cluster idle.
        with ThreadPoolExecutor(max_workers=SCHEMA_JOBS) as pool:
            schemas = dict(zip(paths, pool.map(self.schema, paths)))
        tree: dict[str, dict[str, list[DatasetVersion]]] = {slug: {} for slug, _ in self._folders(self.root)}
        for f in found:
            version = DatasetVersion(f.version, f.folder, f.file, schemas[f.file.path], counts.get(f.file.path, 0))
            tree[f.slug].setdefault(f.variant, []).append(version)
        self._datasets = {
            slug: Dataset(slug, f"{self.root}/{slug}", tuple(DatasetVariant(v, tuple(sorted(vs, key=lambda x: x.version, reverse=True))) for v, vs in variants.items()))
            for slug, variants in tree.items()
        }

    def datasets(self) -> list[Dataset]:
        if self._datasets is None:
            self.refresh()
        return list(self._datasets.values())

    def dataset(self, slug: str) -> Dataset:
        for found in self.datasets():
            if found.slug == slug:
                return found
        raise NotFound(f"dataset {slug} not found")

    def versions(self, slug: str, variant: str) -> tuple[DatasetVersion, ...]:
        for found in self.dataset(slug).variants:
            if found.variant == variant:
                return found.versions
        raise NotFound(f"variant {variant} of {slug} not found")

    def version(self, slug: str, variant: str, version: str) -> DatasetVersion:
        for found in self.versions(slug, variant):
            if found.version == version:
                return found
        raise NotFound(f"version {version} of {slug}/{variant} not found")

    def latest(self, slug: str, variant: str = "original") -> DatasetVersion:
        """The version that is last by meaning, not by letters."""
        return max(self.versions(slug, variant), key=lambda v: semantic(v.version))

    def file_path(self, slug: str, variant: str, version: str) -> str:
        """Where <slug>.parquet of a version lies; names that would leave the root are refused."""
        for name in (slug, variant, version):
            if not _NAME.fullmatch(name) or name in (".", ".."):
                raise BadRequest(f"{name!r} is no name of a dataset, variant or version")
        self.dataset(slug)
        path = f"{self.root}/{slug}/{variant}/{version}/{slug}.parquet"
        if not self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
            raise NotFound(f"{slug}/{variant}/{version} has no file {slug}.parquet")
        return path

    def stamp(self, path: str) -> tuple[int, int]:
        """(bytes, modification time) of a file; changes when the file does."""
        status = self._fs.getFileStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        return status.getLen(), status.getModificationTime()

    def demand_schema(self, slug: str, variant: str, version: str) -> None:
        """Refuse a version whose columns, by name and type, are not those of the version before it, by meaning; the oldest is taken as it is."""
        older = [v for v in self.versions(slug, variant) if semantic(v.version) < semantic(version)]
        if not older:
            return
        before = max(older, key=lambda v: semantic(v.version))
        a, b = ({c.name: c.dtype for c in v.file_schema} for v in (before, self.version(slug, variant, version)))
        if changed := sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n)):
            what = ", ".join(f"{n} ({a.get(n, 'missing')} before, {b.get(n, 'missing')} now)" for n in changed)
            raise BadRequest(f"{slug}/{variant}/{version} departs from {before.version}: {what}")

    def frame(self) -> DataFrame:
        """The catalogue as a flat table, a row for each version."""
        rows = [
            (d.slug, v.variant, x.version, x.file.path, x.file.size_bytes, x.file.modified_at, x.row_count, [asdict(c) for c in x.file_schema])
            for d in self.datasets()
            for v in d.variants
            for x in v.versions
        ]
        kind = "slug string, variant string, version string, path string, size_bytes long, modified_at string, row_count long, file_schema array<struct<name:string,dtype:string,nullable:boolean>>"
        return self.spark.createDataFrame(rows, kind)

    def drift(self, slug: str, variant: str = "original") -> list[tuple[str, str, list[str]]]:
        """(older version, newer version, columns that were added, dropped or changed) for neighbours that differ."""
        ordered, out = sorted(self.versions(slug, variant), key=lambda v: semantic(v.version)), []
        for old, new in zip(ordered, ordered[1:]):
            a, b = ({c.name: c.dtype for c in v.file_schema} for v in (old, new))
            if changed := sorted(n for n in a.keys() | b.keys() if a.get(n) != b.get(n)):
                out.append((old.version, new.version, changed))
        return out


def _tail(path: str) -> str:
    """A path without scheme, for comparing differently written ones."""
    return re.sub(r"^[a-z0-9]+:/*", "/", path)
