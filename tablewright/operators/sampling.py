"""Samples and previews; random, but the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.plans.errors import BadRequest

#: Rows of a preview.
PREVIEW_ROWS = 5
#: Rows of the sample behind language and repetition measures.
SAMPLE_ROWS = 10_000

_PREVIEW = ("id", "source", "added", "created", "text", "token_count")


def exact_sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """``n`` rows (all, if fewer) without replacement, by a hash of the whole row, so the same however the rows are dealt out.

    Rows are counted below some hashes first, and only those below the least that leaves ``n`` go on: little more than ``n`` rows travel, however
    many tasks there are. Where equal rows, which share a hash, make that many more, the last hash that counts is found first, and as many of its rows
    as are still due are drawn by their place in ``df``.
    """
    total = df.count()
    if total <= n:
        return df
    name = _unused(df, "hash")
    # Maps and variants can't be hashed; the rest of a row tells it apart.
    plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    marked = df.withColumn(name, F.xxhash64(F.lit(seed), *plain))
    if not (edges := _edges(n, total)):  # not many more rows than asked for
        return marked.orderBy(name).limit(n).drop(name)
    below = marked.agg(*[F.count_if(F.col(name) <= e).alias(str(e)) for e in edges]).first()
    edge = next((e for e in edges if below[str(e)] >= n), (1 << 63) - 1)
    few = marked.filter(F.col(name) <= edge)
    if edge in edges and below[str(edge)] <= 4 * n + 1000:
        return few.orderBy(name).limit(n).drop(name)
    due, last = n, None
    for r in few.groupBy(name).count().orderBy(name).limit(n).toLocalIterator():  # n hashes hold n rows at least
        last = r
        if r["count"] >= due:
            break
        due -= r["count"]
    alike = marked.filter(F.col(name) == last[name])
    return marked.filter(F.col(name) < last[name]).unionByName(_by_place(alike, due, last["count"], seed)).drop(name)


def _edges(n: int, total: int) -> list[int]:
    """Hashes below which ``n`` of ``total`` rows lie with room for chance, and twice, four times, ... as many."""
    share, out = (n + 10 * n**0.5 + 10) / total, []
    while share < 1:
        out.append(int(share * 2**64) - 2**63)
        share *= 2
    return out


def _by_place(df: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """``n`` of the ``total`` rows of ``df``, by a hash of their places."""
    name = _unused(df, "place")
    marked = df.withColumn(name, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    for edge in _edges(n, total)[:1]:
        marked = marked.filter(F.col(name) <= edge)
    return marked.orderBy(name).limit(n).drop(name)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def created_text(kind: T.DataType) -> Column:
    """``created`` as text: a plain value, or start and end of a struct with a comma between."""
    if isinstance(kind, T.StructType):
        ends = [F.coalesce(F.col(f"created.{x}").cast("string"), F.lit("None")) for x in ("start", "end")]
        return F.when(F.col("created").isNotNull(), F.concat_ws(", ", *ends))
    return F.col("created").cast("string")


def preview(df: DataFrame, n: int = PREVIEW_ROWS, seed: int = 0) -> DataFrame:
    """``n`` random rows with the fixed columns of a preview, ordered by id."""
    lacking = [c for c in _PREVIEW if c not in df.columns]
    if lacking:
        raise BadRequest(f"a preview needs the columns {', '.join(lacking)}")
    metadata = F.lit(None).cast("string")
    if "metadata" in df.columns:
        held = isinstance(df.schema["metadata"].dataType, (T.StructType, T.MapType, T.ArrayType))
        metadata = F.coalesce(F.to_json("metadata", {"ignoreNullFields": "false"}) if held else F.col("metadata").cast("string"), F.lit("null"))
    chosen = exact_sample(df, n, seed)
    return chosen.select(
        F.col("id").cast("string").alias("id"),
        F.col("source").cast("string").alias("source"),
        F.col("added").cast("string").alias("added"),
        created_text(df.schema["created"].dataType).alias("created"),
        F.col("text").cast("string").alias("text"),
        F.col("token_count").cast("long").alias("token_count"),
        metadata.alias("metadata"),
    ).orderBy("id")


def extremes(df: DataFrame, n: int = PREVIEW_ROWS, by: str = "token_count", longest: bool = True, tie: str = "id") -> DataFrame:
    """The ``n`` rows with the most (or fewest) ``by``, nulls last, equal ones by ``tie``; a top-n per task and one merge."""
    order = F.desc_nulls_last(by) if longest else F.asc_nulls_last(by)
    return df.orderBy(order, F.asc_nulls_last(tie)).limit(n)
