"""Groups of vectors that point the same way: semantic duplicates, by cosine similarity.

Equal vectors are one class first. All classes meet, so every similar pair counts: they are dealt out as a grid of cells, each of two parts of at most about ``PART`` vectors, so no task gathers them. Parts are sent
packed, once for each part, and nothing is sorted, so nothing spills; edges are between numbers of classes. A cell first
bounds its similarities from above, by products of the leading coordinates and of the lengths of what they leave out, and compares exactly, in double precision, what the bound lets pass. It gives no more than the
edges of a spanning forest of what is similar in it, so edges grow with vectors and not with pairs. Groups are the connected components.

The work so grows with the square of the classes, memory does not. Where a chance of less than one is enough (``recall``), only vectors of one bucket meet: the signs of projections on random planes make a vector's
key in each of several tables; vectors at an angle t agree in a sign with probability 1 - t / pi. Keys are as long as the number of vectors asks for, and there are as many tables as give a pair at the least
similarity the wanted chance to meet. Buckets are dealt out and compared as above.

Vectors that are null, empty or all zero, or hold null or non-finite numbers, are in no group of others: each is its own, as a row of its own. Vectors of different length are never similar. Ids may repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from tablewright.operators.components import components
from tablewright.sources.scratch import cut
from tablewright.sources.shipping import shipped

#: A recall of 1 compares all with all.
LEAST, RECALL = 0.95, 1.0
#: Vectors in one part of a grid, about, at most, or less of those longer than ``WIDE``; a task compares two parts at a time. Bytes that a task holds before it sends them.
PART, WIDE, HELD = 200_000, 64, 32 << 20
#: Fewer vectors are in ``PARTS`` parts, so that there are tasks for some dozens of cores, if a part then has ``FEWEST``.
PARTS, FEWEST = 8, 5000
#: Rows and columns of similarities that a task holds at a time.
TILE = 1024
#: Vectors that a bucket of unlike ones holds on average, about.
IN_BUCKET = 50


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def shape(n: int, least: float = LEAST, recall: float = 0.999) -> tuple[int, int]:
    """(bits of a key, tables) for ``n`` vectors: pairs of cosine ``least`` agree in some table with probability ``recall`` or more."""
    bits = min(60, max(4, math.ceil(math.log2(max(n, 1) / IN_BUCKET + 1))))
    meets = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meets))


def plane_keys(vector: Column, bits: int, tables: int, seed: int = 7) -> Column:
    """A key of ``bits`` signs for each table."""
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None]

    @F.pandas_udf("array<bigint>")
    def keys(vectors: pd.Series) -> pd.Series:
        out, lengths = [None] * len(vectors), np.array([len(v) for v in vectors])
        for n in np.unique(lengths):
            planes = np.random.default_rng([seed, int(n)]).standard_normal((int(n), tables * bits))
            at = np.flatnonzero(lengths == n)
            x = np.stack([np.asarray(vectors.iloc[k], np.float64) for k in at])
            x /= np.abs(x).max(1, keepdims=True)  # no overflow in sums
            made = ((x @ planes).reshape(len(at), tables, bits) > 0) @ weights[0, 0]
            for k, row in zip(at, made):
                out[k] = row
        return pd.Series(out, dtype=object)

    return keys(vector)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph between rows and columns that a boolean matrix gives."""
    rows, columns, edges = near.any(1), near.any(0), []
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start], reached = False, [(True, int(start))]
        while reached:
            is_row, k = reached.pop()
            found = np.flatnonzero(near[k] & columns if is_row else near[:, k] & rows)
            (columns if is_row else rows)[found] = False
            edges += [(k, int(j)) if is_row else (int(j), k) for j in found]
            reached += [(not is_row, int(j)) for j in found]
    return edges


def _leading(d: int, least: float) -> int:
    """So many of ``d`` coordinates that the bound lets pass about one in 100,000 pairs of vectors without structure."""
    z = 4.25
    return min(d, math.ceil(((z + math.sqrt(z * z + 4 * (1 - least) * d)) / 2) ** 2))


def _bounds(x: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors in single precision, turned to the axes along which they spread most: the leading coordinates and the length of the others. Products of such rows are no less than those of whole ones."""
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1] if d <= 1024 else None  # of longer ones the first coordinates lead
    m = _leading(d, least)
    made = np.empty((len(x), m + 1), np.float32)
    for at in range(0, len(x), TILE):
        turned = x[at : at + TILE] if axes is None else x[at : at + TILE] @ axes
        made[at : at + TILE, :m] = turned[:, :m]
        made[at : at + TILE, m] = np.sqrt((turned[:, m:] ** 2).sum(1))
    return made


def _roots(parent: np.ndarray, of: slice) -> np.ndarray:
    """The roots of some nodes, whose parents they become."""
    found = parent[of]
    while not np.array_equal(up := parent[found], found):
        found = up
    parent[of] = found
    return found


def forest_of_cell(x: np.ndarray, own: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similar ones among ``x``, unit vectors: of all, if ``own`` is the same for all, or else of pairs with different ``own``, of which there are two, in order."""
    cut_at = int(np.searchsorted(own, own[-1]))
    one, other = (range(0, len(x), TILE),) * 2 if cut_at == 0 else (range(0, cut_at, TILE), range(cut_at, len(x), TILE))
    ends = (len(x), len(x)) if cut_at == 0 else (cut_at, len(x))
    quick = _bounds(x, least) if len(x) > TILE else None
    lowest = np.float32(least - 1e-5 - 2e-7 * x.shape[1])  # by more than single precision can be wrong
    parent, edges = np.arange(len(x)), []
    bounds, passed = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool)  # used again for each tile

    def find(k: int) -> int:
        while (up := int(parent[k])) != k:
            parent[k] = k = int(parent[up])
        return k

    def join(i: int, j: int) -> None:
        u, v = find(i), find(j)
        if u != v:
            parent[max(u, v)] = min(u, v)
            edges.append((i, j))

    for a in one:
        for b in other:
            if cut_at == 0 and b < a:
                continue
            rows, columns = slice(a, min(a + TILE, ends[0])), slice(b, min(b + TILE, ends[1]))
            wide = columns.stop - b
            n = (rows.stop - a) * wide
            if quick is not None:
                bound = np.matmul(quick[rows], quick[columns].T, out=bounds[:n].reshape(-1, wide))
                maybe = np.flatnonzero(np.greater_equal(bound.reshape(-1), lowest, out=passed[:n]))
                if len(maybe) <= n // 64:
                    i, j = a + maybe // wide, b + maybe % wide
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[near], j[near]
                    if len(i) > TILE:
                        new = _roots(parent, rows)[i - a] != _roots(parent, columns)[j - b]
                        i, j = i[new], j[new]
                    for u, v in zip(i.tolist(), j.tolist()):
                        join(u, v)
                    continue
            near = x[rows] @ x[columns].T >= least
            if near.any():
                near &= _roots(parent, rows)[:, None] != _roots(parent, columns)[None]  # the others are joined already, or one row
                for i, j in _forest(near):
                    join(a + i, b + j)
    return edges


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in place."""
    for at in range(0, len(x), TILE):
        some = x[at : at + TILE]
        some /= np.abs(some).max(1, keepdims=True)  # no overflow in squares
        some /= np.sqrt((some * some).sum(1, keepdims=True))
    return x


def _packed(each: DataFrame, item: str) -> DataFrame:
    """(n, own, parts, first, keys, items) of rows (key, n, own, parts, first, vector): the keys and the vectors' items of one length and part, packed. A task holds ``HELD`` bytes at a time, about."""

    def pack(batches):
        held, size = {}, 0

        def sent():
            made = [(*of, *(np.concatenate(x).tobytes() for x in zip(*some))) for of, some in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k > 3 else pa.int64()) for k, x in enumerate(zip(*made))], ["n", "own", "parts", "first", "keys", "items"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            of, row = np.unique(np.stack([batch.column(k).to_numpy() for k in (1, 2, 3, 4)], 1), axis=0, return_inverse=True)
            vectors = batch.column(5)
            starts, items = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py(), vectors.flatten().to_numpy(zero_copy_only=False).astype(item)
            for k, about in enumerate(of.tolist()):
                here = np.flatnonzero(row.reshape(-1) == k)
                held.setdefault(tuple(about), []).append((keys[here], items[starts[here, None] + np.arange(about[0])].reshape(-1)))
                size += len(here) * (8 + about[0] * items.itemsize)
            if size > HELD:
                yield sent()
                held.clear()
                size = 0
        if held:
            yield sent()

    return each.select("key", "n", "own", "parts", "first", "vector").mapInArrow(pack, "n long, own long, parts long, first long, keys binary, items binary")


def _all_edges(vectors: DataFrame, least: float, part: int) -> DataFrame:
    """(u, v): verified pairs that connect all that similar pairs connect. All meet, in the cells of a grid for each length of vectors; each cell is a task of its own, to which its two parts are sent packed."""
    each = shipped(vectors).withColumn("n", F.size("vector").cast("long"))
    wide = F.greatest(F.col("n") / WIDE, F.lit(1.0))
    few = F.least(F.lit(PARTS), F.floor(F.col("rows") / FEWEST))
    parts = each.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("n", F.greatest(F.ceil(F.col("rows") * wide / part), few).cast("long").alias("parts"))
    made = F.expr("parts * (parts + 1) div 2")
    parts = cut(parts.withColumn("first", F.sum(made).over(Window.orderBy("n")) - made))  # a row for each length of vectors
    cells = parts.agg(F.coalesce(F.sum(made), F.lit(0))).first()[0]
    item = "<f4" if vectors.schema["vector"].dataType.elementType == FloatType() else "<f8"
    dealt = each.join(F.broadcast(parts), "n").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    sent = _packed(dealt, item).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    sent = sent.select((F.col("first") + F.expr("least(own, other) * parts - least(own, other) * (least(own, other) - 1) div 2") + j - i).cast("int").alias("cell"), "n", (F.col("own") > F.col("other")).alias("second"), (i == j).alias("one"), "keys", "items")

    def compared(batches):
        held = [], []
        n, one = 0, True
        for batch in batches:
            for n, second, one, k, items in zip(*(batch.column(x).to_pylist() for x in (1, 2, 3)), *(batch.column(x) for x in (4, 5))):
                held[second].append((k.as_buffer(), items.as_buffer()))
        sizes = [sum(k.size for k, _ in side) // 8 for side in held]
        if not sizes[0] or not (one or sizes[1]):
            return
        keys, x, at = np.empty(sum(sizes), np.int64), np.empty((sum(sizes), n)), 0
        for side in held:
            while side:  # let go of one by one
                k, items = side.pop()
                end = at + k.size // 8
                keys[at:end], x[at:end] = np.frombuffer(k, np.int64), np.frombuffer(items, item).reshape(-1, n)
                at = end
        batch = k = items = None  # else they stay while vectors are compared
        edges = forest_of_cell(_unit(x), np.repeat([0, 1], sizes), least)
        for at in range(0, len(edges), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[list(k)]) for k in zip(*edges[at : at + 100_000])], ["u", "v"])

    return sent.repartitionById(max(cells, 1), "cell").mapInArrow(compared, "u long, v long")


def similar_edges(vectors: DataFrame, least: float = LEAST, recall: float = RECALL, part: int = PART) -> DataFrame:
    """(u, v) between the keys, numbers, of ``vectors`` (key, vector), all usable and different: verified pairs at ``least`` or more that connect all that such pairs connect, in some bucket if ``recall`` is less than 1."""
    if recall >= 1:
        return _all_edges(vectors, least, part)
    each = shipped(vectors).withColumn("n", F.size("vector")).withColumn("keys", plane_keys(F.col("vector"), *shape(vectors.count(), least, recall)))
    each = each.select("key", "n", "vector", F.posexplode("keys").alias("t", "bucket"))
    counts = each.groupBy("t", "bucket", "n").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    few = F.least(F.lit(PARTS), F.floor(F.col("rows") / FEWEST))
    wide = F.greatest(F.col("n") / WIDE, F.lit(1.0))
    parts = counts.select("t", "bucket", "n", F.greatest(F.ceil(F.col("rows") * wide / part), few).alias("parts"))
    dealt = each.join(parts, ["t", "bucket", "n"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("t", "bucket", "n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "vector")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("own", kind="stable")
        x = _unit(np.stack([np.asarray(v, np.float64) for v in rows["vector"]]))
        own, keys = rows["own"].to_numpy(), rows["key"].tolist()
        # Pairs of one part meet in that part's own cell, so another's cell without both has none.
        edges = [] if rows["i"].iloc[0] != rows["j"].iloc[0] and own[0] == own[-1] else forest_of_cell(x, own, least)
        return pd.DataFrame({"u": [keys[a] for a, _ in edges], "v": [keys[b] for _, b in edges]}, dtype=object)

    return cells.groupBy("t", "bucket", "n", "i", "j").applyInPandas(compared, "u long, v long").distinct()


def groups(df: DataFrame, id_: str, vector: str, least: float = LEAST, recall: float = RECALL, part: int = PART) -> DataFrame:
    """(id, group_id, rows) for each row of ``df``: the least id of its group and the number of the group's rows."""
    rows = df.select(F.col(id_).alias("id"), F.col(vector).alias("vector")).withColumn("usable", usable(F.col("vector")))
    # 128 bits tell a vector from others, as text; one without a direction has none.
    key = F.concat(F.hex(F.xxhash64(F.lit(1), "vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(2), "vector")))
    rows = rows.withColumn("key", F.when(F.col("usable"), key))
    kept = rows.filter(F.col("key").isNotNull())
    # Classes go by numbers from here on, which take less room in edges; they are written down, so the numbers stay.
    classes = cut(kept.groupBy("key").agg(F.first("vector").alias("vector"))).withColumn("node", F.monotonically_increasing_id())
    roots = components(similar_edges(classes.select(F.col("node").alias("key"), "vector"), least, recall, part))
    roots = classes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    told = kept.select("id", "key").join(roots, "key").select("id", "root")
    sizes = told.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("rows"))
    alone = rows.filter(F.col("key").isNull()).select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("rows"))
    return told.join(sizes, "root").select("id", "group_id", "rows").unionAll(alone)
