"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits at a random direction for each level, at the median of a bounded sample (``fit_rows``) at each node; the driver holds
directions and medians only, and broadcasts them. Every row is then dealt to its leaf of each tree. A query walks all trees through one
priority queue, always going on at the node whose splits it is least on the wrong side of, until it has enough leaves. How many those are is measured:
on the sample, whose own nearest neighbours are known by brute force, as many as reach ``target`` of them for ``probe_queries`` of its rows. That is an
estimate, not a bound: the table's own recall came out up to 0.02 below it. Data in clusters need few leaves, data without structure many.

Rows and queries meet by subtrees of about ``block_rows`` rows, where exact distances rank the candidates in the leaves that the query asks for; the best of
each subtree are merged. No task holds more: leaves that are larger on average are split evenly, and more than ``ask_rows`` queries go in several groups, to each
of which the rows are sent. A query travels once for each subtree that it visits, with a vector against some ten thousand distances computed there.

Equal vectors count once in the forest (no split could part them); each stands for its ``k + 1`` first rows, all that a list of ``k`` can need.

Defined cases: vectors null, empty, zero, or with a null or non-finite component take no part, nor do rows with a null id, or vectors of another
length than most have (of equally common lengths the longer); rows that share an id are rows of their own, as queries and as candidates, so their lists come under
one query_id; nearest first, ties to the smaller id; with fewer than k candidates, all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.common import cut, least_ids, shipped


class Forest:
    """Directions (tree, level, dimension) and thresholds (tree, node in breadth-first order)."""

    def __init__(self, directions: np.ndarray, thresholds: np.ndarray):
        self.directions, self.thresholds = directions, thresholds
        self.trees, self.depth = directions.shape[0], directions.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((trees, depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True) + 1e-300
        thresholds = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            placed = [np.arange(len(sample))]
            for level in range(depth):
                shadow = sample @ directions[t, level]
                below = []
                for k, rows in enumerate(placed):
                    middle = float(np.median(shadow[rows])) if len(rows) else 0.0
                    thresholds[t, (1 << level) - 1 + k] = middle
                    right = shadow[rows] > middle
                    below += [rows[~right], rows[right]]
                placed = below
        return cls(directions, thresholds)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        for t in range(self.trees):
            shadow = vectors @ self.directions[t].T
            for level in range(self.depth):
                node = (1 << level) - 1 + out[:, t]
                out[:, t] = 2 * out[:, t] + (shadow[:, level] > self.thresholds[t, node])
        return out

    def search(self, vector: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """The first ``probes`` (tree, leaf) that one queue over all trees reaches."""
        shadow = (self.directions @ vector).tolist()
        thresholds = self.thresholds
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        found = []
        while queue and len(found) < probes:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = shadow[t][level] - thresholds[t, (1 << level) - 1 + node]
                near = int(margin > 0)
                heapq.heappush(queue, (max(cost, abs(margin)), t, level + 1, 2 * node + 1 - near))
                node, level = 2 * node + near, level + 1
            found.append((t, node))
        return found

    def probes_for(self, sample: np.ndarray, k: int, target: float, queries: int = 64) -> int:
        """Leaves to visit so that ``target`` of the k nearest neighbours within ``sample`` are met."""
        leaf, needed = self.leaves(sample), []
        for own in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
            score = ((sample - sample[own]) ** 2).sum(axis=1)
            score[own] = np.inf
            near = np.argsort(score, kind="stable")[: min(k, len(sample) - 1)]
            order = np.full((self.trees, 1 << self.depth), 1 << 60)
            for place, (t, node) in enumerate(self.search(sample[own], self.trees << self.depth)):
                order[t, node] = place + 1
            needed += order[np.arange(self.trees)[:, None], leaf[near].T].min(axis=0).tolist()
        return int(np.quantile(needed, target, method="higher")) if needed else 1


#: Blocks of all trees whose numbers of askers are broadcast, some bytes each; beyond that they are joined by shuffle.
MOST_BLOCKS = 1_000_000


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """(row, id, v) of each row with a vector that takes part; row tells apart those that share an id."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.filter(F.col(id_).isNotNull() & v.isNotNull() & fine).select(F.col(id_).cast("long").alias("id"), v.alias("v"))
    width = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("v") == (width["n"] if width else 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as lines of a float64 matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _closest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query, the places of its k nearest rows and their exact distances; ties to the smaller id.

    Distances by matrix product find all that may be among the k, with room for rounding; exact ones rank those.
    """
    length = (rows**2).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(rows)))
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        own = (part**2).sum(axis=1)
        rough = own[:, None] + length[None] - 2 * part @ rows.T
        slack = 1e-9 * (own + length.max(initial=0.0))
        for q, line, room in zip(part, rough, slack, strict=True):
            at = np.arange(len(rows))
            if len(rows) > k and np.isfinite(line).all():
                at = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1] + room)
            score = np.sqrt(((rows[at] - q) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], score))[:k]
            yield at[best], score[best]


def neighbours(
    rows: DataFrame,
    is_query,
    k: int = 10,
    id_: str = "vec_id",
    vector: str = "embedding",
    trees: int = 6,
    target: float = 0.97,
    leaf_rows: int = 400,
    block_rows: int = 16_000,
    ask_rows: int = 16_000,
    fit_rows: int = 10_000,
    probe_queries: int = 64,
    seed: int = 1,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row whose id satisfies ``is_query`` (a function of the id column)."""
    shipped(rows)
    each = cut(usable(rows, id_, vector))
    by_vector = Window.partitionBy("v").orderBy("id", "row")
    first = each.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    # A group goes by its first row.
    groups = cut(first.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members")).select(F.col("members")[0]["row"].alias("id"), "v", "members"))
    n = groups.count()
    # By the vector, not the row's number, so that the sample doesn't hang on how rows are dealt out.
    sample = least_ids(groups.select(F.xxhash64("v").alias("id"), "v"), fit_rows, "id").toArrow().sort_by("id")
    taught = _matrix(sample["v"]) if len(sample) else np.zeros((0, 1))
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    depth = min(depth, int(np.log2(max(1, len(taught) / 8))))
    forest = Forest.fit(taught, trees if depth else 1, depth, seed)
    probes = forest.probes_for(taught, k, target, probe_queries)
    queries = each.filter(is_query(F.col("id")))
    splits = max(1, int(np.ceil(n / (1 << depth) / block_rows)))
    shift = min(depth, max(0, int(np.log2(max(1.0, block_rows * (1 << depth) / max(1, n))))))
    sent = rows.sparkSession.sparkContext.broadcast((forest.directions, forest.thresholds))
    kind = each.schema["v"].dataType.simpleString()

    def deal(batches):
        own = Forest(*sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0), batch.column(1)
            leaf, part = own.leaves(_matrix(v)), pa.array(ids.to_numpy() % splits)
            for t in range(own.trees):
                tree = pa.array(np.full(batch.num_rows, t, np.int32))
                columns = [tree, pa.array(leaf[:, t] >> shift), part, pa.array(leaf[:, t]), ids, v]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "part", "leaf", "id", "v"])

    def ask(batches):
        own = Forest(*sent.value)
        for batch in batches:
            for place, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else []):
                wanted: dict[tuple[int, int], list[int]] = {}
                for t, leaf in own.search(q, probes):
                    wanted.setdefault((t, leaf >> shift), []).append(leaf)
                again = pa.array(np.full(len(wanted), place))
                tree, block = (np.array(x) for x in zip(*wanted, strict=True))
                columns = [pa.array(tree.astype(np.int32)), pa.array(block), pa.array(wanted.values(), pa.list_(pa.int64()))]
                columns += [batch.column(0).take(again), batch.column(1).take(again)]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "leaves", "query_id", "q"])

    result = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def meet(members: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(members) or not len(asked):
            return result.empty_table()
        leaf, ids, vectors = members["leaf"].to_numpy(), members["id"].to_numpy(), _matrix(members["v"])
        query, q, leaves = asked["query_id"].to_numpy(), _matrix(asked["q"]), asked["leaves"].combine_chunks()
        owner, wanted = leaves.value_parent_indices().to_numpy(), leaves.flatten().to_numpy()
        out = []
        for one in np.intersect1d(wanted, leaf):
            rows, who = np.flatnonzero(leaf == one), owner[wanted == one]
            for k_, (at, score) in zip(who, _closest(q[who], vectors[rows], ids[rows], k + 1), strict=True):
                out.append((np.full(len(at), query[k_]), ids[rows[at]], score))
        if not out:
            return result.empty_table()
        found, near, score = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((near, score, found))
        found, near, score = found[order], near[order], score[order]
        first = np.searchsorted(found, found, side="left")
        kept = np.arange(len(found)) - first <= k
        return pa.table([found[kept], near[kept], score[kept]], schema=result)

    dealt = groups.select("id", "v").mapInArrow(deal, f"tree int, block long, part long, leaf long, id long, v {kind}")
    asked = queries.select(F.col("row").alias("id"), "v").mapInArrow(ask, f"tree int, block long, leaves array<long>, query_id long, q {kind}")
    asked = cut(asked)
    # Queries in groups that a task can hold. Only where more ask for a block do its rows go to several tasks; where none asks they go nowhere.
    shares = asked.groupBy("tree", "block").agg(F.ceil(F.count(F.lit(1)) / ask_rows).alias("shares"))
    if forest.trees * ((1 << depth) >> shift) <= MOST_BLOCKS:
        shares = F.broadcast(shares)
    dealt = dealt.join(shares, ["tree", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    asked = asked.join(shares, ["tree", "block"]).withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares"))).drop("shares")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
    key = ["tree", "block", "part", "share"]
    met = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "query_id long, id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "id")
    best = met.distinct().withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).drop("n")
    whole = best.join(groups.select("id", "members"), "id").select("query_id", "score", F.explode("members").alias("m"))
    whole = whole.filter(F.col("m.row") != F.col("query_id")).select("query_id", "score", "m.id", "m.row")
    nearest = Window.partitionBy("query_id").orderBy("score", "id", "row")
    ranked = whole.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query_id"), F.col("id").alias("named"))
    return ranked.join(named, "query_id").select(F.col("named").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
