"""SimHash near-duplicate components.

A document's fingerprint takes the XXH64 (seed 42) of each of its word shingles, repeats included; a bit is set where
more than half of the hashes have it. Fingerprints link at ``most`` (3) or fewer differing bits.

Links are found among the distinct fingerprints alone. Two fingerprints that differ in at most three bits agree on at
least two of five bit blocks, so each is dealt to the ten pairs of blocks, and equal keys meet. Within a key, a pivot
table holds the Hamming distance of each fingerprint to ``PIVOTS`` reference fingerprints; a pair whose distances differ
by more than ``most`` at any pivot cannot be near (triangle inequality) and goes, the others are verified by their own
bits. A key yields the links of a spanning forest only, never all pairs. Components then come from alternating star
contraction over those links, with no step on the driver.

Defined cases: words are runs of anything but space and tab to carriage return, A-Z lower-cased; fewer words than a
shingle form one shingle; null, empty or blank texts have fingerprint zero, which links like any other; repeated rows stay,
each with its component; a null id keeps its row and never names a component unless all its members are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.common import cut, private, shipped

#: Reference fingerprints of the pivot table.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Five blocks of the 64 bits, from the lowest.
BLOCKS = tuple(((1 << hi) - (1 << lo)) for lo, hi in pairwise((0, 13, 26, 39, 52, 64)))
#: A key with more fingerprints than this is split by further bits first.
LONG_RUN = 8192
_HASHES = 200_000
#: A key with more rows than this is joined by broadcast; but never more than MOST_HEAVY keys are (some MB).
HEAVY, MOST_HEAVY = 100_000, 100_000


def _votes(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _HASHES):
        votes += _votes([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _HASHES], ends[k : k + _HASHES], strict=True)])
    return sum(1 << int(k) for k in np.flatnonzero(2 * votes > len(starts)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shipped(rows).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Union of positions 0..n-1, the smallest one leading."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(self.root[a], self.root[b])
            before = self.root.copy()
            for side in (a, b):
                np.minimum.at(self.root, before[side], low)  # only roots are lowered, so members of earlier calls follow
            while not np.array_equal(self.root, further := self.root[self.root]):
                self.root = further
            if np.array_equal(before, self.root):
                return


def _near(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs (a, b) survive the pivot table and then differ in ``most`` bits at most."""
    apart = np.abs(table[a] - table[b]).max(axis=1) <= most
    apart[apart] = np.bitwise_count(fps[a[apart]] ^ fps[b[apart]]) <= most
    return apart


def _link_run(fps: np.ndarray, table: np.ndarray, at: np.ndarray, forest: _Forest, most: int, shared: int) -> None:
    """Link the fingerprints at positions ``at``, which agree on the bits of ``shared``."""
    if len(at) > LONG_RUN and shared:
        rest = [k for k in range(64) if not shared >> k & 1]
        for part in np.array_split(np.array(rest, dtype=np.uint64), most + 1):
            mask = np.uint64(sum(1 << int(k) for k in part))
            keys = fps[at] & mask
            order = np.argsort(keys, kind="stable")
            for run in np.split(at[order], np.flatnonzero(np.diff(keys[order])) + 1):
                if len(run) > 1:
                    _link_run(fps, table, run, forest, most, 0)
        return
    at = at[np.argsort(table[at, 0], kind="stable")]
    first = table[at, 0]
    for lo in range(0, len(at), 512):
        part = at[lo : lo + 512]
        hi = int(np.searchsorted(first, first[min(lo + 511, len(at) - 1)] + most, side="right"))
        for start in range(lo, hi, 512):
            other = at[start : min(start + 512, hi)]
            a, b = np.repeat(part, len(other)), np.tile(other, len(part))
            wanted = forest.root[a] != forest.root[b]
            a, b = a[wanted], b[wanted]
            near = _near(fps, table, a, b, most)
            if near.any():
                forest.join(a[near], b[near])


def _links_of(keys: np.ndarray, tables: np.ndarray, fps: np.ndarray, most: int) -> np.ndarray:
    """Links (fp, root) of a spanning forest over rows sorted by (table, key)."""
    pivots = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    forest = _Forest(len(fps))
    cuts = np.concatenate(([0], np.flatnonzero((np.diff(keys) != 0) | (np.diff(tables) != 0)) + 1, [len(fps)]))
    lengths = np.diff(cuts)
    run_end = np.repeat(cuts[1:], lengths)
    short = np.repeat(lengths <= 64, lengths)
    found_a, found_b = [], []
    for step in range(1, int(min(64, lengths.max(initial=0)))):
        a = np.flatnonzero(short & (np.arange(len(fps)) + step < run_end))
        if not len(a):
            break
        near = _near(fps, pivots, a, a + step, most)
        found_a.append(a[near])
        found_b.append(a[near] + step)
    if found_a:
        forest.join(np.concatenate(found_a), np.concatenate(found_b))
    for k in np.flatnonzero(lengths > 64):
        pair = _PAIRS[int(tables[cuts[k]])]
        _link_run(fps, pivots, np.arange(cuts[k], cuts[k + 1]), forest, most, pair)
    linked = np.flatnonzero(forest.root != np.arange(len(fps)))
    return np.unique(np.stack([fps[linked], fps[forest.root[linked]]], axis=1), axis=0)


_PAIRS = [BLOCKS[i] | BLOCKS[j] for i, j in combinations(range(5), 2)]


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (u, v), u > v as signed longs, that connect the distinct fingerprints ``nodes`` (fp) within ``most`` bits."""
    if not 0 <= most <= 3:
        raise ValueError("five blocks prove the search whole for 0 to 3 differing bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in _PAIRS]
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def batch_of():
            t, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            found = _links_of(key, t, fp.view(np.uint64), most).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            # All but the run that may go on in the next batch is linked now; a long run is only gathered.
            starts = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0)) + 1
            if held and (held[-1][0][-1], held[-1][1][-1]) != (t[0], key[0]):
                yield batch_of()
                held = []
            if len(starts):
                last = int(starts[-1])
                held.append((t[:last], key[:last], fp[:last]))
                yield batch_of()
                held = [(t[last:], key[last:], fp[last:])]
            else:
                held.append((t, key, fp))
        if held:
            yield batch_of()

    return dealt.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "u long, v long").distinct()


def _by_key(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``one``, which has a row for each key and in ``rows_of_key`` the number of rows that have it.

    A key with more than ``HEAVY`` of the ``total`` rows would make one task's work of them, so such keys are broadcast; there are fewer than total / HEAVY of them.
    """
    plain = one.drop("rows_of_key")
    if total <= HEAVY:
        return rows.join(plain, key)
    most = F.lit(max(HEAVY, total // MOST_HEAVY))
    heavy = F.broadcast(one.filter(F.col("rows_of_key") > most).drop("rows_of_key"))
    light = rows.join(heavy.select(key), key, "left_anti").join(one.filter(F.col("rows_of_key") <= most).drop("rows_of_key"), key)
    return light.unionByName(rows.join(heavy, key))


def pivot_counts(nodes: DataFrame, most: int = 3) -> DataFrame:
    """One row: pairs of different fingerprints that share a key, how many of them the pivot tables leave, and how many are near. For reports: all pairs are made."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _PAIRS]
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))

    def run(table: pa.Table) -> pa.Table:
        fps = table["fp"].to_numpy().view(np.uint64)
        pivots = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)
        left = near = 0
        for k in range(len(fps) - 1):
            fits = np.abs(pivots[k + 1 :] - pivots[k]).max(axis=1) <= most
            left += int(fits.sum())
            near += int((np.bitwise_count(fps[k + 1 :][fits] ^ fps[k]) <= most).sum())
        return pa.table({"pairs": [len(fps) * (len(fps) - 1) // 2], "left_by_pivots": [left], "near": [near]})

    each = dealt.groupBy("t", "key").applyInArrow(run, "pairs long, left_by_pivots long, near long")
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "left_by_pivots", "near")])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for each node of ``edges`` (u > v) that isn't itself the smallest of its component.

    Alternates the large-star and small-star steps until the links no longer change.
    """

    def mark(frame):
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = cut(edges)
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("rows_of_key"))
        large = _by_key(both, least, "u", 2 * seen[0]).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") > F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of_key"))
        moved = _by_key(large, low, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") > F.col("v"))
        now = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if (mark_now := mark(now)) == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = mark_now
    if seen[0]:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    return now.select("u", F.col("v").alias("root"))


def _rooted(docs: DataFrame, most: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, least, root) of each distinct fingerprint."""
    made = cut(fingerprints(docs, shingle))
    nodes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows_of_key")))
    root = components(links(nodes.select("fp"), most))
    named = nodes.join(root.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return made, named


def near_components(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id of the component."""
    made, named = _rooted(docs, most, shingle)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id", "rows_of_key")
    return _by_key(made, by_fp, "fp", made.count()).select("doc_id", "fp", "component_id")


#: Most bytes of exceptions that one_of_each sends to every executor.
BROADCAST_BYTES = 64 << 20


def one_of_each(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns as they are: of each component the row with its smallest doc_id.

    Of several rows with that id, those of another fingerprint go, and one of the rest stays. A component of null ids
    keeps one row too. Ids with one row that stays are the rule; while the other ids are few (``BROADCAST_BYTES``), they are broadcast and no text
    is shuffled, else texts and ids are joined by shuffle.
    """
    made, named = _rooted(docs, most, shingle)
    n, kept, fp, rank = (private(x) for x in ("n", "kept", "fp", "rank"))
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("s"))
    chosen = chosen.select(F.col("s.least").alias("doc_id"), F.col("s.fp").alias("fp"), F.lit(1).alias("c"))
    rows = made.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    marked = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["fp"] == chosen["fp"]), "left")
    id_, null = private("id"), private("null")
    per_id = marked.groupBy(F.coalesce(rows["doc_id"], F.lit(0)).alias(id_), rows["doc_id"].isNull().alias(null)).agg(
        F.sum("n").alias(n), F.collect_list(F.when(F.col("c") == 1, rows["fp"])).alias(kept)
    )
    odd = cut(per_id.filter((F.col(n) > 1) | (F.size(kept) != 1)))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), null: F.col("doc_id").isNull()})
    size = odd.agg(F.coalesce(F.sum(F.lit(40) + 8 * F.size(kept)), F.lit(0)), F.count_if((F.col(n) > 1) & (F.size(kept) > 0))).first()
    sent = F.broadcast if size[0] <= BROADCAST_BYTES else lambda df: df
    plain = keyed.join(sent(odd.select(id_, null)), [id_, null], "left_anti").select(*docs.columns)
    if not size[1]:
        return plain

    @F.pandas_udf("long")
    def again(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    several = keyed.join(sent(odd.filter((F.col(n) > 1) & (F.size(kept) > 0))), [id_, null])
    several = several.withColumn(fp, again(F.col("text").cast("string"))).filter(F.array_contains(kept, F.col(fp)))
    order = Window.partitionBy(id_, null, fp).orderBy(F.xxhash64("text"))
    one = several.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return plain.unionByName(one.select(*docs.columns))
