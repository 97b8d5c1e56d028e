"""Packed token-id sequences in binary form, by best-fit-decreasing with a segment tree over free capacity.

One narrow pass: each task tokenises its own rows, splits overlong documents losslessly, packs what it holds with a
segment tree, writes out nearly full sequences, and keeps the documents of the others for its next window. No token
travels over the network, and a lost task is redone from its input split alone.

A result row is one sequence: ``input_ids`` (little-endian unsigned ids, ``seq_len`` of them, padded with ``pad_id``),
``id_bytes`` (2 where the vocabulary allows it, else 4), ``n_tokens`` without padding, ``cu_seqlens`` (cumulative segment
lengths from 0), ``position_resets`` (places where positions start again from 0, padding included), and for each segment its
``doc_ids`` and ``starts`` (the ids of that document before it), which together restore each document.

Defined cases: a null text is an empty one (its end token alone); each row is a document of its own, so repeated rows
appear repeatedly and a null id stays null; equal lengths are taken in order of arrival; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import shipped
from tablewright.llm.tokens import encoder, tokenizer_path

PACKED = (
    "sequence_id long, n_tokens int, id_bytes int, input_ids binary, cu_seqlens array<int>, "
    "position_resets array<int>, doc_ids array<long>, starts array<long>"
)
_ARROW = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("id_bytes", pa.int32()),
        ("input_ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)


class CapacityTree:
    """Open bins by free capacity; a segment tree of counts finds the smallest capacity that still fits."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        node = free + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def pop_fitting(self, length: int) -> tuple[int, int] | None:
        """Remove and return (free, bin) with the least free capacity of at least ``length``."""
        node = length + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.width
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``lengths`` by bin, none of which holds more than ``capacity``."""
    tree, bins = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.pop_fitting(lengths[item])
        if found is None:
            bins.append([])
            found = capacity, len(bins) - 1
        bins[found[1]].append(item)
        if found[0] > lengths[item]:
            tree.add(found[0] - lengths[item], found[1])
    return bins


def packed_sequences(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    seq_len: int = 2048,
    eos_id: int = 50256,
    pad_id: int = 50256,
    window_ids: int = 4_000_000,
    full_enough: float = 0.995,
) -> DataFrame:
    """All documents of ``docs`` (doc_id, text) as packed sequences; see the module for the columns.

    A task packs whenever it holds ``window_ids`` ids, which bounds its memory; sequences filled to less than
    ``full_enough`` wait for the next window.
    """

    def run(batches):
        code = encoder(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer))
        width = 2 if max(code.size - 1, eos_id, pad_id) < 1 << 16 else 4
        end = np.array([eos_id], dtype=np.uint32)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, np.ndarray]] = []

        def flush(last: bool):
            nonlocal held, number
            rows, wait = [], []
            for members in best_fit_decreasing([len(x[2]) for x in held], seq_len):
                parts = [held[k] for k in members]
                bounds = np.cumsum([0, *(len(x[2]) for x in parts)]).tolist()
                if bounds[-1] < full_enough * seq_len and not last:
                    wait += parts
                    continue
                ids = np.concatenate([*(x[2] for x in parts), np.full(seq_len - bounds[-1], pad_id, np.uint32)])
                resets = bounds[:-1] + ([bounds[-1]] if bounds[-1] < seq_len else [])
                rows.append((number, bounds[-1], width, ids.astype(f"<u{width}").tobytes(), bounds, resets, [x[0] for x in parts], [x[1] for x in parts]))
                number += 1
            held = wait
            for k in range(0, len(rows), 512):
                columns = zip(*rows[k : k + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

        waiting = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([code.ids(text.as_py()), end])
                for start in range(0, len(ids), seq_len):
                    held.append((doc_id, start, ids[start : start + seq_len]))
                waiting += len(ids)
                if waiting >= window_ids:
                    yield from flush(False)
                    waiting = sum(len(x[2]) for x in held)
                    if waiting >= window_ids:
                        yield from flush(True)
                        waiting = 0
        yield from flush(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shipped(rows).mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed sequences as binary-column Parquet shards."""
    packed.write.mode("errorifexists").parquet(path)


def matrix(rows: list) -> np.ndarray:
    """Collected rows as one id matrix, a line for each sequence."""
    return np.stack([np.frombuffer(r["input_ids"], dtype=f"<u{r['id_bytes']}") for r in rows])


def restored(packed: DataFrame) -> DataFrame:
    """Token ids by document, put together again from the sequences (doc_id, ids); rows of one id are joined in order."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "starts"))
    flat = packed.select("input_ids", "id_bytes", "cu_seqlens", segment.alias("k", "s"))

    def ids_of(batches):
        for frame in batches:
            out = []
            for raw, width, bounds, k in zip(frame["input_ids"], frame["id_bytes"], frame["cu_seqlens"], frame["k"], strict=True):
                out.append(np.frombuffer(raw, dtype=f"<u{width}")[bounds[k] : bounds[k + 1]].astype(np.int64).tolist())
            yield frame[["doc_id", "start"]].assign(ids=out)

    parts = flat.select("input_ids", "id_bytes", "cu_seqlens", "k", F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"))
    found = parts.mapInPandas(ids_of, "doc_id long, start long, ids array<long>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"]))
    return found.groupBy("doc_id").agg(whole.alias("ids"))
