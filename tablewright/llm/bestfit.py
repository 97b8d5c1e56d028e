"""Best-fit packing of token sequences with a swap-based local search.

Documents become token pieces, pieces become sequences of at most ``seq_len`` tokens. Tokenising is a narrow pass
over the texts; only one short row per piece travels afterwards. Full pieces are sequences as they are. The rest is
dealt evenly over cells of about ``cell_items`` pieces, each packed by itself: from best-fit decreasing, a local search goes on
until the bound is met or no underfull bin of the cell has a step. A step moves one piece or two out of an underfull bin into another, or
exchanges them for one or two of it, so that the sum of squared fills rises; first comes what fills the other bin to the last token, then
what puts most into it. Where none does, a piece goes to a full bin for two that are as long together, which fit elsewhere.
No choice is capped: all underfull bins, all their pieces and pairs are candidates.

Defined cases: a null text is an empty one (its end token alone); every row is a document of its own, so repeated rows
are packed repeatedly and a null id stays null; equal lengths are taken in order of arrival; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import cut, shipped
from tablewright.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n_ids: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first of an overlong document, which takes the rest."""
    if n_ids <= seq_len:
        return [(0, n_ids)]
    first = n_ids % seq_len
    starts = ([0] if first else []) + list(range(first, n_ids, seq_len))
    return [(s, first if first and s == 0 else seq_len) for s in starts]


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", eos_id: int = 2, seq_len: int = 1024) -> DataFrame:
    """One row per piece: its document, number, place in the document, length and the crc32 of its ids."""

    def run(batches):
        ids_of = encoder(tokenizer if os.path.isabs(tokenizer) else tokenizer_path(tokenizer)).ids
        end = np.array([eos_id], dtype=np.uint32)
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([ids_of(text.as_py()), end]).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cuts(len(ids), seq_len)):
                    row = doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shipped(rows).mapInArrow(run, PIECES)


class Bins:
    """Bins of one capacity. Those with the same free room stand together, ordered by room, for best fit."""

    def __init__(self, lengths, capacity: int):
        self.lengths = [int(x) for x in lengths]
        self.capacity = capacity
        self.members: list[list[int]] = []
        self.free: list[int] = []
        self.count = 0
        self.needed = -(-sum(self.lengths) // capacity)
        #: By free room: the bins, and (while the search runs) the bins by each total of one or two of their pieces.
        self._alike: dict[int, dict[int, None]] = {}
        self._totals: dict[int, dict[int, dict[int, None]]] | None = None
        self._rooms: list[int] = []

    def _choices(self, bin_: int) -> dict[int, tuple[int, ...]]:
        """One piece or pair of pieces for each total, the longest pieces first; of one total a single piece."""
        by: dict[int, list[int]] = {}
        for k in self.members[bin_]:
            by.setdefault(self.lengths[k], []).append(k)
        sizes = sorted(by, reverse=True)
        out = {x: (by[x][0],) for x in sizes}
        for at, x in enumerate(sizes):
            if len(by[x]) > 1:
                out.setdefault(2 * x, tuple(by[x][:2]))
            for y in sizes[at + 1 :]:
                out.setdefault(x + y, (by[x][0], by[y][0]))
        return out

    def _remove(self, bin_: int) -> None:
        room = self.free[bin_]
        if self._totals is not None:
            own = self._totals[room]
            for total in self._choices(bin_):
                del own[total][bin_]
                if not own[total]:
                    del own[total]
        del self._alike[room][bin_]
        if not self._alike[room]:
            del self._alike[room], self._rooms[bisect_left(self._rooms, room)]

    def _add(self, bin_: int) -> None:
        room = self.free[bin_]
        if room not in self._alike:
            self._alike[room] = {}
            insort(self._rooms, room)
        self._alike[room][bin_] = None
        if self._totals is not None:
            own = self._totals.setdefault(room, {})
            for total in self._choices(bin_):
                own.setdefault(total, {})[bin_] = None

    def change(self, bin_: int, give: tuple[int, ...], get: tuple[int, ...]) -> None:
        """Take the pieces ``give`` out of a bin and put ``get`` into it."""
        members = self.members[bin_]
        if members:
            self._remove(bin_)
            self.count -= 1
        for k in give:
            members.remove(k)
        members.extend(get)
        self.free[bin_] += sum(self.lengths[k] for k in give) - sum(self.lengths[k] for k in get)
        if members:
            self._add(bin_)
            self.count += 1

    def fill(self, order: Iterable[int]) -> None:
        """Each piece, in the given order, into the bin it fills best, or a new one."""
        for k in order:
            at = bisect_left(self._rooms, self.lengths[k])
            if at < len(self._rooms):
                bin_ = next(iter(self._alike[self._rooms[at]]))
            else:
                bin_ = len(self.members)
                self.members.append([])
                self.free.append(self.capacity)
            self.change(bin_, (), (k,))

    def best_fit(self) -> None:
        """Longest first, each into the bin it fills best, or a new one."""
        self.fill(sorted(range(len(self.lengths)), key=lambda k: -self.lengths[k]))

    def improve(self) -> None:
        """Step over all underfull bins, from the emptiest on, until the bound is met or a round changes nothing."""
        self._totals = {}
        for bin_, members in enumerate(self.members):
            if members:
                self._add(bin_)
        changed = True
        while changed:
            changed = False
            for giver in [b for room in reversed(self._rooms) if room for b in self._alike[room]]:
                while self.count > self.needed and self.members[giver] and self.free[giver] and self._step(giver):
                    changed = True
                if self.count <= self.needed:
                    return

    def _step(self, giver: int) -> bool:
        """One move or exchange out of ``giver``: one that raises the sum of squared fills, else one that breaks a piece up."""
        given = self._choices(giver)
        found = self._filling(giver, given) or self._raising(giver, given) or self._even(giver, given)
        if not found:
            return False
        other, give, get = found
        self.change(giver, give, get)
        self.change(other, get, give)
        return True

    def _partner(self, giver: int, room: int, back: int) -> int | None:
        """A bin with so much room, but not ``giver``, that can give back a total of ``back`` (anything, if 0)."""
        bins = self._totals[room].get(back, ()) if back else self._alike[room]
        return next((b for b in bins if b != giver), None)

    def _exchange(self, other: int, give: tuple[int, ...], back: int):
        return other, give, self._choices(other)[back] if back else ()

    def _filling(self, giver: int, given: dict[int, tuple[int, ...]]):
        """The step that fills another bin to the last token, and most by it."""
        for room in reversed(self._rooms):
            # The squares rise if the other bin ends up fuller than the giver is now; a full one does.
            for total, give in given.items():
                if 0 < room <= total and (other := self._partner(giver, room, total - room)) is not None:
                    return self._exchange(other, give, total - room)
        return None

    def _raising(self, giver: int, given: dict[int, tuple[int, ...]]):
        """The step that puts most into another bin which ends up fuller than the giver is now."""
        best, most, fill = None, 0, self.capacity - self.free[giver]
        for room in reversed(self._rooms):
            if room <= most:
                break
            least = max(most, fill - (self.capacity - room))
            for total, give in given.items():
                for more in range(min(room - 1, total), least, -1):
                    if (other := self._partner(giver, room, total - more)) is not None:
                        best, most = (other, give, total - more), more
                        least = more
                        break
        return best and self._exchange(*best)

    def _even(self, giver: int, given: dict[int, tuple[int, ...]]):
        """A piece for two of a full bin that are as long together: no fill changes, but shorter pieces find a place more easily.

        Full bins hold one piece less after it, so such steps, too, come to an end.
        """
        if 0 not in self._alike:
            return None
        for total, give in given.items():
            if len(give) > 1:
                continue
            for other in self._totals[0].get(total, ()):
                if len(pair := self._pair(other, total)) == 2:
                    return other, give, pair
        return None

    def _pair(self, bin_: int, total: int) -> tuple[int, ...]:
        by: dict[int, int] = {}
        for k in self.members[bin_]:
            if (rest := by.get(total - self.lengths[k])) is not None:
                return rest, k
            by.setdefault(self.lengths[k], k)
        return ()


def pack_lengths(lengths, capacity: int) -> list[list[int]]:
    """Indexes of ``lengths`` by bin."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    return [m for m in bins.members if m]


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    eos_id: int = 2,
    seq_len: int = 1024,
    cell_items: int = 16384,
) -> DataFrame:
    """Pieces of ``docs`` with their ``sequence_id`` and ``offset`` in it."""
    made = cut(pieces(docs, tokenizer, eos_id, seq_len).withColumn("__row", F.monotonically_increasing_id()))
    part = _in_cells(made, seq_len, cell_items)
    full = made.filter(F.col("length") >= seq_len).withColumns(
        {"sequence_id": F.col("__row") + F.lit(1 << 61), "offset": F.lit(0).cast("long")}
    )

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("__row")
        lengths = group["length"].to_numpy()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        cell = group["__cell"][0].as_py()
        for number, members in enumerate(pack_lengths(lengths, seq_len)):
            sequence[members] = (cell << 32) + number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        placed = group.drop_columns(["__cell", "__row"])
        return placed.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = part.groupBy("__cell").applyInArrow(fill, PIECES + ", sequence_id long, offset long")
    return full.drop("__row").unionByName(packed)


def _in_cells(made: DataFrame, seq_len: int, cell_items: int) -> DataFrame:
    """The pieces shorter than a sequence, each with the number of its cell."""
    part = made.filter(F.col("length") < seq_len)
    cells = max(1, -(-part.count() // cell_items))
    return part.withColumn("__cell", F.pmod(F.xxhash64("__row"), F.lit(cells)))


def search_gain(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    eos_id: int = 2,
    seq_len: int = 1024,
    cell_items: int = 16384,
) -> DataFrame:
    """One row: sequences of the pieces shorter than a sequence as the search began and ended, and the least that their tokens need."""
    made = cut(pieces(docs, tokenizer, eos_id, seq_len).withColumn("__row", F.monotonically_increasing_id()))

    def counted(group: pa.Table) -> pa.Table:
        bins = Bins(group.sort_by("__row")["length"].to_numpy(), seq_len)
        bins.best_fit()
        began = bins.count
        bins.improve()
        return pa.table({"at_first": [began], "at_last": [bins.count], "tokens": [sum(bins.lengths)]})

    each = _in_cells(made, seq_len, cell_items).groupBy("__cell").applyInArrow(counted, "at_first long, at_last long, tokens long")
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("at_first", "at_last", "tokens")]
    return each.agg(*sums).select("at_first", "at_last", F.ceil(F.col("tokens") / seq_len).cast("long").alias("at_least"))
