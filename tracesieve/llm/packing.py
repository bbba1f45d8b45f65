"""Best-fit packing of tokenised documents into sequences, improved by local search.

Pieces are dealt by a hash, their row number included, to shards of about ``SHARD`` pieces, so no task
holds more, whatever one source or document contributes, and however often a row repeats. In a shard best-fit decreasing places them. Then the least full
sequences are taken apart: their pieces are moved into others, or exchanged one for one, two for one
or one for two, whenever that makes the sum of squared fill larger, until sequences are empty or no
exchange helps. A shard leaves a sequence or so less full than it could be, one in thousands.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import id_and_text, map_batches, stored
from tracesieve.llm.tokens import encoder

CAPACITY = 1024
SHARD = 8192
# The search ends after so many sequences could not be made emptier.
PATIENCE = 40


def pieces(docs: DataFrame, tokenizer: str, end_id: int, byte_level: bool = True, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document longer than ``capacity`` is cut into
    pieces of ``capacity`` tokens, of which the first is shorter if the length does not divide."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = [], [[], [], [], []]
        for k, ids in enumerate(encoder(tokenizer, byte_level).encode([t or "" for t in batch.column(1).to_pylist()])):
            ids += end
            n = len(ids) // 4
            first = (n - 1) % capacity + 1
            edges = [0, *range(first, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                at.append(k)
                for column, value in zip(out, (piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                    column.append(value)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    return map_batches(rows, work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers. A bit set of the spaces that some bin has finds the tightest one."""
    bins: list[list[int]] = []
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            own = with_space[space].pop()
            if not with_space[space]:
                spaces ^= 1 << space
            bins[own].append(item)
        else:
            own, space = len(bins), capacity
            bins.append([item])
        left = space - size
        if left:
            with_space[left].append(own)
            spaces |= 1 << left
    return bins


class LocalSearch:
    """Moves and exchanges between bins that are not full; each raises the sum of squared fill."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        fill = [int(sizes[b].sum()) for b in bins]
        self.full = [b for b, f in zip(bins, fill) if f == capacity]
        self.bins = [b for b, f in zip(bins, fill) if f < capacity]
        self.fill = np.array([f for f in fill if f < capacity], np.int64)

    def _others(self, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of the other open bins, and the bin of each."""
        bin_of = np.repeat(np.arange(len(self.bins)), [len(b) for b in self.bins])
        items = np.array([i for b in self.bins for i in b], np.int64)
        keep = bin_of != own
        return items[keep], bin_of[keep]

    def _gain(self, delta: np.ndarray, target: np.ndarray, own: int) -> np.ndarray:
        return 2 * delta * (self.fill[target] - self.fill[own] + delta)

    def _apply(self, own: int, give: list[int], other: int, take: list[int]) -> None:
        for a, b, moved in ((own, other, give), (other, own, take)):
            for i in moved:
                self.bins[a].remove(i)
                self.bins[b].append(i)
                self.fill[a] -= self.sizes[i]
                self.fill[b] += self.sizes[i]

    def _improve(self, own: int) -> bool:
        """Makes ``own`` emptier by the best exchange there is; False if none helps."""
        items, bin_of = self._others(own)
        if not items.size:
            return False
        sizes, space = self.sizes[items], self.capacity - self.fill[bin_of]
        best: tuple = (0,)
        mine = sorted(self.bins[own], key=lambda i: (-self.sizes[i], i))
        offers = [[i] for i in mine] + [[a, b] for k, a in enumerate(mine[:8]) for b in mine[k + 1 : 8]]
        room = self.capacity - self.fill
        for offer in offers:
            size = int(self.sizes[offer].sum())
            # A move: the fullest bin with room.
            fits = np.flatnonzero((room >= size) & (np.arange(len(room)) != own))
            if fits.size:
                to = fits[self.fill[fits].argmax()]
                gain = int(self._gain(np.array([size]), np.array([to]), own)[0])
                if gain > best[0]:
                    best = (gain, offer, int(to), [])
            # One or two for one.
            delta = size - sizes
            ok = np.flatnonzero((delta > 0) & (delta <= space))
            if ok.size:
                gains = self._gain(delta[ok], bin_of[ok], own)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (int(gains[k]), offer, int(bin_of[ok[k]]), [int(items[ok[k]])])
            # One for two neighbours of a bin.
            if len(offer) == 1 and items.size > 1:
                pair = np.flatnonzero(bin_of[1:] == bin_of[:-1])
                delta2 = size - sizes[pair] - sizes[pair + 1]
                ok = np.flatnonzero((delta2 > 0) & (delta2 <= space[pair]))
                if ok.size:
                    at = pair[ok]
                    gains = self._gain(delta2[ok], bin_of[at], own)
                    k = int(gains.argmax())
                    if gains[k] > best[0]:
                        best = (int(gains[k]), offer, int(bin_of[at[k]]), [int(items[at[k]]), int(items[at[k] + 1])])
        if best[0] <= 0:
            return False
        self._apply(own, *best[1:])
        return True

    def _close(self) -> None:
        done = (self.fill == self.capacity) | (self.fill == 0)
        self.full += [b for b, d, f in zip(self.bins, done, self.fill) if d and f]
        self.bins = [b for b, d in zip(self.bins, done) if not d]
        self.fill = self.fill[~done]

    def run(self) -> list[list[int]]:
        stuck = 0
        tried: set[int] = set()
        while stuck < PATIENCE and len(self.bins) > 1:
            # Nothing can get emptier than what all of it needs at least.
            if len(self.bins) <= -(-int(self.fill.sum()) // self.capacity):
                break
            order = np.argsort(self.fill, kind="stable")
            own = next((int(o) for o in order[:PATIENCE] if self.bins[o][0] not in tried), None)
            if own is None:
                break
            name = self.bins[own][0]
            moves = 0
            while self.bins[own] and moves < 64 and self._improve(own):
                moves += 1
            if self.bins[own]:
                stuck += 1
                tried |= {name, self.bins[own][0]}
            self._close()
        return self.full + self.bins


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, every item in one bin, no bin above ``capacity``."""
    return LocalSearch(best_fit_decreasing(sizes, capacity), sizes, capacity).run()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, byte_level: bool = True, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts are one end token. Rows that repeat an id are documents of their own. No
    rows give no rows; other columns are not looked at."""
    cut = stored(pieces(docs, tokenizer, end_id, byte_level, capacity))
    shards = max(1, -(-cut.count() // shard))
    # The stored rows keep their partition and order, so that a row has the same number in every run of
    # a task.
    number = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = cut.withColumn("shard", F.pmod(number, F.lit(shards)))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy().astype(np.int64)
        base = table.column("shard")[0].as_py() << 32
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, items in enumerate(pack_sizes(sizes, capacity)):
            own = np.array(items)
            sequence[own] = base + number
            offset[own] = np.cumsum(sizes[own]) - sizes[own]
        columns = [table.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array(sequence), pa.array(offset)], [*("doc_id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(packed, schema)
