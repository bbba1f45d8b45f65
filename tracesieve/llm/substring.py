"""Substring dedup: every window of ``WINDOW`` words that occurs elsewhere is removed.

1. Each window has an anchor, the smallest hash among its runs of ``GRAM`` words (the leftmost of
   equals). Equal windows have equal anchors at equal places, so a window that repeats has an
   anchor that repeats, and consecutive windows mostly share theirs: about one word in ten is one.
2. Count-min prefilter: every partition sketches its anchors, the sketches are merged cell by cell,
   and a cell keeps one bit, whether its count is at least two. Counts are never too small,
   so a window whose anchor is in a cell counted once is unique; nothing that repeats is lost.
3. The other windows are grouped exactly. Windows of one anchor form a block. Blocks whose words
   are all equal are counted as one; only where an anchor has different blocks are their windows
   looked at one by one. Keys are 64 bits of the anchor with 64 of all words of the window.
4. The documents meet the places of their repeated windows and lose the words these cover.

The sketch has ``sketch_bits`` address bits, set from the size of the corpus and at most
``MAX_SKETCH_BITS``: it bounds what is broadcast to two times 32 MB. In a corpus too large for that,
more cells read "repeated" and the exact grouping has more to do, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import SLICE, id_and_text, map_batches, text_key, utf8, written

WINDOW = 35
GRAM = 18
SPAN = WINDOW - GRAM + 1  # runs of GRAM words in a window
MAX_SKETCH_BITS = 28
MIN_SKETCH_BITS = 20
CHUNK_BITS = 16
DEPTH = 2
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _P2
    x = (x ^ (x >> np.uint64(32))) * _P3
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of every run of ``length`` words, by doubling."""
    level, covered, runs = _mix(words + np.uint64(salt)), 1, None
    have, need = 0, length
    while need:
        if need & 1:
            n = len(words) - (have + covered) + 1
            part = level[have : have + n]
            runs = part if runs is None else _mix(runs[:n] * _P1 + part)
            have += covered
        need >>= 1
        if need:
            level = _mix(level[: len(level) - covered] * _P1 + level[covered:])
            covered *= 2
    return runs


def _sliding_min_at(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every stretch of ``width``, the leftmost of equals."""
    at = np.arange(len(values))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        covered += step
    return at


class Anchors:
    """The windows of one text: for each block of windows that share an anchor, its hash, the first
    window and their number."""

    def __init__(self, words: list[bytes], hashes: dict[bytes, int]):
        ids = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
        self.words = ids
        grams = _runs(ids, GRAM, 1)
        at = _sliding_min_at(grams, SPAN)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.first = new
        self.count = np.diff(np.concatenate((new, [len(at)])))
        self.anchor = grams[at[new]]
        self.offset = at[new] - new

    def window_keys(self) -> np.ndarray:
        return _runs(self.words, WINDOW, 2)


def _word_hashes(texts: list[list[bytes]]) -> dict[bytes, int]:
    distinct = set().union(*texts) if texts else set()
    return {w: xxhash.xxh64_intdigest(w) for w in distinct}


def _anchored(column: pa.Array) -> Iterator[tuple[int, Anchors | None, int]]:
    words = [t.split() for t in utf8(column)]
    hashes = _word_hashes(words)
    for k, own in enumerate(words):
        yield k, Anchors(own, hashes) if len(own) >= WINDOW else None, len(own)


def cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mix(anchor * _P1 + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketched(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of a task's anchors, with a count of one or two (two stands for more)."""
        found: list[np.ndarray] = []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                found += [a.anchor for _, a, _ in _anchored(batch.column(0).slice(start, SLICE)) if a]
            if sum(map(len, found)) >= 1 << 21:
                yield from _cell_rows(np.concatenate(found), bits)
                found = []
        if found:
            yield from _cell_rows(np.concatenate(found), bits)

    return work


def _cell_rows(anchors: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk of 65,536 cells: cells seen, and those seen twice or more."""
    for row in range(DEPTH):
        seen, count = np.unique(cells(anchors, row, bits), return_counts=True)
        chunk = seen >> CHUNK_BITS
        edges = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True])))
        low = (seen & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
        once, more, names = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part, twice = low[a:b], count[a:b] > 1
            names.append(int(chunk[a]))
            once.append(part[~twice].tobytes())
            more.append(part[twice].tobytes())
        columns = [pa.array([row] * len(names), pa.int32()), pa.array(names, pa.int32())]
        columns += [pa.array(once, pa.binary()), pa.array(more, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "chunk", "once", "more"])


def _merge_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by chunk; a bitmap of the cells counted at least twice leaves."""
    key, seen, twice = None, None, None
    out: list[tuple[int, int, bytes]] = []

    def ended() -> None:
        if key is not None and twice.any():
            out.append((*key, np.packbits(twice).tobytes()))

    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for row, chunk, once, more in rows:
            if (row, chunk) != key:
                ended()
                key = (row, chunk)
                seen, twice = np.zeros(1 << CHUNK_BITS, bool), np.zeros(1 << CHUNK_BITS, bool)
            twice[np.frombuffer(more, np.uint16)] = True
            part = np.frombuffer(once, np.uint16)
            twice[part] |= seen[part]
            seen[part] = True
    ended()
    names = ["row", "chunk", "bits"]
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(3)], names)


def sketch(texts: DataFrame, bits: int) -> list[np.ndarray]:
    """Merged sketches of the ``text`` column: for each of ``DEPTH`` rows, a packed bit per cell that
    tells whether its count is at least two. At most 2^``MAX_SKETCH_BITS`` bits a row."""
    parts = texts.select("text").mapInArrow(_sketched(bits), "row int, chunk int, once binary, more binary")
    merged = (
        parts.repartition("row", "chunk").sortWithinPartitions("row", "chunk")
        .mapInArrow(_merge_chunks, "row int, chunk int, bits binary")
    )
    width = (1 << CHUNK_BITS) // 8
    rows = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(DEPTH)]
    for found in merged.collect():
        at = found.chunk * width
        rows[found.row][at : at + width] = np.frombuffer(found.bits, np.uint8)
    return rows


def sketch_bits(texts: DataFrame) -> int:
    """Address bits for about eight cells an anchor; anchors are about one in sixty bytes of text."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = int(np.ceil(np.log2(max(1, size / 60 * 8))))
    return max(MIN_SKETCH_BITS, min(MAX_SKETCH_BITS, wanted))


def _suspects(sent, bits: int):
    """Blocks whose anchor is estimated to repeat, with hashes of their words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = sent.value
        out: list[list] = [[] for _ in range(4)]
        for k, a, _ in _anchored(batch.column(2)):
            if a is None:
                continue
            repeated = np.ones(len(a.anchor), bool)
            for row, bitmap in enumerate(rows):
                cell = cells(a.anchor, row, bits)
                repeated &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(repeated)
            if not at.size:
                continue
            own = a.window_keys()
            first, count = a.first[at], a.count[at]
            keys = [own[f : f + c].tobytes() for f, c in zip(first.tolist(), count.tolist())]
            for column, values in zip(out, ([k] * len(at), a.anchor[at], first, keys)):
                column.extend(values)
        rows_of = pa.array(out[0], pa.int64())
        anchors = pa.array(np.array(out[1], np.uint64).view(np.int64))
        columns = [batch.column(0).take(rows_of), batch.column(1).take(rows_of), anchors]
        columns += [pa.array(np.array(out[2], np.int32)), pa.array(out[3], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "anchor", "first", "keys"])

    return work


def _explode_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for every window of a block: its key and its place in the block."""
    keys = [np.frombuffer(k, np.int64) for k in batch.column(2).to_pylist()]
    sizes = [len(k) for k in keys]
    at = pa.array(np.repeat(np.arange(len(keys)), sizes))
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(n) for n in sizes]) if keys else np.zeros(0)
    columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32))]
    columns += [pa.array(flat), batch.column(3).take(at)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "block", "place", "window", "n"])


def repeated_windows(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(id_key, tkey, starts): of each document its blocks with repeated windows, as pairs of the
    block's first window and the mask of those that repeat."""
    bits = bits or sketch_bits(docs)
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    suspects = written(
        map_batches(
            docs.select("doc_id", "tkey", "text"), _suspects(sent, bits),
            f"doc_id {kind}, tkey long, anchor long, first int, keys binary",
        ),
        "suspects",
    )
    # A block is shorter than a window, so equal keys mean that all words of its windows are equal.
    counted = suspects.groupBy("anchor", "keys").agg(F.count("*").alias("n"))
    blocks = written(counted.select("anchor", F.xxhash64("keys").alias("block"), "keys", "n"), "blocks")
    # Anchors with one block only: repeated as a whole, or not at all.
    several = blocks.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor")
    every = F.expr("shiftleft(1, int(octet_length(keys) / 8)) - 1")
    whole = blocks.where("n > 1").select("anchor", "block", every.alias("mask"))
    mixed = map_batches(
        blocks.join(several, "anchor", "left_semi").select("anchor", "block", "keys", "n"), _explode_keys,
        "anchor long, block long, place int, window long, n long",
    )
    again = mixed.groupBy("anchor", "window").agg(F.sum("n").alias("total")).where("total > 1")
    parts = (
        mixed.where("n = 1").join(again, ["anchor", "window"])
        .groupBy("anchor", "block").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("mask"))
    )
    masks = whole.unionByName(parts)
    found = suspects.select("doc_id", "tkey", "anchor", F.xxhash64("keys").alias("block"), "first")
    return found.join(masks, ["anchor", "block"]).groupBy(F.xxhash64("doc_id").alias("id_key"), "tkey").agg(
        F.collect_set(F.struct("first", "mask")).alias("starts")
    )


def _kept_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    removed, kept = [], []
    n_words = []
    for text, starts in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
        words = text.split()
        edge = np.zeros(len(words) + WINDOW + SPAN + 1, np.int64)
        for s in starts or []:
            for place in range(SPAN):
                if s["mask"] >> place & 1:
                    edge[min(s["first"] + place, len(words))] += 1
                    edge[min(s["first"] + place + WINDOW, len(words))] -= 1
        stay = np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)
        n_words.append(len(words))
        removed.append(len(words) - len(stay))
        kept.append(b" ".join([words[i] for i in stay.tolist()]).decode())
    columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of ``docs``.

    A word goes if a window that covers it occurs anywhere else, in the same text or another, all
    judged on the input; so every occurrence goes. Null and empty texts have no words. Repeated rows
    are documents of their own. No rows give no rows; other columns are not looked at."""
    rows = id_and_text(docs, id_col, text_col).withColumn("tkey", text_key(F.col("text")))
    starts = repeated_windows(rows, bits)
    keyed = rows.withColumn("id_key", F.xxhash64("doc_id"))
    joined = keyed.join(starts, ["id_key", "tkey"], "left").select("doc_id", "text", "starts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(joined, _kept_words, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
