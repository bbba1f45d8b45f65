"""Which of any number of literal secrets occur in which text, without trying every pair.

Every secret is known by a hash of its first bytes (its *anchor*). Tasks hold two bitmaps only (16 MB
each at most). Texts are scanned once, an Arrow buffer at a time: the hash of every window is probed
against a bitmap of the anchors, and what that lets through joins the secrets by hash. The caller
checks each candidate against the text, so the answer is exact whatever the hashes do.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.text import once
from tracesieve.operators.automaton import row_offsets
from tracesieve.operators.joins import cut_lineage, salted_join

# The helpers below travel to the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Window lengths in bytes. A secret uses the longest one that fits in it.
WIDTHS = (3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64)

MAX_BITMAP_BITS = 1 << 27
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93


def window_hashes(data: np.ndarray, widths) -> dict[int, np.ndarray]:
    """Hash of every window of each width; polynomial in wrapping 64-bit arithmetic."""
    sums, scale = {1: data.astype(np.uint64) + np.uint64(1)}, {1: _BASE}
    size = 1
    while size * 2 <= min(max(widths), len(data)):
        h = sums[size]
        sums[size * 2] = h[:-size] * np.uint64(scale[size]) + h[size:]
        scale[size * 2] = scale[size] * scale[size] % (1 << 64)
        size *= 2
    out = {}
    for width in widths:
        n = len(data) - width + 1
        if n <= 0:
            continue
        total, at = np.zeros(n, dtype=np.uint64), 0
        for bit in reversed(range(width.bit_length())):
            part = 1 << bit
            if width & part:
                total = total * np.uint64(scale[part]) + sums[part][at : at + n]
                at += part
        mixed = (total ^ np.uint64(width)) * np.uint64(_MIX)
        out[width] = mixed ^ (mixed >> np.uint64(29))
    return out


def width_of(size: int) -> int:
    return max(w for w in WIDTHS if w <= size)


def anchor(raw: bytes) -> tuple[int, np.uint64]:
    width = width_of(len(raw))
    head = np.frombuffer(raw[:width], dtype=np.uint8)
    return width, window_hashes(head, (width,))[width][0]


def make_bitmap(anchors: np.ndarray, bits: int) -> np.ndarray:
    slots = anchors >> np.uint64(64 - (bits.bit_length() - 1))
    table = np.zeros(bits // 32, dtype=np.uint32)
    np.bitwise_or.at(
        table,
        (slots >> np.uint64(5)).astype(np.int64),
        np.uint32(1) << (slots & np.uint64(31)).astype(np.uint32),
    )
    return table


def bitmap_bits(n: int) -> int:
    bits = 1 << 16
    while bits < min(n * 32, MAX_BITMAP_BITS):
        bits *= 2
    return bits


def row_ends(texts: pa.Array) -> list[int]:
    return row_offsets(texts)[1:].tolist()


def probable_places(texts: pa.Array, table: np.ndarray, widths):
    """Yield ``(rows, places, width, hashes)`` of windows whose anchor is in the bitmap.

    Works on the Arrow buffer itself, a slice at a time, so that memory stays bounded even
    for very long texts. ``places`` are byte offsets into the buffer.
    """
    if texts.buffers()[2] is None or len(texts) == 0:
        return
    offsets = row_offsets(texts)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    shift = np.uint64(64 - ((len(table) * 32).bit_length() - 1))
    overlap = max(widths) - 1
    for start in range(offsets[0], offsets[-1], SLICE_BYTES):
        stop = min(start + SLICE_BYTES, offsets[-1])
        piece = data[start : min(stop + overlap, offsets[-1])]
        for width, hashes in window_hashes(piece, widths).items():
            hashes = hashes[: stop - start]
            slots = hashes >> shift
            words = table[(slots >> np.uint64(5)).astype(np.int64)]
            hit = np.flatnonzero((words >> (slots & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
            places = hit + start
            rows = np.searchsorted(offsets, places, side="right") - 1
            inside = places + width <= offsets[rows + 1]
            yield rows[inside], places[inside], width, hashes[hit[inside]]


def full_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def literal_candidates(
    df: DataFrame, text: str, secrets: DataFrame, keys: list[str], out: str
) -> DataFrame:
    """``keys`` plus the array of secrets that occur in the text (hash for hash); keys
    without any are left out.

    A probable place is taken further in the task: the bytes there, at every length that
    secrets with such an anchor have, are hashed whole, and only whole hashes that a second
    bitmap knows are joined. So secrets that share a long beginning do not multiply, and the
    array of a text is no longer than what occurs in it.
    """

    @F.arrow_udf("struct<width:int,size:int,anchor:bigint,whole:bigint>")
    def hashes_udf(values: pa.Array) -> pa.Array:
        raws = [v.encode("utf-8") for v in values.to_pylist()]
        pairs = [anchor(raw) for raw in raws]
        columns = {
            "width": pa.array([w for w, _ in pairs], pa.int32()),
            "size": pa.array([len(raw) for raw in raws], pa.int32()),
            "anchor": pa.array(np.array([h for _, h in pairs], dtype=np.uint64).astype(np.int64)),
            "whole": pa.array([full_hash(raw) for raw in raws], pa.int64()),
        }
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    hashed = secrets.select("value", "replacement", hashes_udf("value").alias("h"))
    hashed = cut_lineage(hashed.select("value", "replacement", "h.*"))
    sizes: dict[int, list[int]] = {}
    for row in hashed.select("width", "size").distinct().collect():
        sizes.setdefault(row["width"], []).append(row["size"])
    count = hashed.count()
    anchors = _distributed_bitmap(hashed, "anchor", count)
    wholes = _distributed_bitmap(hashed, "whole", count)
    shared = df.sparkSession.sparkContext.broadcast((anchors, wholes, sizes))

    @F.arrow_udf("array<bigint>")
    def probe(texts: pa.Array) -> pa.Array:
        anchors, wholes, sizes = shared.value
        shift = 64 - ((len(wholes) * 32).bit_length() - 1)
        found: list[set[int]] = [set() for _ in range(len(texts))]
        data = texts.buffers()[2]
        ends = row_ends(texts)
        for rows, places, width, _ in probable_places(texts, anchors, sorted(sizes)):
            for row, place in zip(rows.tolist(), places.tolist()):
                for size in sizes[width]:
                    if place + size <= ends[row]:
                        h = full_hash(data[place : place + size].to_pybytes())
                        slot = (h % (1 << 64)) >> shift
                        if int(wholes[slot >> 5]) >> (slot & 31) & 1:
                            found[row].add(h)
        return pa.array([list(f) for f in found], pa.list_(pa.int64()))

    seen = df.select(*keys, once(probe(F.col(text))).alias("_wholes")).select(
        *keys, F.explode("_wholes").alias("whole")
    )
    known = hashed.select("value", "replacement", "whole")
    pairs = salted_join(seen, known, ["whole"], spread=keys, how="inner")
    return pairs.groupBy(*keys).agg(F.collect_list(F.struct("value", "replacement")).alias(out))


def _distributed_bitmap(hashed: DataFrame, column: str, count: int) -> np.ndarray:
    """Bitmap of a hash column as 32-bit words OR-ed together by Spark. Set words only reach
    the driver: 4 million at most, whatever the number of secrets."""
    bits = bitmap_bits(count)
    slot = F.shiftrightunsigned(column, 64 - (bits.bit_length() - 1))
    words = (
        hashed.select(
            F.shiftright(slot, 5).alias("word"),
            F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(31).cast("int")
            ).alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[words["word"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return table
