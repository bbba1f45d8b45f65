"""Token ids in Simple-8b blocks.

A 64-bit word holds a selector in its upper four bits and, in the other 60, as many ids as fit at
the selector's width. An id wider than 30 bits takes a word of its own (the escape). A block holds
the ids of whole documents, about ``BLOCK_IDS`` of them:

    header   magic "S8B1", number of words, of ids, of documents (little-endian unsigned 32-bit)
    offsets  for each document the ids of the block before it, and their total
    words    little-endian unsigned 64-bit

Decoding is vectorised: all words of one selector are unpacked together and put to their places.
Blocks are rows of a Parquet table, in ascending order of documents; ``part`` numbers the ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.common import SLICE, id_and_text, new_table_path
from tracesieve.llm.tokens import encoder

BLOCK_IDS = 1 << 16
MAGIC = np.frombuffer(b"S8B1", "<u4")[0]
#: selector: (ids in a word, bits of each). Selector 0 is the escape.
SELECTORS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]


def pack_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of ids below 2^60. Each word takes as many of the next ids as any selector can."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8")
    wide = ids.astype(np.uint64)
    if (wide >> np.uint64(60)).any():
        raise ValueError("ids of 60 bits at most can be stored")
    choice = np.zeros(n, np.int8)
    # The largest of the next ``covered`` ids, shorter at the end; ids beyond 30 bits fit none but the escape.
    top = np.minimum(wide, np.uint64(1 << 31)).astype(np.uint32)
    covered = 1
    for selector, (count, bits) in enumerate(SELECTORS[1:], 1):
        while covered < count:
            step = min(covered, count - covered)
            if step < n:
                np.maximum(top[: n - step], top[step:], out=top[: n - step])
            covered += step
        fits = top < np.uint32(1 << bits)
        fits[max(0, n - count + 1) :] = False
        if not fits.any():
            break  # the next selectors cover more ids with fewer bits each
        choice[fits] = selector
    counts = np.array([c for c, _ in SELECTORS])
    following = (np.arange(n) + counts[choice]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = following[at]
    begin = np.array(starts)
    chosen = choice[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SELECTORS):
        where = np.flatnonzero(chosen == selector)
        if where.size:
            shifts = (np.arange(count) * bits).astype(np.uint64)
            words[where] |= np.bitwise_or.reduce(wide[begin[where][:, None] + np.arange(count)] << shifts, axis=1)
    return words.astype("<u8")


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selectors]
    begin = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, bits) in enumerate(SELECTORS):
        where = np.flatnonzero(selectors == selector)
        if where.size:
            shifts = (np.arange(count) * bits).astype(np.uint64)
            values = (words[where][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            ids[begin[where][:, None] + np.arange(count)] = values
    if len(ids) != n:
        raise ValueError("block is damaged: its words do not hold the ids its header names")
    return ids


def pack_block(documents: list[np.ndarray]) -> bytes:
    sizes = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
    words = pack_words(ids)
    header = np.array([MAGIC, len(words), len(ids), len(documents)], "<u4")
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u4")
    return header.tobytes() + offsets.tobytes() + words.tobytes()


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids)"""
    magic, n_words, n_ids, n_docs = np.frombuffer(block, "<u4", 4)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    offsets = np.frombuffer(block, "<u4", n_docs + 1, 16)
    words = np.frombuffer(block[16 + 4 * (int(n_docs) + 1) :], "<u8", n_words)
    return offsets.astype(np.int64), unpack_words(words, int(n_ids))


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int, byte_level: bool,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every text, append ``end_id``, and write blocks in ascending order of ids to ``path``.

    Null ids come first; the order of rows of equal id is not fixed, so that any number of them are spread
    over ranges; null texts are empty."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    ordered = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, number = TaskContext.get().partitionId(), 0, 0
        names: list = []
        waiting: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            columns = [pa.array([part]), pa.array([number]), pa.array([before]), pa.array([size])]
            columns += [pa.array([names], pa.list_(id_type)), pa.array([pack_block(waiting)])]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "before", "n_ids", "doc_ids", "payload"])

        encode = encoder(tokenizer, byte_level).encode
        for batch in batches:
            id_type = batch.schema.field(0).type
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc, ids in zip(piece.column(0).to_pylist(), encode(texts)):
                    own = np.frombuffer(ids + end, "<u4")
                    if size and size + len(own) > BLOCK_IDS:
                        yield block()
                        before, number, size = before + size, number + 1, 0
                        names, waiting = [], []
                    names.append(doc)
                    waiting.append(own)
                    size += len(own)
        if size:
            yield block()

    schema = f"part long, block long, before long, n_ids long, doc_ids array<{kind}>, payload binary"
    ordered.mapInArrow(encoded, schema).write.parquet(path)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids): decoded blocks; ``start`` counts the ids of all documents before."""

    def decoded(block: bytes) -> Iterator[tuple[int, np.ndarray]]:
        offsets, ids = unpack_block(block)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield a, ids[a:b]

    return _decoded(blocks, lambda ids: ids.tolist(), "ids array<long>", decoded)


def token_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded blocks."""

    def decoded(block: bytes) -> Iterator[tuple[int, np.ndarray]]:
        offsets, ids = unpack_block(block)
        small = ids.astype("<u4")
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield a, small[a:b]

    digest = lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
    found = _decoded(blocks, digest, "d struct<n_tokens: long, ids_crc32: long>", decoded)
    return found.select("doc_id", "start", "d.*")


def _decoded(blocks: DataFrame, value, column: str, decode) -> DataFrame:
    # A part's ids before it: one number per part, as many as the writer had tasks.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    shifts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    placed = blocks.join(F.broadcast(shifts), "part").select((F.col("shift") + F.col("before")).alias("start"), "doc_ids", "payload")
    element = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    name, kind = column.split(" ", 1)
    target = {"array<long>": pa.list_(pa.int64())}.get(kind, pa.struct([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column(0)[k].as_py()
                starts, values = [], []
                for at, ids in decode(batch.column(2)[k].as_py()):
                    starts.append(start + at)
                    values.append(value(ids))
                docs = batch.column(1)[k].values if batch.num_rows else None
                columns = [docs, pa.array(starts, pa.int64()), pa.array(values, target)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", name])

    return placed.mapInArrow(work, f"doc_id {element}, start long, {name} {kind}")


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = 1, byte_level: bool = False) -> DataFrame:
    """Write the token blocks of ``docs`` to a new table in the shared folder and open it."""
    spark = docs.sparkSession
    path = new_table_path(spark, "tokens")
    write_tokens(docs, tokenizer, path, end_id, byte_level)
    return spark.read.parquet(path)
