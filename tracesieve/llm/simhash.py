"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint of 64 bits is a ring of four segments of 16 bits. If two fingerprints differ in at
most three bits, some segment starts a chain round the ring whose cumulative differences stay
within the proportional budgets 0, 1, 2, 3 (l * 3 / 4 for l segments). So that segment is equal,
and of the next one at least one half is equal: both together are the 24 bits fingerprints meet
by. Within such a bucket a pair is dropped as soon as its chain leaves the budget; what is left
gets the full Hamming check. Links leave a bucket as a spanning forest, never as all pairs, and a
pair that is connected already is not compared.

Exact copies share a fingerprint and are one node. Buckets of more than ``block`` fingerprints are
cut into blocks, and every two blocks meet in a task of their own, so no task holds more than two
blocks, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.common import free_name, id_and_text, map_batches, stored, text_key, utf8
from tracesieve.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
BUDGETS = [(length * MAX_BITS) // SEGMENTS for length in range(1, SEGMENTS + 1)]
BLOCK = 16_384
# Shingles whose bits are counted at once; bounds the memory a very long text takes.
CHUNK = 1 << 17


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, shingles of three words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp): the fingerprint as a signed long, and a key of the text that tells rows
    with equal ids apart. Null and empty texts have fingerprint 0."""
    rows = id_and_text(docs, id_col, text_col).withColumn("tkey", text_key(F.col("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t) for t in utf8(batch.column(1))], np.uint64)
        columns = [batch.column(0), batch.column(2), pa.array(values.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "fp"])

    return map_batches(rows, work, f"doc_id {kind}, tkey long, fp long")


def _bucket_keys() -> list:
    """Eight keys: segment i whole, with the upper or lower half of the segment after it."""
    keys = []
    for i in range(SEGMENTS):
        here = F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND((1 << WIDTH) - 1)
        following = F.shiftrightunsigned("fp", WIDTH * ((i + 1) % SEGMENTS))
        for half in (0, 1):
            part = F.shiftrightunsigned(following, half * WIDTH // 2).bitwiseAND((1 << WIDTH // 2) - 1)
            tag = F.lit((i * 2 + half) << (WIDTH + WIDTH // 2))
            keys.append(tag + F.shiftleft(part.cast("bigint"), WIDTH) + here)
    return keys


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        above = parent[root]
        if (above == root).all():
            return root
        root = above


def link_runs(run: np.ndarray, segment: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside runs of equal ``run``: two arrays of fingerprints."""
    n = len(fp)
    parent = np.arange(n)
    low = np.uint64((1 << WIDTH) - 1)
    at, distance = np.arange(max(0, n - 1)), 1
    at = at[run[at] == run[at + 1]] if n > 1 else at
    while at.size:
        mine, other = _roots(parent, at), _roots(parent, at + distance)
        apart = np.flatnonzero(mine != other)
        a, b = at[apart], at[apart] + distance
        differ = fp[a] ^ fp[b]
        inside = np.arange(a.size)
        total = np.zeros(a.size, np.int64)
        for step, budget in enumerate(BUDGETS):
            shift = ((segment[a[inside]] + step) % SEGMENTS * WIDTH).astype(np.uint64)
            total = total[: inside.size] + np.bitwise_count((differ[inside] >> shift) & low)
            viable = total <= budget
            inside, total = inside[viable], total[viable]
        linked = inside[np.bitwise_count(differ[inside]) <= MAX_BITS]
        for x, y in zip(a[linked].tolist(), b[linked].tolist()):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
        distance += 1
        at = at[at + distance < n]
        at = at[run[at] == run[at + distance]]
    child = np.flatnonzero(parent != np.arange(n))
    return fp[child], fp[_roots(parent, child)] if child.size else fp[child]


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs arrive sorted; the last one of a batch waits for the next batch."""
    kept = None
    for batch in batches:
        table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if kept is not None:
            table = [np.concatenate(pair) for pair in zip(kept, table)]
        key, lo, hi, fp = table
        if not len(key):
            continue
        last = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])
        kept = [c[last] for c in table]
        yield _links(*[c[~last] for c in table])
    if kept is not None:
        yield _links(*kept)


def _links(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    new = np.ones(len(key), bool)
    if len(key):
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    segment = key >> (WIDTH + WIDTH // 2 + 1)
    u, v = link_runs(np.cumsum(new), segment, fp.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def fingerprint_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all distinct ``fp`` within three bits, transitively."""
    keyed = nodes.select("fp", F.explode(F.array(*_bucket_keys())).alias("key"))
    hot = (
        keyed.groupBy("key")
        .count()
        .where(F.col("count") > block)
        .select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    )
    n = F.coalesce("n", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    pairs = (
        keyed.join(hot, "key", "left")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    runs = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return runs.mapInArrow(_link_partition, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints, and (fp, component, first): the row that stands for each group."""
    prints = stored(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    nodes = stored(prints.groupBy("fp").agg(first.alias("first")))
    labels = connected_components(fingerprint_links(nodes.select("fp"), block))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    return prints, labelled


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest id reachable over links of at most three differing bits. Texts
    without words have fingerprint zero and link like any other. Repeated rows get a row each. A
    null id is never the smallest; a component of null ids only has a null component_id. No
    rows give no rows; other columns are not looked at.
    """
    prints, labelled = _grouped(docs, id_col, text_col, block)
    smallest = labelled.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    classes = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    All columns stay. A null id counts as larger than any other; among equal ids the text's key
    decides, and of wholly equal rows one stays."""
    _, labelled = _grouped(docs, id_col, text_col, BLOCK)
    standing = labelled.groupBy("component").agg(F.min("first").alias("first"))
    id_key, key, turn = (free_name(docs, n) for n in ("id_key", "tkey", "turn"))
    keepers = standing.select(F.xxhash64("first.doc_id").alias(id_key), F.col("first.tkey").alias(key))
    keyed = docs.withColumns({id_key: F.xxhash64(id_col), key: text_key(F.col(text_col).cast("string"))})
    # The join leaves equal keys together and sorted, so numbering them moves nothing again.
    once = Window.partitionBy(id_key, key).orderBy(id_key, key)
    return (
        keyed.join(keepers, [id_key, key], "left_semi")
        .withColumn(turn, F.row_number().over(once))
        .where(F.col(turn) == 1)
        .drop(id_key, key, turn)
    )
