"""Arrow functions that work on one MB of text at a time.

Spark hands over as many rows as its setting says, however long their texts are. What a function makes
of them, Python objects and results, should not be of that size: a batch is cut by the bytes of its texts,
and each piece's result is handed back before the next one is begun. A batch is let go before the next
one is asked for, and Spark is told to hand over batches of that size as well.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(texts: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """(first row, rows) of the pieces of a batch: as many rows as start within ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks = (np.cumsum(sizes) - sizes) // most
    first = np.flatnonzero(np.diff(blocks, prepend=-1))
    return list(zip(first.tolist(), np.diff(first, append=len(texts)).tolist()))


def give_back() -> None:
    """What was freed goes back to the system; Arrow's pool would keep it beside the next batch."""
    pa.default_memory_pool().release_unused()


def small_batches() -> None:
    """Arrow batches of this session are of ``SLICE_BYTES`` at most, or of less where that is set; a batch
    holds one row at least. It stays set, as Spark reads it when a query runs."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(BATCH_BYTES).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit[:1] or "b") > SLICE_BYTES:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))


def sliced(function: Callable[..., pa.Array], returns: str) -> Callable:
    """The Spark function of one that maps arrays to an array; the first array has the texts."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for first, rows in cut(texts):
                yield function(texts.slice(first, rows))
            del texts
            give_back()

    small_batches()
    return F.arrow_udf(one, returns)


def sliced_pairs(function: Callable[..., pa.Array], returns: str) -> Callable:
    """:func:`sliced` for two arrays."""

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, others in batches:
            for first, rows in cut(texts):
                yield function(texts.slice(first, rows), others.slice(first, rows))
            del texts, others
            give_back()

    small_batches()
    return F.arrow_udf(two, returns)
