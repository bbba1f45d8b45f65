"""Exact membership tests for key sets that are too many to broadcast.

:func:`keep_keys` tests a Bloom filter of the keys where the rows are read, so that only those that
nearly all stay are joined. :func:`keep_known` shuffles no row at all, where every key that can come is
known: a cascade of Bloom filters: the first is made of the keys to keep, the second of those other keys that
pass the first by mistake, and so on, until the mistakes are few enough to be broadcast as they are.
Ten bits a key travel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.operators.joins import BROADCAST_ROWS, cut_lineage, fits_broadcast

BITS_PER_KEY = 10
PROBES = 7
# A filter takes 64 MB at most, enough for 50 million keys.
MAX_BITS = 1 << 29
LEVELS = 4
SEGMENT_BITS = 12
SEGMENT = 1 << SEGMENT_BITS


@dataclass(frozen=True)
class KeyFilter:
    """A Bloom filter in segments of ``SEGMENT`` words: (segment, part). A key has all its bits in one."""

    segments: DataFrame
    n: int


def _segment(on: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), *on), F.lit(n))


def _bit(on: list[str], probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), *on), F.lit(64 * SEGMENT))


def key_filter(keys: DataFrame, on: list[str], count: int) -> KeyFilter:
    """The filter of ``count`` keys, made and kept by Spark; nothing of it passes through the driver."""
    n = 1
    while n * 64 * SEGMENT < count * BITS_PER_KEY:
        n *= 2
    first = _segment(on, n) * SEGMENT
    bits = keys.select(first.alias("first"), F.explode(F.array(*[_bit(on, k) for k in range(PROBES)])).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))
    words = bits.groupBy((F.col("first") + F.shiftright("bit", 6)).alias("id")).agg(F.bit_or(mask).alias("word"))
    every = keys.sparkSession.range(n * SEGMENT).join(words, "id", "left")
    entry = F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))
    parts = every.groupBy(F.expr(f"id div {SEGMENT}").alias("_segment")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["word"]).alias("_part")
    )
    return KeyFilter(cut_lineage(parts), n)


def _tested(wide: DataFrame, own: KeyFilter, on: list[str], how: str) -> DataFrame:
    """Join of each row with its segment, if that has all bits of its key. Filters are of a bounded size."""
    part, hit = F.col("_part"), _segment(on, own.n) == F.col("_segment")
    for k in range(PROBES):
        word = F.get(part, F.shiftright(_bit(on, k), 6).cast("int"))
        hit &= F.bit_get(word, _bit(on, k).bitwiseAND(63).cast("int")) == 1
    return wide.join(F.broadcast(own.segments), hit, how)


def keep_keys(wide: DataFrame, keys: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``wide`` whose key is in ``keys``.

    Few keys are broadcast. Of many, a filter is tested where the rows are read, and only the rows that
    pass, about those that stay, are shuffled to meet the keys.
    """
    keys = keys.select(*on)
    if fits_broadcast(keys, max_rows):
        return wide.join(F.broadcast(keys), on, "left_semi")
    count = keys.count()
    if count * BITS_PER_KEY <= MAX_BITS:
        wide = _tested(wide, key_filter(keys, on, count), on, "left_semi")
    return wide.join(keys, on, "left_semi")


def keep_known(
    wide: DataFrame, members: DataFrame, others: DataFrame, on: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of ``wide`` whose key is in ``members``. Every key of ``wide`` is in ``members`` or in ``others``.

    Few members, or few others, are broadcast. Else the cascade decides; only beyond what a filter holds
    the rows are joined by key, with all they carry.
    """
    inside, outside = members.select(*on).distinct(), others.select(*on).distinct()
    if fits_broadcast(inside, max_rows):
        return wide.join(F.broadcast(inside), on, "left_semi")
    if fits_broadcast(outside, max_rows):
        return wide.join(F.broadcast(outside), on, "left_anti")
    filters: list[KeyFilter] = []
    while len(filters) < LEVELS:
        count = inside.count()
        if count * BITS_PER_KEY > MAX_BITS:
            break
        filters.append(key_filter(inside, on, count))
        inside, outside = cut_lineage(_tested(outside, filters[-1], on, "left_semi")), inside
        if fits_broadcast(inside, max_rows):
            return _decided(wide, filters, inside, on)
    return keep_keys(wide, members, on, max_rows)


def _decided(wide: DataFrame, filters: list[KeyFilter], last: DataFrame, on: list[str]) -> DataFrame:
    """A key is in a set of the cascade if its filter has it and the next set, which holds the mistakes,
    has not. The last set is there itself."""
    flagged = wide.join(F.broadcast(last.withColumn("_last", F.lit(True))), on, "left")
    for k, own in enumerate(filters):
        tested = _tested(flagged, own, on, "left").withColumn(f"_in{k}", F.col("_segment").isNotNull())
        flagged = tested.drop("_segment", "_part")
    inside = F.col("_last").isNotNull()
    for k in reversed(range(len(filters))):
        inside = F.col(f"_in{k}") & ~inside
    return flagged.where(inside).select(*wide.columns)
