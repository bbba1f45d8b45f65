"""Search in a store of sessions that opens the files only that can hold a match.

The index has the trigrams, three bytes of UTF-8 with ASCII letters in lower case, that occur in each
Parquet file of the store. A pattern is asked for the texts that every match must contain; files without
their trigrams are not opened, and files written since the index was made always are. Patterns without
such a text, and those in a syntax that is not understood, open everything. Results are those of a scan.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.functions.patterns import matches_any
from tracesieve.operators.joins import path_exists
from tracesieve.operators.rules import KEY, drop_rejected

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parts of the index table, by trigram.
BUCKETS = 64
# Alternatives of a pattern that are told apart; a pattern with more is searched everywhere.
ALTERNATIVES = 32

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
# Escapes that mean one thing to Python's parser and another to Spark's.
_AMBIGUOUS = re.compile(r"\\[0-9vZGXhHRkKQEN]|\(\?[a-zA-Z]*[xduU]|\[[^\]]*\[|&&")


# The two ways to name a local file that Spark has.
LOCAL = "^file:/+"


def _plain(path: str) -> str:
    return re.sub(LOCAL, "/", path)


def trigrams(data: bytes) -> np.ndarray:
    """Distinct trigrams of a text, as numbers."""
    codes = _FOLD[np.frombuffer(data, np.uint8)]
    if len(codes) < 3:
        return np.zeros(0, np.int32)
    return np.unique(codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]).astype(np.int32)


def build_index(spark: SparkSession, store: str, index: str, content: str = "content") -> None:
    """Index the files of ``store`` that the index at ``index`` does not have yet."""
    known = _indexed(spark, index)
    file = F.regexp_replace(F.col("_metadata.file_path"), LOCAL, "/").alias("file")
    texts = spark.read.parquet(store).select(file, content)
    texts = texts.where(~F.col("file").isin(sorted(known))) if known else texts

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            found: dict[str, list[np.ndarray]] = {}
            for file, text in zip(files, batch.column(1).cast(pa.binary()).to_pylist()):
                found.setdefault(file, []).append(trigrams(text or b""))
            for file, parts in found.items():
                own = np.unique(np.concatenate(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(own), pa.string()), pa.array(own)], ["file", "trigram"])

    rows = texts.mapInArrow(listed, "file string, trigram int").distinct()
    table = rows.withColumn("bucket", F.pmod("trigram", F.lit(BUCKETS))).repartition("bucket").sortWithinPartitions("trigram")
    table.write.mode("append").partitionBy("bucket").parquet(f"{index}/trigrams")
    # A file counts as indexed once its trigrams are there; one with no text at all is in this list only.
    texts.select("file").distinct().write.mode("append").parquet(f"{index}/files")


def _indexed(spark: SparkSession, index: str) -> set[str]:
    """Files of the index. Spark's own listing of the store holds as many names on the driver."""
    if not path_exists(spark, f"{index}/files"):
        return set()
    return {r["file"] for r in spark.read.parquet(f"{index}/files").distinct().toLocalIterator()}


def required_texts(pattern: str, ignore_case: bool = False) -> list[list[bytes]] | None:
    """Alternatives, each a list of texts that a match must contain; None if nothing is known."""
    from re import _constants as kinds
    from re import _parser as parser

    if _AMBIGUOUS.search(pattern):
        return None
    try:
        tree = parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    except (re.error, OverflowError, RecursionError):
        return None

    def of(items, folded: bool) -> list[list[bytes]]:
        """Every alternative of a sequence; an empty list in it stands for no requirement."""
        out: list[list[bytes]] = [[]]
        run: list[str] = []

        def close() -> None:
            # Beyond ASCII, letters have other cases than the index folds.
            parts = re.split("[^\\x00-\\x7f]", "".join(run)) if folded else ["".join(run)]
            for alternative in out:
                alternative += [p.encode("utf-8", "surrogatepass") for p in parts]
            run.clear()

        for kind, value in items:
            if kind is kinds.LITERAL:
                run.append(chr(value))
                continue
            if kind is kinds.AT:
                continue
            close()
            inner = None
            if kind is kinds.SUBPATTERN:
                _, add, remove, body = value
                inner = of(body, (folded or bool(add & re.IGNORECASE)) and not remove & re.IGNORECASE)
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] >= 1:
                inner = of(value[2], folded)
            elif kind is kinds.ATOMIC_GROUP:
                inner = of(value, folded)
            elif kind is kinds.BRANCH:
                inner = [alternative for body in value[1] for alternative in of(body, folded)]
            if inner:
                if len(out) * len(inner) > ALTERNATIVES:
                    continue  # too many to tell apart: this part asks for nothing
                out = [[*a, *b] for a in out for b in inner]
        close()
        return out

    found = [[t for t in alternative if len(t) >= 3] for alternative in of(tree, bool(tree.state.flags & re.IGNORECASE))]
    return found if all(found) else None


def candidate_files(spark: SparkSession, store: str, index: str, patterns: Iterable[str], ignore_case: bool = False) -> list[str]:
    """Files of the store that can hold a match of any pattern."""
    every = spark.read.parquet(store).inputFiles()
    indexed = _indexed(spark, index)
    fresh = [f for f in every if _plain(f) not in indexed]
    wanted: list[list[int]] = []
    for pattern in patterns:
        texts = required_texts(pattern, ignore_case)
        if texts is None:
            return every
        wanted += [sorted({t for text in alternative for t in trigrams(text).tolist()}) for alternative in texts]
    if not indexed or not wanted:
        return every if wanted else fresh
    asked = sorted({t for own in wanted for t in own})
    table = spark.read.parquet(f"{index}/trigrams").where(F.col("bucket").isin(sorted({t % BUCKETS for t in asked})) & F.col("trigram").isin(asked))
    held = table.groupBy("file").agg(F.collect_set("trigram").alias("held"))  # as many as are asked for
    fits = F.lit(False)
    for own in wanted:
        fits |= F.size(F.array_except(F.array(*map(F.lit, own)), "held")) == 0
    hits = {r["file"] for r in held.where(fits).select("file").toLocalIterator()}
    return fresh + [f for f in every if _plain(f) in hits]


def grep_store(
    spark: SparkSession, store: str, index: str, reject: DataFrame, patterns: str | Iterable[str],
    ignore_case: bool = False, content: str = "content",
) -> DataFrame:
    """Sessions of the store that may be published and whose newest copy matches a pattern: what
    :func:`~tracesieve.operators.rules.grep_sessions` finds, from candidate files only."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    rows = spark.read.parquet(store)
    files = candidate_files(spark, store, index, patterns, ignore_case)
    if not files:
        return drop_rejected(rows.select(*KEY).limit(0), reject)
    searched = [f"(?i){p}" if ignore_case else p for p in patterns]
    hits = spark.read.option("basePath", store).parquet(*map(unquote, files)).where(matches_any(F.col(content), searched))
    if "created_at" in rows.columns:
        newest = rows.groupBy(*KEY).agg(F.max("created_at").alias("created_at"))
        hits = hits.select(*KEY, "created_at").join(newest, [*KEY, "created_at"], "left_semi")
    return drop_rejected(hits.select(*KEY).distinct(), reject)
