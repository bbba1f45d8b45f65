"""Session files as rows, and their strict parsing."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracesieve.functions.json_tree import parsed
from tracesieve.functions.patterns import matches_any
from tracesieve.functions.text import once
from tracesieve.operators.joins import cut_lineage, sized_join
from tracesieve.sources.lists import path_exists

SESSION_FILES = "*.{json,jsonl}"
# JSON lines beyond this size are read line by line, by as many tasks as the file has splits.
LONG_BYTES = 64 << 20
# A single JSON value is one row; beyond this size neither rows nor Arrow batches hold its copies.
VALUE_BYTES = 1 << 30
SESSION_SCHEMA = (
    "source_dir STRING, filename STRING, content STRING, size BIGINT, modified TIMESTAMP"
)


@dataclass(frozen=True)
class SessionSource:
    sessions: DataFrame
    missing: list[str]


def colon_paths(text: str) -> list[str]:
    """Directories of a colon-separated list, trimmed, with ``~`` expanded."""
    parts = [os.path.expanduser(p.strip()) for p in text.split(":")]
    return [p for p in parts if p]


def source_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:file:(?://)?)?(.*)/[^/]*$", 1).alias("source_dir")


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).alias("filename")


def shape_files(files: DataFrame, *kept: str) -> DataFrame:
    """Session rows from ``binaryFile`` rows."""
    path = F.col("path")
    return files.select(
        *kept,
        source_dir(path),
        filename(path),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def read_sessions(
    spark: SparkSession,
    paths: str | Iterable[str],
    deny_names: Iterable[str] = (),
    max_bytes: int = VALUE_BYTES,
    long_bytes: int = LONG_BYTES,
) -> DataFrame:
    """One row per ``.json`` or ``.jsonl`` file; names starting with a dot or an underscore
    are hidden, as everywhere in Spark. Bytes that are not UTF-8 become U+FFFD.

    ``deny_names`` are constant patterns on the name: files they match are not opened.
    JSON lines over ``long_bytes`` are listed without content: :func:`read_long_lines` has it. So are
    single values over ``max_bytes``, which fail when collected.
    """
    files = _session_files(spark, paths, deny_names)
    row = (F.col("length") <= max_bytes) & ~is_long(F.col("path"), F.col("length"), long_bytes)
    listed = files.where(~row).withColumn("content", F.lit(None).cast("binary"))
    return shape_files(files.where(row).unionByName(listed))


def _session_files(spark: SparkSession, paths: str | Iterable[str], deny_names: Iterable[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("pathGlobFilter", SESSION_FILES).load(paths)
    return _not_denied(files, deny_names)


def _not_denied(files: DataFrame, deny_names: Iterable[str]) -> DataFrame:
    deny_names = list(deny_names)
    return files.where(~matches_any(F.col("_metadata.file_name"), deny_names)) if deny_names else files


def is_long(path: Column, size: Column, long_bytes: int = LONG_BYTES) -> Column:
    """Whether a session file is read line by line."""
    return path.endswith(".jsonl") & (size > long_bytes)


def list_sessions(spark: SparkSession, paths: str | Iterable[str], deny_names: Iterable[str] = ()) -> DataFrame:
    """Session files without opening them: ``path, source_dir, filename, size, modified``."""
    files = _session_files(spark, paths, deny_names)
    shaped = shape_files(files.withColumn("content", F.lit(None).cast("binary")), "path")
    return shaped.drop("content")


def read_long_lines(
    spark: SparkSession, paths: str | Iterable[str], deny_names: Iterable[str] = (), long_bytes: int = LONG_BYTES
) -> DataFrame:
    """The non-blank lines of JSON-lines files over ``long_bytes``: ``source_dir, filename, line_no, line``.

    A file is read in byte ranges, so one of any size is the work of many tasks. Lines are numbered
    from 0: a first reading counts the lines of each range, a second one adds the lines of the ranges
    before. Only those counts are shuffled.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").text(paths)
    large = _not_denied(text.where(F.col("_metadata.file_size") > long_bytes), deny_names)
    ranges = large.where(F.col("value").rlike(r"\S")).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        "value", F.monotonically_increasing_id().alias("_at"),
    )
    counts = cut_lineage(ranges.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines")))
    # One row for each range of a file.
    before = F.sum("_lines").over(Window.partitionBy("_path").orderBy("_start")) - F.col("_lines")
    numbered = sized_join(
        ranges, counts.select("_path", "_start", "_first", before.alias("_before")), ["_path", "_start"], "inner", spread=["_at"]
    )
    path = F.try_url_decode(F.replace("_path", F.lit("+"), F.lit("%2B")))
    return numbered.select(
        source_dir(path), filename(path),
        (F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), F.make_valid_utf8("value").alias("line"),
    )


def read_session_dirs(
    spark: SparkSession, dirs: str | Iterable[str], deny_names: Iterable[str] = ()
) -> SessionSource:
    """Sessions of several directories; those that do not exist are reported, not fatal."""
    dirs = colon_paths(dirs) if isinstance(dirs, str) else list(dirs)
    there, missing = [], []
    for path in dirs:
        (there if path_exists(spark, path) else missing).append(path)
    if not there:
        return SessionSource(spark.createDataFrame([], SESSION_SCHEMA), missing)
    return SessionSource(read_sessions(spark, there, deny_names), missing)


def count_by_dir(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source_dir").agg(F.count("*").alias("sessions"))


def session_variant(content: Column) -> Column:
    """``VARIANT`` of one JSON value, or of JSON lines as ``{"lines": [...]}``; null when the
    text is neither. Blank lines are skipped, one bad line fails the session; what counts as JSON is
    what it is to ``collect``."""
    return F.try_parse_json(parsed(content)["compact"])


def parse_session(sessions: DataFrame, content: str = "content") -> DataFrame:
    """Add ``session`` (VARIANT) and ``ok``."""
    done = sessions.select("*", once(session_variant(F.col(content))).alias("session"))
    return done.withColumn("ok", F.col("session").isNotNull())
