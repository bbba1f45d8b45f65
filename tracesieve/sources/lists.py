"""Small line-based files, manifests and scanner output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.functions.text import once, trimmed
from tracesieve.operators.findings import strict_json
from tracesieve.operators.joins import path_exists as path_exists

MANIFEST_SCHEMA = (
    "source_dir STRING, filename STRING, source_hash STRING, redacted_hash STRING, "
    "redaction_key STRING, size_bytes BIGINT, created_at TIMESTAMP, redactions_count BIGINT, "
    "rules_hash STRING"
)
PUBLISH_LOG_SCHEMA = "source_dir STRING, filename STRING, uploaded_at TIMESTAMP, size_bytes BIGINT"


def read_line_set(spark: SparkSession, path: str, name: str = "filename") -> DataFrame:
    """Distinct non-blank lines, trimmed."""
    lines = spark.read.text(path).select(trimmed(F.col("value")).alias(name))
    return lines.where(F.col(name) != "").distinct()


def write_line_set(lines: DataFrame, path: str, name: str = "filename") -> None:
    """Sorted, one per line. A global sort: long lists become several files, in order."""
    lines.select(name).distinct().orderBy(name).write.mode("overwrite").text(path)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, line_no``: numbers grow in file order and are not consecutive."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no")
    )


@dataclass(frozen=True)
class Manifest:
    rows: DataFrame
    malformed: int


def read_manifest(
    spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA, strict: bool = False
) -> Manifest:
    """JSON-lines manifest. Malformed lines are dropped and counted; with ``strict``, one of
    them makes the whole manifest empty."""
    text = spark.read.text(path).where("value rlike '\\\\S'")
    rows = text.select(
        once(strict_json(F.col("value"))).alias("_doc"), F.from_json("value", schema).alias("_row")
    )
    malformed = rows.where("_doc is null").count()
    good = rows.where("_doc is not null").select("_row.*")
    return Manifest(good.limit(0) if strict and malformed else good, malformed)


def read_scanner_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw scanner output lines that may hold a finding."""
    return spark.read.text(path).where(trimmed(F.col("value")).startswith("{"))


def read_image_assets(spark: SparkSession, path: str) -> DataFrame:
    """Image files by extension, whatever its case: ``filename, size``. Contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return image_assets(files.select(name.alias("filename"), F.col("length").alias("size")))


def image_assets(files: DataFrame, name: str = "filename") -> DataFrame:
    return files.where(F.col(name).rlike(r"(?i)\.(png|jpg|jpeg|gif|webp|svg)$"))
