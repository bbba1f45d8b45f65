"""The manifest of collected sessions and the reject list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.functions.text import basename
from tracesieve.operators.joins import cut_lineage, fits_broadcast, path_exists
from tracesieve.operators.publishing import newest_rows
from tracesieve.operators.rules import KEY


# Parts a manifest table is cut into by a hash of the key.
BUCKETS = 256


def newest_entries(new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row for each key: the newest (``created_at``), of equal ones the greatest."""
    values = [c for c in new.columns if c not in keys]
    order = [c for c in ("created_at",) if c in values]
    newest = F.max_by(F.struct(*values), F.struct(*order, *[c for c in values if c not in order]))
    return new.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*new.columns)


def upsert_manifest(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """New rows replace old ones with the same key; the rest is kept.

    ``old`` has one row for each key, as this function leaves it, and is read as it is: the new keys are
    broadcast to it, or where they are many the keys of both sides meet. Repeated new keys combine first.
    """
    newest = cut_lineage(newest_entries(new.select(*old.columns), keys))
    named = newest.select(*keys)
    if fits_broadcast(named):
        named = F.broadcast(named)
    return old.join(named, keys, "left_anti").unionByName(newest)


def bucket(keys: list[str] = KEY, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def update_manifest(spark: SparkSession, path: str, new: DataFrame, keys: list[str] = KEY, buckets: int = BUCKETS) -> None:
    """Upsert into the manifest table at ``path``. It is partitioned by a hash of the key; only the parts
    that get new rows are read, merged and written, the others are not touched."""
    newest = cut_lineage(newest_entries(new, keys).withColumn("bucket", bucket(keys, buckets)))
    merged = newest
    if path_exists(spark, path):
        touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # ``buckets`` at most
        old = spark.read.schema(newest.schema).parquet(path).where(F.col("bucket").isin(touched))
        merged = cut_lineage(upsert_manifest(old, newest, keys))
    parts = merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite")
    parts.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_manifest_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def session_metadata(manifest: DataFrame, filename: str) -> DataFrame:
    """Manifest row of one name; the latest when directories share the name."""
    named = manifest.where(F.col("filename") == filename)
    return named.orderBy(F.col("created_at").desc(), "source_dir").limit(1)


def load_session(redacted: DataFrame, filename: str) -> DataFrame:
    """Redacted text by name, the newest copy in each directory; no row when there is none. The filter
    reaches the scan."""
    return newest_rows(redacted.where(F.col("filename") == filename))


def add_rejected(reject: DataFrame, names: DataFrame, name: str = "filename") -> DataFrame:
    """Reject list with more names, which may be paths."""
    added = names.select(basename(F.col(name)).alias("filename"))
    return reject.select("filename").union(added).distinct()


def remove_rejected(reject: DataFrame, names: DataFrame, name: str = "filename") -> DataFrame:
    """Reject list without the given names, which may be paths."""
    removed = names.select(basename(F.col(name)).alias("filename")).distinct()
    return reject.select("filename").distinct().join(removed, ["filename"], "left_anti")
