"""Joins whose physical form depends on a measured size, never on a hope."""

from __future__ import annotations

import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and about how many bytes they take. Every task adds up its own rows;
    two numbers reach the driver."""
    width = F.lit(0)
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 16
    sums = df.select(width.cast("bigint").alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)))
    return tuple(sums.first())


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def shuffled(one: DataFrame) -> DataFrame:
    """``one`` for a join that shuffles. The planner goes by estimates of rows before they are repeated or
    built up, and by compressed sizes, and may broadcast a side that the driver cannot hold."""
    return one.hint("merge")


def salted_join(
    many: DataFrame, one: DataFrame, on: list[str], spread: list[str], how: str, salts: int = 16
) -> DataFrame:
    """Equi-join where one key may hold a large share of ``many``.

    ``many`` is cut into ``salts`` slices by a hash of ``spread``; ``one`` is repeated once
    per slice, and never broadcast. A hot key is then handled by ``salts`` tasks. ``how`` must keep
    rows of ``many`` only: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted join cannot be {how}")
    slices = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", slices)
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def sized_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    small: bool | None = None,
) -> DataFrame:
    """Broadcast ``one`` when it is small, otherwise a salted shuffle join. Measures ``one``
    unless ``small`` says that was done."""
    if fits_broadcast(one) if small is None else small:
        return many.join(F.broadcast(one), on, how)
    return salted_join(many, one, on, spread, how)


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, or one set on the context, as tests do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the checkpoint folder, if there is one. It is then computed once and
    survives the loss of executors.

    Without a folder the plan is returned as it is and computed again where needed, with a warning.
    """
    if checkpoint_folder(df.sparkSession):
        return df.checkpoint()
    warnings.warn("spark.checkpoint.dir is not set: results are computed again where used", stacklevel=2)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """False only if nothing is there; other faults, such as a refused access, are raised."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
