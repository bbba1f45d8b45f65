"""Tables the work ends in. Spark's committer makes each write all-or-nothing; what takes several writes
counts once its marker is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.operators.findings import scan_totals
from tracesieve.operators.joins import cut_lineage
from tracesieve.operators.membership import keep_keys
from tracesieve.operators.publishing import newest_copies, newest_rows, record_uploads, upload_plan
from tracesieve.operators.rules import KEY
from tracesieve.sources.lists import PUBLISH_LOG_SCHEMA, path_exists

MAX_RECORDS = 100_000


def save_collected(collected: DataFrame, path: str) -> DataFrame:
    """Store the result of a collect run once and read it back.

    Sessions, reports and manifest all derive from it; without this step each of them would
    redact everything again.
    """
    collected.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS).parquet(path)
    return collected.sparkSession.read.schema(collected.schema).parquet(path)


def write_redacted(collected: DataFrame, path: str, mode: str = "append") -> None:
    """Collected sessions as Parquet: keys, text, hashes and when they were written.

    A session collected again gets a further row; all readers take the newest one only.
    """
    rows = collected.where("outcome = 'collected' and redacted is not null").select(
        *KEY,
        F.col("redacted").alias("content"),
        "redacted_hash",
        "size_bytes",
        F.current_timestamp().alias("created_at"),
    )
    rows.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS).parquet(path)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Reports with the time of writing, so that the newest one of a session can be told."""
    reports.withColumn("created_at", F.current_timestamp()).write.mode(mode).json(path)


def write_scan_reports(
    reports: DataFrame, findings: DataFrame, path: str, scan_seconds: float | None = None
) -> None:
    """Per-file reports, their findings and one summary row with a time stamp.

    Findings are clustered by file; ``rebalance`` lets Spark cut a file with very many of
    them into several tasks.
    """
    reports.write.mode("overwrite").json(f"{path}/reports")
    findings.hint("rebalance", "file").write.mode("overwrite").json(f"{path}/findings")
    summary = scan_totals(reports).select(
        F.current_timestamp().alias("timestamp"),
        "*",
        F.lit(scan_seconds).cast("double").alias("scan_seconds"),
    )
    summary.write.mode("overwrite").json(f"{path}/summary")


def publish_dataset(
    redacted: DataFrame,
    reject: DataFrame,
    log_path: str,
    dataset_path: str,
    dry_run: bool = False,
    denied: DataFrame | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Write the pending sessions to the dataset and their entries to the log, as one run.

    ``redacted`` has keys, ``content`` and ``size_bytes``; of several copies (``created_at``) only
    the newest is published, so text redacted by older rules never goes out. Sessions in
    ``denied`` (keys) or ``blocked`` (keys, as of the scan's blocking reasons) stay back. Returns
    the plan with ``status``.

    A run has a folder of its own in the dataset and in the log; a marker written last makes both of
    them count. A run that dies before is written over by the next one, so nothing is published
    twice and nothing is recorded that is not there. Read with :func:`read_dataset`.
    """
    spark, run = redacted.sparkSession, len(committed_runs(redacted.sparkSession, log_path))
    log = read_publish_log(redacted.sparkSession, log_path)
    newest = newest_copies(redacted)
    for held_back in (denied, blocked):
        if held_back is not None:
            newest = newest.join(held_back.select(*KEY).distinct(), KEY, "left_anti")
    newest = cut_lineage(newest)
    sizes = newest.select(*KEY, "size_bytes")
    plan = cut_lineage(upload_plan(sizes, reject, log))
    if dry_run:
        return plan
    pending = plan.where("status = 'pending'").select(*KEY)
    one_copy = [c for c in newest.columns if c != "size_bytes"]
    chosen = newest.join(pending, KEY, "left_semi")
    data = keep_keys(redacted, chosen, one_copy).write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS)
    data.parquet(f"{dataset_path}/run={run}")
    record_uploads(log.limit(0), pending, sizes).write.mode("overwrite").parquet(f"{log_path}/run={run}")
    marker = spark.range(1).select(F.lit(str(run)).alias("value")).coalesce(1)
    marker.write.mode("overwrite").text(f"{_markers(log_path)}/run={run}")
    return plan


def _markers(log_path: str) -> str:
    return f"{log_path.rstrip('/')}-committed"


def committed_runs(spark: SparkSession, log_path: str) -> list[int]:
    """Numbers of the runs that were finished, one for each call that published."""
    if not path_exists(spark, _markers(log_path)):
        return []
    return sorted(int(r["value"]) for r in spark.read.text(_markers(log_path)).select("value").collect())


def read_dataset(spark: SparkSession, dataset_path: str, log_path: str) -> DataFrame:
    """Published sessions of finished runs."""
    return _committed(spark.read.parquet(dataset_path), committed_runs(spark, log_path)).drop("run")


def _committed(rows: DataFrame, runs: list[int]) -> DataFrame:
    """Rows of finished runs. These are numbered without gaps, so a bound on the number prunes folders."""
    return rows.where(F.col("run") < len(runs))


def read_publish_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The publish log of finished runs; empty before the first."""
    runs = committed_runs(spark, log_path)
    if not runs:
        return spark.createDataFrame([], PUBLISH_LOG_SCHEMA)
    rows = spark.read.schema(f"{PUBLISH_LOG_SCHEMA}, run INT").parquet(log_path)
    return _committed(rows, runs).drop("run")
