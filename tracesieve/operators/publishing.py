"""What is published next, what was, and how much is left.

The publish log is a table of its own. (The reference writes it into the manifest, which
makes everything collected look published and then drops the collector's columns.)
All of this works on names and sizes; contents are only read by the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.text import kilobytes
from tracesieve.operators.membership import keep_keys
from tracesieve.operators.rules import KEY, drop_rejected, mark_rejected


def newest_copies(redacted: DataFrame) -> DataFrame:
    """Keys, ``size_bytes`` and what tells the newest copy of each session apart from older ones.

    Without ``created_at`` every session is taken to have one copy.
    """
    if "created_at" not in redacted.columns:
        return redacted.select(*KEY, "size_bytes").distinct()
    marks = [c for c in ("created_at", "redacted_hash") if c in redacted.columns]
    newest = F.max(F.struct(*marks, "size_bytes")).alias("_newest")
    return redacted.groupBy(*KEY).agg(newest).select(*KEY, "_newest.*")


def newest_rows(redacted: DataFrame) -> DataFrame:
    """Rows of the newest copy of each session. Only names, times and hashes are compared."""
    if "created_at" not in redacted.columns:
        return redacted
    newest = newest_copies(redacted)
    marks = [c for c in newest.columns if c != "size_bytes"]
    return keep_keys(redacted, newest, marks)


def _one_copy(sessions: DataFrame) -> DataFrame:
    return newest_copies(sessions) if "created_at" in sessions.columns else sessions


def publishable(redacted: DataFrame, reject: DataFrame, denied: DataFrame) -> DataFrame:
    """Redacted sessions that are neither rejected nor denied by the current rules.

    A session denied after it was first redacted keeps its old copy; without the last test
    that copy would still go out. ``denied`` has the session keys.
    """
    allowed = drop_rejected(redacted, reject)
    return allowed.join(denied.select(*KEY).distinct(), KEY, "left_anti")


def upload_plan(sessions: DataFrame, reject: DataFrame, log: DataFrame) -> DataFrame:
    """``status`` of every session that is not rejected: ``pending`` or ``uploaded``. Of several copies
    (``created_at``) the newest counts."""
    sessions = _one_copy(sessions)
    allowed = drop_rejected(sessions, reject)
    done = log.select(*KEY).distinct().withColumn("_done", F.lit(True))
    return allowed.join(done, KEY, "left").select(
        *sessions.columns,
        F.when(F.col("_done"), "uploaded").otherwise("pending").alias("status"),
    )


def record_uploads(
    log: DataFrame, published: DataFrame, sizes: DataFrame, uploaded_at: Column | None = None
) -> DataFrame:
    """Publish log after a run: one row per session with its current size, 0 if it is gone."""
    at = F.current_timestamp() if uploaded_at is None else uploaded_at
    before = log.select(*KEY, F.col("uploaded_at").alias("at"))
    names = before.unionByName(published.select(*KEY, F.lit(None).cast("timestamp").alias("at")))
    names = names.groupBy(*KEY).agg(F.max("at").alias("at"))
    current = sizes.select(*KEY, "size_bytes")
    return names.join(current, KEY, "left").select(
        *KEY,
        F.coalesce("at", at).alias("uploaded_at"),
        F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"),
    )


def workspace_stats(sessions: DataFrame, reject: DataFrame, log: DataFrame) -> DataFrame:
    """Total, uploaded, pending and rejected counts and the pending bytes.

    As in the reference, ``uploaded`` includes rejected sessions and ``rejected`` counts names
    on the list, even without a session; the parts need not add up to ``total``. Of several copies of
    a session the newest counts.
    """
    done = log.select(*KEY).distinct().withColumn("_done", F.lit(True))
    marked = mark_rejected(_one_copy(sessions).select(*KEY, "size_bytes"), reject, "_rejected")
    marked = marked.join(done, KEY, "left").withColumn("_done", F.coalesce("_done", F.lit(False)))
    pending = ~F.col("_done") & ~F.col("_rejected")
    counts = marked.agg(
        F.count("*").alias("total"),
        F.count_if("_done").alias("uploaded"),
        F.count_if(pending).alias("pending"),
        F.coalesce(F.sum(F.when(pending, F.col("size_bytes"))), F.lit(0)).alias("total_size"),
    )
    names = reject.select("filename").distinct().agg(F.count("*").alias("rejected"))
    return counts.select(
        "total",
        "uploaded",
        "pending",
        names.scalar().alias("rejected"),
        "total_size",
        kilobytes(F.col("total_size")).alias("pending_kb"),
    )


def dataset_stats(sessions: DataFrame) -> DataFrame:
    """Number and bytes of the redacted sessions, as a dataset card states them; of several copies the
    newest counts."""
    sums = _one_copy(sessions).agg(
        F.count("*").alias("num_examples"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("num_bytes"),
    )
    return sums.withColumn("total_kb", kilobytes(F.col("num_bytes")))


def upload_result(attempts: DataFrame) -> DataFrame:
    """One row: how many were uploaded, skipped and failed, and whether all went well.

    ``attempts`` has ``status`` uploaded, skipped or failed. The names of the failed ones are
    :func:`failed_uploads`: a list of any length does not belong in one row.
    """
    status = F.col("status")
    sums = attempts.agg(
        F.count_if(status == "uploaded").alias("uploaded"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "failed").alias("failed"),
    )
    return sums.withColumn("success", F.col("failed") == 0)


def failed_uploads(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("status") == "failed").select(*KEY).orderBy(*KEY)
