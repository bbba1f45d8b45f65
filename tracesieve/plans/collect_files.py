"""The collect run over session files, those of any length included.

JSON lines that are too long for one row are redacted line by line: their lines are a table of their
own, and the session's row has what it has for others, but for the text. Its hashes are folded from
the lines' hashes in fixed groups, so they do not depend on how the file was split.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.operators import hashing
from tracesieve.operators.joins import cut_lineage, sized_join
from tracesieve.operators.json_redaction import redaction_counts, with_parsed, with_redaction
from tracesieve.operators.manifest import read_manifest_table, update_manifest
from tracesieve.operators.rules import KEY, comparable, denied_by_content
from tracesieve.plans.collect import MANIFEST_COLUMNS, collect, decide
from tracesieve.sources.lists import path_exists
from tracesieve.sources.sessions import LONG_BYTES, is_long, list_sessions, read_long_lines, read_sessions
from tracesieve.sources.sinks import save_collected

# Lines whose hashes are folded into one.
FOLD = 4096
# Tables below the sessions' own folder; Spark does not take such names for partitions.
LINES = "_lines"
MANIFEST = "_manifest"
SEEN = "_seen"
SEEN_SCHEMA = "path STRING, size BIGINT, modified TIMESTAMP, run BIGINT"
FILES_PER_BATCH = 10_000
WRAPPED = len('{"lines":[]}')


def folded_hash(rows: DataFrame, digest: str, name: str) -> DataFrame:
    """``KEY`` and the SHA-256 over the digests of a session's lines, in order: first of ``FOLD`` lines at
    a time, then of what these give."""

    def fold(at: str, value: str) -> Column:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value])
        return F.sha2(F.array_join(ordered, "").cast("binary"), 256)

    groups = rows.groupBy(*KEY, F.expr(f"line_no div {FOLD}").alias("_group")).agg(fold("line_no", digest).alias("_digest"))
    return groups.groupBy(*KEY).agg(fold("_group", "_digest").alias(name))


def lines_hash(lines: DataFrame) -> DataFrame:
    """``KEY, source_hash`` of sessions given by their lines."""
    return folded_hash(lines.select(*KEY, "line_no", F.sha2("line", 256).alias("_sha")), "_sha", "source_hash")


def redact_lines(
    lines: DataFrame, secrets: DataFrame | None, deny: Iterable[str], strip_images: bool, extra: list[str], **bounds: int
) -> DataFrame:
    """Every line as a JSON value of its own, redacted: ``KEY, line_no, line_sha, error, denied, redacted``,
    counts and ``changed`` with paths below ``$.lines``."""
    base = [*KEY, "line_no", "line_sha", "error", "denied"]
    df = lines.select(*KEY, "line_no", "line", F.sha2("line", 256).alias("line_sha"))
    df = with_parsed(df, F.col("line"), [*KEY, "line_no", "line_sha"])
    df = df.withColumnRenamed("_error", "error").withColumn("denied", F.coalesce(denied_by_content(F.col("_compact"), deny), F.lit(False)))
    df = with_redaction(df.select(*base, "_compact", "_leaves"), [*KEY, "line_no"], secrets, strip_images, extra, **bounds)
    root = F.concat(F.lit("$.lines["), F.col("line_no").cast("string"), F.lit("]"))
    moved = F.transform("changed", lambda r: r.withField("path", F.concat(root, F.substr(r["path"], F.lit(2)))))
    return df.select(*base, "redacted", *redaction_counts(F.col("changed")), moved.alias("changed"))


def sessions_of_lines(done: DataFrame) -> DataFrame:
    """One row for each session of redacted lines, with the columns of :func:`collect`.

    One bad line fails the session, one denied line rejects it. ``redacted`` and ``changed`` stay null: they
    are the lines' own. The hash is over the lines; the size is that of ``{"lines":[...]}``.
    """
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("_denied"), "rejected").otherwise("collected")
    sums = done.groupBy(*KEY).agg(
        F.min("error").alias("error"),
        F.bool_or("denied").alias("_denied"),
        (F.sum(F.octet_length("redacted") + 1) - 1 + WRAPPED).alias("_size"),
        *[F.sum(c).alias(c) for c in ("redactions_count", "match_count", "images_stripped")],
    )
    hashed = done.select(*KEY, "line_no", "line_sha", F.coalesce(F.sha2("redacted", 256), F.lit("")).alias("_new"))
    source = folded_hash(hashed, "line_sha", "source_hash")
    redacted = folded_hash(hashed, "_new", "redacted_hash")
    df = sums.join(source, KEY).join(redacted, KEY).withColumn("outcome", outcome)
    good = lambda c: F.when(F.col("outcome") == "collected", c)
    counts = ("redactions_count", "match_count", "images_stripped")
    return df.select(
        *KEY, "source_hash", "outcome", "error",
        good(F.col("redacted_hash")).alias("redacted_hash"),
        good(hashing.redaction_key(F.col("source_hash"), F.col("redactions_count"))).alias("redaction_key"),
        good(F.col("_size")).cast("bigint").alias("size_bytes"),
        *[good(F.col(c)).alias(c) for c in counts],
    )


def collect_files(
    spark: SparkSession,
    paths: str | Iterable[str],
    target: str,
    secrets: DataFrame | None = None,
    deny: Iterable[str] = (),
    reject: DataFrame | None = None,
    prev: DataFrame | None = None,
    force: bool = False,
    strip_images: bool = False,
    rules_hash: str | None = None,
    long_bytes: int = LONG_BYTES,
    batch: str | int = 0,
    extra_rules: Iterable[str] = (),
    **bounds: int,
) -> DataFrame:
    """Collect session files into ``target`` and return their rows, read back: those of
    :func:`~tracesieve.plans.collect.collect` with ``created_at``. Each run writes its own ``batch``; one
    that is run again replaces what it left.

    Long JSON lines go line by line; :func:`redacted_rows` has the text of both kinds.
    """
    deny, extra = list(deny), list(extra_rules)
    prev = None if force else prev
    rows = read_sessions(spark, paths, long_bytes=long_bytes)
    long_file = is_long(F.col("filename"), F.col("size"), long_bytes)
    done = collect(
        rows.where(~long_file), secrets, deny, reject, prev,
        strip_images=strip_images, rules_hash=rules_hash, extra_rules=extra, **bounds,
    )
    files = list_sessions(spark, paths).where(long_file)
    if files.limit(1).count():
        lines = read_long_lines(spark, paths, long_bytes=long_bytes)
        known = files.select(*KEY, F.lit(None).cast("string").alias("source_hash"))
        if prev is not None:
            known = cut_lineage(known.drop("source_hash").join(lines_hash(lines), KEY, "left"))
            prev = comparable(prev, rules_hash)
        decided = cut_lineage(decide(known, reject, deny, prev))
        todo = decided.where("outcome is null").select(*KEY)
        lines = sized_join(lines, todo, KEY, "left_semi", spread=["line_no"])
        long_path = f"{target}/{LINES}/batch={batch}"
        redact_lines(lines, secrets, deny, strip_images, extra, **bounds).write.mode("overwrite").parquet(long_path)
        read = sessions_of_lines(spark.read.parquet(long_path))
        # A file without a line that is not blank is a session without lines.
        empty = todo.join(read.select(*KEY), KEY, "left_anti")
        stopped = decided.where("outcome is not null").unionByName(empty.withColumn("outcome", F.lit("failed")), allowMissingColumns=True)
        done = done.unionByName(read, allowMissingColumns=True).unionByName(stopped, allowMissingColumns=True)
    saved = save_collected(done.withColumn("created_at", hashing.created_at()), f"{target}/batch={batch}")
    update_manifest(spark, f"{target}/{MANIFEST}", saved.where("outcome = 'collected'").select(*MANIFEST_COLUMNS, "created_at"))
    return saved


def collected_rows(spark: SparkSession, target: str) -> DataFrame:
    """Sessions of all batches, whatever their outcome."""
    return spark.read.parquet(target)


def redacted_rows(spark: SparkSession, target: str) -> DataFrame:
    """Redacted text of the collected sessions of all batches: ``KEY, part, content, redacted_hash,
    size_bytes, created_at``. ``part`` is null for a session in one row, else the number of a line."""
    done = collected_rows(spark, target).where("outcome = 'collected'").withColumn("batch", F.col("batch").cast("string"))
    marks = ["redacted_hash", "size_bytes", "created_at"]
    whole = done.where("redacted is not null").select(*KEY, F.lit(None).cast("bigint").alias("part"), F.col("redacted").alias("content"), *marks)
    lines_path = f"{target}/{LINES}"
    if not path_exists(spark, lines_path):
        return whole
    lines = spark.read.parquet(lines_path).withColumn("batch", F.col("batch").cast("string"))
    lines = lines.select(*KEY, "batch", F.col("line_no").alias("part"), F.col("redacted").alias("content"))
    owners = done.where("redacted is null").select(*KEY, "batch", *marks)
    parts = sized_join(lines, owners, [*KEY, "batch"], "inner", spread=["part"])
    return whole.unionByName(parts.select(*whole.columns))


def collected_manifest(spark: SparkSession, target: str) -> DataFrame:
    """One manifest row for each session, over all batches: each batch is merged into the table."""
    path = f"{target}/{MANIFEST}"
    if not path_exists(spark, path):
        return collected_rows(spark, target).select(*MANIFEST_COLUMNS, "created_at").limit(0)
    return read_manifest_table(spark, path)


def collect_changed(
    spark: SparkSession, paths: str | Iterable[str], target: str, files_per_batch: int = FILES_PER_BATCH, **options
) -> int:
    """Collect the files that are new, or whose size or modification time is not what it was when they
    were last collected; returns their number. ``options`` are those of :func:`collect_files`.

    The state, (path, size, modified), is a table below ``target``. Files go in batches of
    ``files_per_batch``, the most whose names the driver holds; each batch joins the state once it is
    written, so a run that dies is taken up where it was, and the newest copy of a session counts.
    """
    state, now = f"{target}/{SEEN}", list_sessions(spark, paths).select("path", "size", "modified")
    run, todo = 0, now
    if path_exists(spark, state):
        seen = spark.read.schema(SEEN_SCHEMA).parquet(state)
        run = seen.agg(F.max("run")).first()[0] + 1
        todo = now.join(seen.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")
    waiting, total = cut_lineage(todo).toLocalIterator(), 0
    while batch := list(islice(waiting, files_per_batch)):
        collect_files(spark, [r["path"] for r in batch], target, batch=f"run-{run}", **options)
        spark.createDataFrame([(*r, run) for r in batch], SEEN_SCHEMA).write.mode("append").parquet(state)
        run, total = run + 1, total + len(batch)
    return total
