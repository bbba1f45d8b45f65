"""Registered queries that write and read back: sources, sinks and the stream.

They write below the shared folder named in ``spark.checkpoint.dir``. Where none is named,
as in tests, a temporary folder of this machine serves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracesieve.functions.patterns import compile_patterns, matches_any
from tracesieve.functions.text import once
from tracesieve.operators import findings as fnd
from tracesieve.operators import publishing as pub
from tracesieve.operators import trajectories as tr
from tracesieve.operators import trigram_index
from tracesieve.operators.joins import checkpoint_folder
from tracesieve.operators.publishing import newest_rows
from tracesieve.plans import collect as col
from tracesieve.plans import collect_files as files
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans import scan
from tracesieve.plans.registry import query
from tracesieve.plans.session_queries import SESSIONS, json_collect_ctes
from tracesieve.sources import lists, sinks
from tracesieve.sources import sessions as src
from tracesieve.streaming.collect_stream import stream_collect, streamed_manifest


def scratch(spark) -> str:
    """A new folder name for one run."""
    base = checkpoint_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def _session_files(spark, sf_dir, path):
    """Conversation turns as JSON-lines session files, one folder per role.

    Files keep to a bounded number of turns; hot roles just get more files.
    """
    turns = fx.table(spark, sf_dir, "conversations")
    rows = turns.select(
        "role",
        F.concat_ws("-", "conv_id", "turn").alias("step_key"),
        F.col("role").alias("source"),
        F.col("text").alias("message"),
    )
    rows.write.partitionBy("role").option("maxRecordsPerFile", 200).json(path)
    return [f"{path}/role={r}" for r in ("user", "assistant", "system", "absent")]


@query(
    "read_session_dirs",
    """SELECT 'role=' || role AS dir, CAST(count(*) AS BIGINT) AS lines FROM conversations GROUP BY role""",
)
def read_session_dirs(spark, sf_dir):
    """Files of several directories, one of them missing, parsed as JSON lines."""
    dirs = _session_files(spark, sf_dir, scratch(spark))
    source = src.read_session_dirs(spark, dirs)
    rows = src.parse_session(source.sessions).where("ok")
    lines = F.size(F.expr("variant_get(session, '$.lines', 'array<variant>')"))
    one = F.when(F.expr("try_variant_get(session, '$.lines', 'variant') IS NULL"), 1)
    counted = rows.select(
        F.regexp_extract("source_dir", r"([^/]+)$", 1).alias("dir"),
        F.coalesce(one, lines).alias("n"),
    )
    return counted.groupBy("dir").agg(F.sum("n").alias("lines"))


@query(
    "count_by_dir",
    "SELECT DISTINCT 'role=' || role AS dir, true AS has_sessions FROM conversations",
)
def count_by_dir(spark, sf_dir):
    source = src.read_session_dirs(spark, _session_files(spark, sf_dir, scratch(spark)))
    counts = src.count_by_dir(source.sessions)
    return counts.select(
        F.regexp_extract("source_dir", r"([^/]+)$", 1).alias("dir"),
        (F.col("sessions") > 0).alias("has_sessions"),
    )


@query(
    "parse_session",
    f"""WITH {SESSIONS} SELECT filename, compact IS NOT NULL AS ok,
      CASE WHEN compact IS NULL THEN 'none' WHEN doc_id % 14 = 13 THEN 'text' WHEN doc_id % 7 = 5 THEN 'lines' ELSE 'object' END AS kind
    FROM sessions""",
)
def parse_session(spark, sf_dir):
    rows = src.parse_session(fx.json_sessions(spark, sf_dir))
    lines = F.expr("try_variant_get(session, '$.lines', 'variant') IS NOT NULL")
    kind = (
        F.when(~F.col("ok"), "none")
        .when(F.schema_of_variant("session") == "STRING", "text")
        .when(lines, "lines")
        .otherwise("object")
    )
    return rows.select("filename", "ok", kind.alias("kind"))


@query(
    "line_set_round_trip",
    f"WITH {o.REJECT} SELECT filename FROM reject",
)
def line_set_round_trip(spark, sf_dir):
    path = scratch(spark)
    names = fx.reject_list(spark, sf_dir)
    padded = names.union(names.select(F.concat(F.lit("  "), "filename", F.lit(" "))))
    lists.write_line_set(padded.union(names.select(F.lit("   "))), path)
    return lists.read_line_set(spark, path)


@query(
    "compile_patterns",
    """SELECT page_id, regexp_matches(url, '[0-9]+$') OR regexp_matches(url, 'page=2') AS matched,
      '(broken, [z-a]' AS dropped FROM pages""",
)
def patterns(spark, sf_dir):
    """Valid patterns are used, the invalid ones returned."""
    compiled = compile_patterns(spark, ["[0-9]+$ ", "", "(broken", "page=2", "[z-a]"])
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        matches_any(F.col("url"), compiled.valid).alias("matched"),
        F.lit(", ".join(compiled.dropped)).alias("dropped"),
    )


@query(
    "manifest_round_trip",
    """SELECT 'order_' || o_orderkey || '.json' AS filename, sha256(o_orderstatus) AS source_hash, o_custkey AS size_bytes,
      CAST((SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS BIGINT) AS malformed FROM orders""",
)
def manifest_round_trip(spark, sf_dir):
    """A manifest with torn lines between the good ones."""
    path = scratch(spark)
    good = fx.table(spark, sf_dir, "orders").select(
        F.to_json(
            F.struct(
                F.lit("desk").alias("source_dir"),
                F.expr("'order_' || CAST(o_orderkey AS STRING) || '.json'").alias("filename"),
                F.sha2("o_orderstatus", 256).alias("source_hash"),
                F.col("o_custkey").alias("size_bytes"),
            )
        ).alias("value")
    )
    torn = fx.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    good.union(torn.select(F.concat(F.lit('{"filename": "'), "c_name"))).write.text(path)
    manifest = lists.read_manifest(spark, path)
    return manifest.rows.select(
        "filename", "source_hash", "size_bytes", F.lit(manifest.malformed).alias("malformed")
    ).withColumn("malformed", F.col("malformed").cast("bigint"))


@query(
    "scanner_lines_round_trip",
    f"WITH {o.FINDINGS} SELECT detector, status, line, masked, file FROM parsed",
)
def scanner_lines_round_trip(spark, sf_dir):
    path = scratch(spark)
    fx.scanner_lines(spark, sf_dir).write.text(path)
    found = fnd.parse_findings(lists.read_scanner_lines(spark, path))
    return found.select("detector", "status", "line", "masked", "file")


@query(
    "scan_reports_round_trip",
    f"""WITH {o.SCAN}, {o.REPORTS} SELECT r.file, r.findings, CAST(count(k.file) AS BIGINT) AS stored,
      CAST((SELECT sum(findings) FROM reports) AS BIGINT) AS total_findings
    FROM reports r LEFT JOIN known k ON k.file = r.file GROUP BY r.file, r.findings""",
)
def scan_reports_round_trip(spark, sf_dir):
    path = scratch(spark)
    result = scan.scan_lines(fx.scanned_files(spark, sf_dir), fx.scanner_lines(spark, sf_dir))
    sinks.write_scan_reports(result.reports, result.findings, path, scan_seconds=1.0)
    stored = spark.read.json(f"{path}/findings").groupBy("file").agg(F.count("*").alias("stored"))
    summary = spark.read.json(f"{path}/summary").select("total_findings")
    reports = spark.read.json(f"{path}/reports").select("file", "findings")
    return reports.join(stored, ["file"], "left").select(
        "file",
        "findings",
        F.coalesce("stored", F.lit(0)).alias("stored"),
        summary.scalar().alias("total_findings"),
    )


@query(
    "redacted_round_trip",
    f"""WITH {json_collect_ctes()} SELECT filename, sha256(redacted) AS content_sha, redactions_count AS reported
    FROM collected WHERE outcome = 'collected'""",
)
def redacted_round_trip(spark, sf_dir):
    """Redact once, then write sessions and reports from the stored result."""
    path = scratch(spark)
    rows = fx.json_sessions(spark, sf_dir)
    collected = col.collect(
        rows,
        deny=[fx.DENY_NAME, fx.DENY_CONTENT],
        reject=fx.reject_list(spark, sf_dir),
        prev=fx.previous_manifest(rows),
    )
    done = sinks.save_collected(collected, f"{path}/collected")
    sinks.write_redacted(done, f"{path}/redacted")
    sinks.write_reports(col.redaction_report(done), f"{path}/reports")
    reports = spark.read.json(f"{path}/reports").select("filename", "redactions_count")
    redacted = spark.read.parquet(f"{path}/redacted")
    joined = redacted.join(reports, ["filename"])
    return joined.select(
        "filename",
        F.sha2("content", 256).alias("content_sha"),
        F.col("redactions_count").alias("reported"),
    )


@query(
    "publish_round_trip",
    f"""WITH {o.PLANTED}, {o.REJECT}, ok AS (SELECT * FROM planted WHERE filename NOT IN (SELECT filename FROM reject))
    SELECT filename, sha256(text) AS content_sha, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(1 AS BIGINT) AS copies FROM ok""",
)
def publish_round_trip(spark, sf_dir):
    """Two runs: the second finds new sessions only."""
    path = scratch(spark)
    docs = fx.planted(spark, sf_dir).select(
        "lang",
        "source_dir",
        "filename",
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )
    reject = fx.reject_list(spark, sf_dir)
    for part in (docs.where("lang = 'en'"), docs):
        sinks.publish_dataset(part.drop("lang"), reject, f"{path}/log", f"{path}/data")
    log = sinks.read_publish_log(spark, f"{path}/log")
    data = spark.read.parquet(f"{path}/data")
    copies = data.groupBy("source_dir", "filename", F.sha2("content", 256).alias("content_sha"))
    counted = copies.agg(F.count("*").alias("copies"))
    joined = counted.join(log, ["source_dir", "filename"])
    return joined.select("filename", "content_sha", "size_bytes", "copies")


@query(
    "stream_collect",
    """SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (regexp_matches(text, 'o')) AS BIGINT) AS with_o FROM conversations""",
)
def collect_stream(spark, sf_dir):
    """Session files collected in micro-batches; the steps come out whole."""
    path = scratch(spark)
    _session_files(spark, sf_dir, f"{path}/in")
    run = stream_collect(spark, f"{path}/in/*", f"{path}/out", f"{path}/state")
    run.awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    named = streamed_manifest(spark, f"{path}/out").select("source_dir", "filename")
    typed = tr.parse_trajectory(rows.join(named, ["source_dir", "filename"]))
    step = tr.steps(typed, ["source_dir", "filename"])
    single = typed.where("trajectory.lines IS NULL").agg(
        F.count("*").alias("n"), F.count_if(F.col("redacted").rlike('"message":"[^"]*o')).alias("o")
    )
    return step.agg(
        F.count("*").alias("lines"), F.count_if(F.col("message").rlike("o")).alias("with_o")
    ).select(
        (F.col("lines") + single.select("n").scalar()).alias("lines"),
        (F.col("with_o") + single.select("o").scalar()).alias("with_o"),
    )


_STEP = "lines ARRAY<STRUCT<step_key: STRING, message: STRING>>, step_key STRING, message STRING"


def _steps_of(redacted):
    """Key and message of every step, of sessions in one row and of those in lines."""
    doc = F.from_json("content", _STEP)
    steps = redacted.select(once(doc).alias("d")).select(
        F.explode(F.coalesce("d.lines", F.array(F.struct("d.step_key", "d.message")))).alias("s")
    )
    return steps.select("s.step_key", F.sha2("s.message", 256).alias("message_sha"))


@query(
    "collect_files",
    """SELECT conv_id || '-' || turn AS step_key, sha256(text || ' [REDACTED:OPENAI_KEY]') AS message_sha,
      CAST((SELECT count(*) FROM conversations) AS BIGINT) AS redactions FROM conversations""",
)
def collect_files(spark, sf_dir):
    """Session files of all sizes, the larger ones line by line; every step comes out redacted."""
    path = scratch(spark)
    turns = fx.table(spark, sf_dir, "conversations").select(
        "role", F.concat_ws("-", "conv_id", "turn").alias("step_key"), F.expr("text || ' sk-' || md5(text)").alias("message")
    )
    turns.write.partitionBy("role").option("maxRecordsPerFile", 150).json(f"{path}/in")
    _name_files(spark, f"{path}/in", f"{path}/files")
    done = files.collect_files(spark, f"{path}/files", f"{path}/out", long_bytes=20_000)
    total = done.agg(F.sum("redactions_count").alias("n")).scalar()
    return _steps_of(files.redacted_rows(spark, f"{path}/out")).withColumn("redactions", total)


def _name_files(spark, source, target, names=None):
    """Move written files to ``target`` as ``.jsonl`` files named by their folder and number, over those
    that are there. Names only pass through here."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    system = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(target))
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(source)
    for k, row in enumerate(paths.select("path").orderBy("path").toLocalIterator()):
        folder = row["path"].rsplit("/", 2)[1].split("=")[-1]
        goal = hadoop.Path(f"{target}/{names(folder) if names else f'{folder}-{k}'}.jsonl")
        system.delete(goal, False)
        system.rename(hadoop.Path(row["path"]), goal)


@query(
    "collect_changed",
    """SELECT conv_id || '-' || turn AS step_key, sha256(CASE WHEN conv_id % 16 < 4 THEN text || ' edited' ELSE text END) AS message_sha,
      16 AS first_run, 4 AS second_run, 0 AS third_run FROM conversations""",
)
def collect_changed(spark, sf_dir):
    """Files that change between two runs are collected again, the others are not."""
    path, runs = scratch(spark), []
    turns = fx.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 16).alias("bucket"), F.concat_ws("-", "conv_id", "turn").alias("step_key"), F.col("text").alias("message")
    )
    edited = turns.where("bucket < 4").withColumn("message", F.concat("message", F.lit(" edited")))
    for run, rows in enumerate((turns, edited, None)):
        if rows is not None:
            rows.repartition("bucket").write.partitionBy("bucket").json(f"{path}/in-{run}")
            _name_files(spark, f"{path}/in-{run}", f"{path}/files", names=lambda bucket: f"s-{bucket}")
        runs.append(files.collect_changed(spark, f"{path}/files", f"{path}/out", long_bytes=20_000))
    newest = newest_rows(files.redacted_rows(spark, f"{path}/out"))
    counts = [F.lit(n).alias(name) for n, name in zip(runs, ("first_run", "second_run", "third_run"))]
    return _steps_of(newest).select("*", *counts)


def _redacted_copies(spark, sf_dir, path):
    """All sessions as they are, then the English ones again without their last word."""
    docs = fx.planted(spark, sf_dir)
    again = docs.where("lang = 'en'").withColumn("text", F.regexp_replace("text", r"\s\S*\z", ""))
    for rows in (docs, again):
        text = F.col("text")
        done = rows.select(
            "source_dir", "filename", F.lit("collected").alias("outcome"), text.alias("redacted"),
            F.sha2(text, 256).alias("redacted_hash"), F.octet_length(text).cast("bigint").alias("size_bytes"),
        )
        sinks.write_redacted(done, path)
    return spark.read.parquet(path)


_NEWEST = f"""{o.PLANTED}, newest AS (SELECT lang, source_dir, filename,
    CASE WHEN lang = 'en' THEN regexp_replace(text, '\\s\\S*\\z', '') ELSE text END AS text FROM planted)"""


@query(
    "recollect_round_trip",
    f"""WITH {_NEWEST} SELECT filename, sha256(text) AS content_sha, (SELECT count(*) FROM newest) AS num_examples,
      CAST((SELECT sum(strlen(text)) FROM newest) AS BIGINT) AS num_bytes FROM newest""",
)
def recollect_round_trip(spark, sf_dir):
    """Sessions collected twice: every reader sees the newest copy."""
    redacted = _redacted_copies(spark, sf_dir, f"{scratch(spark)}/redacted")
    stats = pub.dataset_stats(redacted)
    return newest_rows(redacted).select(
        "filename",
        F.sha2("content", 256).alias("content_sha"),
        stats.select("num_examples").scalar().alias("num_examples"),
        stats.select("num_bytes").scalar().alias("num_bytes"),
    )


@query(
    "publish_denied",
    f"""WITH {_NEWEST}, {o.REJECT} SELECT filename, sha256(text) AS content_sha FROM newest
    WHERE lang NOT IN ('de', 'fr') AND filename NOT IN (SELECT filename FROM reject)""",
)
def publish_denied(spark, sf_dir):
    """What is denied, blocked by the scan or rejected stays back, whichever copy it is."""
    path = scratch(spark)
    redacted = _redacted_copies(spark, sf_dir, f"{path}/redacted")
    docs = fx.planted(spark, sf_dir)
    keys = lambda lang: docs.where(F.col("lang") == lang).select("source_dir", "filename")
    reject = fx.reject_list(spark, sf_dir)
    for _ in range(2):
        sinks.publish_dataset(redacted, reject, f"{path}/log", f"{path}/data", denied=keys("de"), blocked=keys("fr"))
    return spark.read.parquet(f"{path}/data").select("filename", F.sha2("content", 256).alias("content_sha"))


@query(
    "grep_store",
    f"""WITH {o.PLANTED}, {o.REJECT} SELECT source_dir, filename FROM planted
    WHERE regexp_matches(text, 'risk-management-[a-z]+|Token = "[0-9a-f]{{4}}') AND filename NOT IN (SELECT filename FROM reject)""",
)
def grep_store(spark, sf_dir):
    """Two patterns over an indexed store; files that cannot match are not opened."""
    path = scratch(spark)
    docs = fx.planted(spark, sf_dir).select("source_dir", "filename", F.col("text").alias("content"))
    docs.repartition(32, "filename").write.parquet(f"{path}/store")
    trigram_index.build_index(spark, f"{path}/store", f"{path}/index")
    patterns = ["risk-management-[a-z]+", 'Token = "[0-9a-f]{4}']
    return trigram_index.grep_store(spark, f"{path}/store", f"{path}/index", fx.reject_list(spark, sf_dir), patterns)
