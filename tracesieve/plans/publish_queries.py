"""Registered queries: upload plan, publish log, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.operators import publishing as pub
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans.registry import query
from tracesieve.sources.lists import image_assets

_SIZED = f"""{o.PLANTED}, {o.REJECT},
    sized AS (SELECT lang, source_dir, filename, CAST(strlen(text) AS BIGINT) AS size_bytes FROM planted),
    log AS (SELECT source_dir, filename FROM planted WHERE lang = 'de')"""


def _sized(spark, sf_dir):
    docs = fx.planted(spark, sf_dir)
    return docs.select(
        "lang",
        "source_dir",
        "filename",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )


def _log(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").where("lang = 'de'")
    return docs.selectExpr(
        "source AS source_dir",
        f"{fx.FILENAME} AS filename",
        "timestamp_micros(1700000000000000) AS uploaded_at",
        "0L AS size_bytes",
    )


@query(
    "upload_plan",
    f"""WITH {_SIZED} SELECT s.filename, size_bytes, CASE WHEN l.filename IS NULL THEN 'pending' ELSE 'uploaded' END AS status
    FROM sized s ANTI JOIN reject USING (filename) LEFT JOIN log l USING (source_dir, filename)""",
)
def upload_plan(spark, sf_dir):
    reject = fx.reject_list(spark, sf_dir)
    plan = pub.upload_plan(_sized(spark, sf_dir), reject, _log(spark, sf_dir))
    return plan.select("filename", "size_bytes", "status")


@query(
    "publishable",
    f"""WITH {_SIZED} SELECT filename FROM sized WHERE filename NOT IN (SELECT filename FROM reject)
    AND NOT regexp_matches(filename, '{fx.DENY_NAME}')""",
)
def publishable(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    denied = sized.where(F.col("filename").rlike(fx.DENY_NAME))
    return pub.publishable(sized, fx.reject_list(spark, sf_dir), denied).select("filename")


@query(
    "record_uploads",
    f"""WITH {_SIZED}, names AS (SELECT source_dir, filename, true AS before FROM log
      UNION ALL SELECT source_dir, filename, false FROM sized WHERE lang = 'es')
    SELECT n.filename, before, CASE WHEN s.source_dir LIKE '%1' THEN 0 ELSE size_bytes END AS size_bytes
    FROM names n JOIN sized s USING (source_dir, filename)""",
)
def record_uploads(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    left = sized.where("source_dir NOT LIKE '%1'")
    log = pub.record_uploads(_log(spark, sf_dir), sized.where("lang = 'es'"), left)
    return log.select(
        "filename", (F.unix_micros("uploaded_at") == 1700000000000000).alias("before"), "size_bytes"
    )


@query(
    "workspace_stats",
    f"""WITH {_SIZED}, m AS (SELECT s.*, l.filename IS NOT NULL AS done, r.filename IS NOT NULL AS rej FROM sized s
      LEFT JOIN log l USING (source_dir, filename) LEFT JOIN reject r ON s.filename = r.filename)
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (done) AS BIGINT) AS uploaded,
      CAST(count(*) FILTER (NOT done AND NOT rej) AS BIGINT) AS pending,
      CAST((SELECT count(*) FROM reject) AS BIGINT) AS rejected,
      CAST(sum(size_bytes) FILTER (NOT done AND NOT rej) AS BIGINT) AS total_size,
      round(sum(size_bytes) FILTER (NOT done AND NOT rej) / 1024.0, 1) AS pending_kb FROM m""",
)
def workspace_stats(spark, sf_dir):
    reject = fx.reject_list(spark, sf_dir)
    return pub.workspace_stats(_sized(spark, sf_dir), reject, _log(spark, sf_dir))


@query(
    "dataset_stats",
    f"""WITH {_SIZED} SELECT CAST(count(*) AS BIGINT) AS num_examples, CAST(sum(size_bytes) AS BIGINT) AS num_bytes,
      round(sum(size_bytes) / 1024.0, 1) AS total_kb FROM sized""",
)
def dataset_stats(spark, sf_dir):
    return pub.dataset_stats(_sized(spark, sf_dir))


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'uploaded' END"


def _attempts(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr(
        "event_type AS source_dir",
        "'e_' || CAST(event_id AS STRING) || '.json' AS filename",
        f"{_STATUS} AS status",
    )


@query(
    "upload_result",
    f"""WITH a AS (SELECT {_STATUS} AS status FROM events)
    SELECT CAST(count(*) FILTER (status = 'uploaded') AS BIGINT) AS uploaded,
      CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped,
      CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
      count(*) FILTER (status = 'failed') = 0 AS success FROM a""",
)
def upload_result(spark, sf_dir):
    return pub.upload_result(_attempts(spark, sf_dir))


@query(
    "failed_uploads",
    f"SELECT event_type AS source_dir, 'e_' || event_id || '.json' AS filename FROM events WHERE {_STATUS} = 'failed'",
)
def failed_uploads(spark, sf_dir):
    return pub.failed_uploads(_attempts(spark, sf_dir))


_IMAGE_NAME = """'img_' || CAST(event_id AS STRING) || CASE event_id % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp'
    WHEN 3 THEN '.png.txt' WHEN 4 THEN '.Svg' WHEN 5 THEN '.bmp' ELSE '.jpeg' END"""


@query(
    "image_assets",
    f"""WITH n AS (SELECT {_IMAGE_NAME} AS filename FROM events)
    SELECT filename FROM n WHERE regexp_matches(filename, '(?i)\\.(png|jpg|jpeg|gif|webp|svg)$')""",
)
def images(spark, sf_dir):
    names = fx.table(spark, sf_dir, "events").selectExpr(f"{_IMAGE_NAME} AS filename")
    return image_assets(names)
