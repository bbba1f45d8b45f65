"""Registered queries: scanner findings from lines to blocking reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions.text import mask_secret
from tracesieve.operators import findings as fnd
from tracesieve.operators import rules
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans import scan
from tracesieve.plans.registry import query

_PUBLIC = ["detector", "decoder", "status", "line", "raw_sha256", "masked", "file"]


def _parsed(spark, sf_dir):
    return fnd.parse_findings(fx.scanner_lines(spark, sf_dir))


def _scan(spark, sf_dir):
    return scan.scan_lines(fx.scanned_files(spark, sf_dir), fx.scanner_lines(spark, sf_dir))


@query(
    "parse_findings",
    f"WITH {o.FINDINGS} SELECT detector, decoder, status, line, raw_sha256, masked, file FROM parsed",
)
def parse_findings(spark, sf_dir):
    return _parsed(spark, sf_dir).select(*_PUBLIC)


@query(
    "duplicate_keys",
    """SELECT event_id AS line, event_type AS detector, CASE WHEN event_id % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status,
      sha256(CAST(user_id AS STRING)) AS raw_sha256 FROM events WHERE event_id % 5 <> 0""",
)
def duplicate_keys(spark, sf_dir):
    """Scanner lines that name a field twice, at the top and further in: the last one counts. One line in
    five is cut off behind the repeated field."""
    line = """'{"DetectorName": "first", "Verified": ' || (event_id % 3 <> 0) || ', "Raw": "a", "DetectorName": "' || event_type
      || '", "Raw": "' || user_id || '", "SourceMetadata": {"Data": {"Filesystem": {"line": 1, "file": "f", "line": ' || event_id
      || '}}}, "Verified": ' || (event_id % 3 = 0) || CASE WHEN event_id % 5 = 0 THEN '' ELSE '}' END"""
    found = fnd.parse_findings(fx.table(spark, sf_dir, "events").selectExpr(f"{line} AS value"))
    return found.select("line", "detector", "status", "raw_sha256")


@query(
    "finding_status",
    """WITH e AS (SELECT event_id, event_id % 7 = 0 AS v,
      CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 'a' END AS a,
      CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(9) ELSE event_type END AS b FROM events)
    SELECT event_id, CASE WHEN v THEN 'verified'
      WHEN regexp_matches(coalesce(nullif(a, ''), nullif(b, ''), ''), '\\S') THEN 'unknown' ELSE 'unverified' END AS status FROM e""",
)
def finding_status(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_id % 7 = 0 AS v",
        "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 'a' END AS a",
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(9) ELSE event_type END AS b",
    )
    status = fnd.finding_status(F.col("v"), F.col("a"), F.col("b"))
    return rows.select("event_id", status.alias("status"))


_RAW = "CASE WHEN event_id % 11 = 0 THEN 'npm_' ELSE '' END || substr(md5(event_type || CAST(user_id AS STRING)), 1, CAST(event_id % 24 AS INT))"


@query(
    "mask_secret",
    f"WITH r AS (SELECT event_id, {_RAW} AS raw FROM events) SELECT event_id, {o.mask('raw')} AS masked, sha256(nullif(raw, '')) AS raw_sha256 FROM r",
)
def masks(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").selectExpr("event_id", f"{_RAW} AS raw")
    return rows.select(
        "event_id",
        mask_secret(F.col("raw")).alias("masked"),
        fnd.raw_sha256(F.col("raw")).alias("raw_sha256"),
    )


@query(
    "dedup_findings",
    f"WITH {o.FINDINGS}, {o.DEDUPED} SELECT * FROM deduped",
)
def dedup_findings(spark, sf_dir):
    return fnd.dedup_findings(_parsed(spark, sf_dir))


@query(
    "attach_source",
    f"""WITH {o.FINDINGS}, {o.FILES}
    SELECT replace(p.file, '/./', '/') AS file, detector, line, raw_sha256, masked FROM parsed p
    JOIN files f ON replace(p.file, '/./', '/') = f.file""",
)
def attach_source(spark, sf_dir):
    kept = fnd.attach_source(_parsed(spark, sf_dir), fx.scanned_files(spark, sf_dir))
    return kept.select("file", "detector", "line", "raw_sha256", "masked")


@query("order_findings", f"WITH {o.SCAN} SELECT file, detector, line, status, masked FROM known")
def order_findings(spark, sf_dir):
    found = _scan(spark, sf_dir).findings
    return fnd.order_findings(found).select("file", "detector", "line", "status", "masked")


@query("summarize_findings", f"WITH {o.SCAN}, {o.SUMMARY} SELECT * FROM summary")
def summarize_findings(spark, sf_dir):
    return fnd.summarize_findings(_scan(spark, sf_dir).findings)


@query("top_detectors", f"WITH {o.SCAN}, {o.TOP} SELECT file, detectors FROM top")
def top_detectors(spark, sf_dir):
    top = fnd.top_detectors(_scan(spark, sf_dir).findings)
    return top.select("file", F.array_join("top_detectors", ", ").alias("detectors"))


@query("scan_reports", f"WITH {o.SCAN}, {o.REPORTS} SELECT * FROM reports")
def scan_reports(spark, sf_dir):
    reports = _scan(spark, sf_dir).reports
    return (
        reports.withColumn("top_detectors", F.array_join("top_detectors", ", "))
        .withColumn("examples", F.array_join("examples", ", "))
    )


@query(
    "scan_totals",
    f"""WITH {o.SCAN}, {o.REPORTS} SELECT CAST(sum(findings) AS BIGINT) AS total_findings,
      CAST(sum(verified) AS BIGINT) AS verified_count, CAST(sum(unverified) AS BIGINT) AS unverified_count,
      CAST(sum(unknown) AS BIGINT) AS unknown_count, CAST(count(*) AS BIGINT) AS scanned_files FROM reports""",
)
def scan_totals(spark, sf_dir):
    return _scan(spark, sf_dir).totals


_EVIDENCE = """'verified=' || verified || ', unknown=' || unknown || ', unverified=' || unverified || ', detectors=' ||
      CASE WHEN top_detectors = '' THEN 'none' ELSE top_detectors END ||
      CASE WHEN examples = '' THEN '' ELSE ', examples=' || examples END"""


@query(
    "blocking_reasons",
    f"""WITH {o.SCAN}, {o.REPORTS} SELECT file, 'trufflehog-findings' AS reason, {_EVIDENCE} AS evidence,
      CASE WHEN verified > 0 OR unknown > 0 THEN 'yes' ELSE 'maybe' END AS missed_sensitive_data
    FROM reports WHERE findings > 0""",
)
def blocking_reasons(spark, sf_dir):
    return _scan(spark, sf_dir).blocking


@query(
    "report_evidence",
    f"WITH {o.SCAN}, {o.REPORTS} SELECT file, {_EVIDENCE} AS evidence FROM reports",
)
def report_evidence(spark, sf_dir):
    """Also for files without findings."""
    return _scan(spark, sf_dir).reports.select("file", fnd.evidence().alias("evidence"))


@query(
    "findings_by_file",
    f"""WITH {o.SCAN} SELECT regexp_extract(file, '[^/]+$', 0) AS basename, CAST(count(*) AS BIGINT) AS findings,
      CAST(count(DISTINCT detector) AS BIGINT) AS detectors FROM known GROUP BY 1""",
)
def findings_by_file(spark, sf_dir):
    keyed = fnd.findings_by_file(_scan(spark, sf_dir).findings)
    per_detector = keyed.groupBy("basename", "detector").agg(F.count("*").alias("n"))
    return per_detector.groupBy("basename").agg(
        F.sum("n").alias("findings"), F.count("*").alias("detectors")
    )


@query(
    "auto_reject",
    f"""WITH {o.SCAN}, {o.REPORTS}, {o.REJECT} SELECT filename FROM reject
    UNION SELECT regexp_extract(file, '[^/]+$', 0) FROM reports WHERE verified > 0""",
)
def auto_reject(spark, sf_dir):
    return fnd.auto_reject(fx.reject_list(spark, sf_dir), _scan(spark, sf_dir).reports)


@query(
    "finding_details",
    f"""WITH {o.SCAN} SELECT file, '[' || upper(status) || '] ' || detector ||
      CASE WHEN line IS NULL THEN '' ELSE ' L' || line END || ': ' || masked AS detail FROM known""",
)
def finding_details(spark, sf_dir):
    return fnd.finding_details(_scan(spark, sf_dir).findings)


@query(
    "only_verified",
    f"WITH {o.SCAN} SELECT file, detector, line, masked FROM known WHERE status = 'verified'",
)
def only_verified(spark, sf_dir):
    found = rules.only_verified(_scan(spark, sf_dir).findings)
    return found.select("file", "detector", "line", "masked")


@query(
    "scan_after_collect",
    f"""WITH {o.PLANTED}, {o.detect("planted")}, {o.matches("filename, text")},
    known AS (SELECT DISTINCT filename AS file, detector, 'unverified' AS status, {o.mask("match")} AS masked, sha256(match) AS raw_sha256,
      length(before) - length(replace(before, chr(10), '')) + 1 AS line
      FROM (SELECT *, left(text, strpos(text, match)) AS before FROM matches)),
    {o.SUMMARY} SELECT filename AS file, sha256(text) AS redacted_hash, coalesce(findings, 0) AS findings,
      coalesce(unverified, 0) AS unverified FROM planted LEFT JOIN summary ON file = filename""",
)
def scan_after_collect(spark, sf_dir):
    """The built-in residual scan in the place of an external scanner."""
    docs = fx.planted(spark, sf_dir).selectExpr("filename AS file", "text AS content")
    found = fnd.residual_scan(docs, text="content")
    reports = scan.assess(docs, found).reports
    return reports.select("file", "redacted_hash", "findings", "unverified")
