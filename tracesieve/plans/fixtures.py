"""Inputs for the registered queries, derived from the given tables.

The tables hold no credentials, so a detector query on raw text would prove nothing. Secrets
are planted by an expression that means the same in Spark SQL and in ANSI SQL engines; it is
kept as text here and used on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.functions.text import once
from tracesieve.operators.joins import cut_lineage
from tracesieve.operators.literals import parse_secrets

_D = "md5(CAST(doc_id AS STRING))"
_M = "md5(text)"

# Suffix planted on a document, by doc_id % 20.
SUFFIXES = [
    f"'AKIA' || upper(substr({_D}, 1, 16))",
    f"'sk-' || {_D}",
    f"'sk-proj-' || {_D} || ' sk-ant-' || {_M}",
    f"'ghp_' || {_M} || 'abcd, gho_' || {_M} || 'wxyz'",
    f"'postgres://u:' || {_M} || '@h/db'",
    f"'https://me:' || substr({_M}, 1, 12) || '@host.example/x?y=1'",
    f"'eyJ' || {_M} || '.eyJ' || {_M} || '.' || {_M}",
    f"'npm_' || {_M} || 'abcd npm_' || {_M} || 'abcd'",
    f"{_M} || '.' || substr({_M}, 1, 16) || '.' || {_M}",
    f"'mongodb+srv://' || {_M}",
    f"'AIza' || {_M} || 'xyz'",
    f"'important-' || {_M}",
    "'risk-management-dashboard-view'",
    f"'pk-' || {_M}",
    f"'xoxb-1234567890-1234567890123-' || {_M}",
    f"'ya29.' || {_M}",
    f"'glpat-' || {_M}",
    f"'dckr_pat_' || {_M}",
]

PLANTED_TEXT = (
    "text || CASE doc_id % 20 "
    + " ".join(f"WHEN {i} THEN ' ' || {s}" for i, s in enumerate(SUFFIXES))
    + " ELSE '' END"
)

FILENAME = "'doc_' || CAST(doc_id AS STRING) || '.json'"

# Lines of an env file, by doc_id % 8; one value repeats in an eighth of them.
SECRET_LINE = f"""CASE doc_id % 8
  WHEN 0 THEN 'export API_KEY_' || CAST(doc_id AS STRING) || '="' || {_M} || '"'
  WHEN 1 THEN 'TOKEN=' || {_M}
  WHEN 2 THEN '  ' || {_M} || ' '
  WHEN 3 THEN 'abc=='
  WHEN 4 THEN 'ab'
  WHEN 5 THEN '   '
  WHEN 6 THEN 'export KEY=' || chr(39) || substr({_M}, 1, 12) || chr(39) || ' '
  ELSE 'NAME_' || CAST(doc_id AS STRING) || '=one value shared by many lines' END"""

TOKEN = 'token = "([0-9a-f]+)"'

DENY_NAME = "doc_[0-9]*9[05]\\.json"
DENY_CONTENT = "license"

# Scanner output lines from events. Every 25th is not a finding of the right form; errors,
# decoders, raw values and lines are sometimes missing, blank or of the wrong type.
SCAN_FILE = "'/data/redacted/user_' || CAST(user_id AS STRING) || '.json'"
_RAW = "substr(md5(CAST(event_id % 300 AS STRING)), 1, CAST(4 + event_id % 20 AS INT))"
SCAN_LINE = f"""CASE event_id % 25
  WHEN 3 THEN 'progress: ' || CAST(event_id AS STRING)
  WHEN 7 THEN '{{"DetectorName": "cut off'
  WHEN 11 THEN '{{"DetectorName": 5, "Raw": "x"}}'
  WHEN 13 THEN '{{"DetectorName": "two"}} {{"DetectorName": "values"}}'
  WHEN 17 THEN '{{"Raw": "no detector"}}'
  ELSE '  {{"DetectorName": "' || CASE WHEN event_id % 9 = 0 THEN upper(event_type) ELSE event_type END || '"'
    || CASE event_id % 4 WHEN 0 THEN ', "DecoderName": "PLAIN"'
         WHEN 1 THEN ', "DecoderName": "BASE64"' WHEN 2 THEN ', "DecoderName": 7' ELSE '' END
    || CASE event_id % 6 WHEN 0 THEN ', "Verified": true' WHEN 1 THEN ', "Verified": "true"'
         ELSE ', "Verified": false' END
    || CASE event_id % 5 WHEN 0 THEN ', "Raw": ""' WHEN 1 THEN ', "Raw": "npm_' || {_RAW} || '"'
         ELSE ', "Raw": "' || {_RAW} || '"' END
    || CASE event_id % 7 WHEN 0 THEN ', "ExtraData": {{"verification_error": "timeout"}}'
         WHEN 1 THEN ', "ExtraData": {{"verification_error": " ", "error": "hidden"}}'
         WHEN 2 THEN ', "ExtraData": {{"verification_error": "", "error": "late"}}'
         WHEN 3 THEN ', "ExtraData": {{"verificationError": 4}}'
         WHEN 4 THEN ', "ExtraData": null' ELSE '' END
    || ', "SourceMetadata": {{"Data": {{"Filesystem": {{"file": "'
    || CASE WHEN event_id % 10 = 0 THEN replace({SCAN_FILE}, '/data/', '/data/./') ELSE {SCAN_FILE} END
    || '"' || CASE WHEN event_id % 8 = 0 THEN '' WHEN event_id % 8 = 1 THEN ', "line": "12"'
         ELSE ', "line": ' || replace(replace(props, '{{"k": ', ''), '}}', '') END
    || '}}}}}}}}' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Text tables small enough to come as a few input splits are spread over the cores;
    larger ones keep the partitions of the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source_dir, filename, text`` with planted secrets."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id",
        "lang",
        "source AS source_dir",
        f"{FILENAME} AS filename",
        f"explode(array({PLANTED_TEXT})) AS text",
    )


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source_dir, filename, text`` as given."""
    return documents(spark, sf_dir).selectExpr(
        "doc_id", "source AS source_dir", f"{FILENAME} AS filename", "text"
    )


def json_string(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted documents as session files: JSON objects, JSON lines, a bare string, and some
    that are not JSON. One in three has its text twice."""
    docs = planted(spark, sf_dir).select("*", once(json_string(F.col("text"))).alias("_t"))
    content = F.expr(
        """CASE
        WHEN doc_id % 14 = 6 THEN '{"text":' || _t || '} trailing'
        WHEN doc_id % 14 = 13 THEN _t
        WHEN doc_id % 7 = 5 THEN '{"text":' || _t || '}\n\n{"n": 1.5, "tag": "clean"}\r\n'
        WHEN doc_id % 3 = 0 THEN '{"doc_id": ' || doc_id || ', "my text": [' || _t || ', ' || _t || ']}'
        ELSE '{"doc_id": ' || doc_id || ', "messages": [{"role": "user", "text": ' || _t || '}]}'
        END"""
    )
    kept = ["doc_id", "lang", "source_dir", "filename", "text"]
    return docs.select(*kept, once(content).alias("content"))


def token_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hex tokens that occur in documents, as literal secrets."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(
        F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("line"),
        F.col("doc_id").alias("line_no"),
    )
    return cut_lineage(parse_secrets(tokens))


def reject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the documents labelled toxic."""
    return table(spark, sf_dir, "labels").where("toxic = 1").selectExpr(f"{FILENAME} AS filename")


def previous_manifest(sessions: DataFrame) -> DataFrame:
    """The English and French sessions were collected before; the French ones have changed."""
    return sessions.where("lang IN ('en', 'fr')").selectExpr(
        "source_dir",
        "filename",
        "CASE WHEN lang = 'fr' THEN sha2(content || ' ', 256) ELSE sha2(content, 256) END"
        " AS source_hash",
    )


def scanner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"), "event_id")
    return events.selectExpr(f"{SCAN_LINE} AS value")


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per customer outside one market segment; the findings in the other files
    have no scanned source."""
    return table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").selectExpr(
        "'/data/redacted/user_' || CAST(c_custkey AS STRING) || '.json' AS file",
        "c_name AS content",
    )
