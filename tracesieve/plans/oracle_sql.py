"""SQL building blocks for the comparison queries."""

from __future__ import annotations

from tracesieve.functions.detectors import DETECTORS
from tracesieve.plans.fixtures import FILENAME, PLANTED_TEXT, SCAN_LINE, TOKEN

PLANTED = (
    f"planted AS (SELECT doc_id, lang, source AS source_dir, {FILENAME} AS filename, "
    f"{PLANTED_TEXT} AS text FROM documents)"
)
REJECT = f"reject AS (SELECT DISTINCT {FILENAME} AS filename FROM labels WHERE toxic = 1)"

TOKENS = (
    "tokens AS (SELECT DISTINCT unnest(regexp_extract_all(text, "
    f"'{TOKEN}', 1)) AS value FROM documents)"
)
SECRET_LIST = (
    "secret_list AS (SELECT coalesce(list({'v': value, 'r': '[REDACTED:' || left(sha256(value), 8) || ']'} "
    "ORDER BY length(value) DESC, value), CAST([] AS STRUCT(v VARCHAR, r VARCHAR)[])) AS secrets FROM tokens)"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def detect(source: str, name: str = "detected", text: str = "text") -> str:
    """CTEs that apply all detectors in order to ``text`` of ``source``. The last, ``name``,
    has the rewritten text as ``t`` and the matches of detector i as ``m<i>``."""
    parts = [f"{name}_0 AS (SELECT *, {text} AS t FROM {source})"]
    for d in DETECTORS:
        rx, new = quoted(d.regex), quoted(d.replacement)
        parts.append(
            f"{name}_{d.index + 1} AS (SELECT * EXCLUDE (t), regexp_extract_all(t, {rx}) "
            f"AS m{d.index}, regexp_replace(t, {rx}, {new}, 'g') AS t "
            f"FROM {name}_{d.index})"
        )
    parts.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{len(DETECTORS)})")
    return ",\n".join(parts)


def matches(keys: str, source: str = "detected", name: str = "matches") -> str:
    """CTE with one row per single match: keys, rule, detector, severity, match."""
    rows = [
        f"SELECT {keys}, {d.index} AS rule, '{d.kind}' AS detector, '{d.severity}' AS severity, "
        f"unnest(m{d.index}) AS match FROM {source}"
        for d in DETECTORS
    ]
    return f"{name} AS (" + "\nUNION ALL ".join(rows) + ")"


def match_total(alias: str = "") -> str:
    return " + ".join(f"len({alias}m{d.index})" for d in DETECTORS)


def finding_total(alias: str = "") -> str:
    return " + ".join(f"len(list_distinct({alias}m{d.index}))" for d in DETECTORS)


def mask(raw: str) -> str:
    head = f"CASE WHEN {raw} LIKE 'npm\\_%' ESCAPE '\\' THEN least(8, length({raw}) - 4) ELSE 4 END"
    return (
        f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN '[REDACTED]' WHEN length({raw}) <= 8 THEN '***' "
        f"ELSE left({raw}, {head}) || '***' || "
        f"right({raw}, least(4, length({raw}) - ({head}))) END"
    )


# Scanner lines to findings, with the JSON functions of the comparison engine.
_FS = "$.SourceMetadata.Data.Filesystem"
FINDINGS = f"""lines AS (SELECT trim({SCAN_LINE}) AS line FROM events),
docs AS (SELECT CAST(line AS JSON) AS j FROM lines WHERE line LIKE '{{%' AND json_valid(line)),
typed AS (SELECT
    json_extract_string(j, '$.DetectorName') AS detector,
    CASE WHEN json_type(j, '$.DecoderName') = 'VARCHAR' THEN json_extract_string(j, '$.DecoderName') END AS decoder,
    json_type(j, '$.Verified') = 'BOOLEAN' AND json_extract_string(j, '$.Verified') = 'true' AS verified,
    CASE WHEN json_type(j, '$.Raw') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.Raw'), '') END AS raw,
    coalesce(
      CASE WHEN json_type(j, '$.ExtraData.verification_error') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.ExtraData.verification_error'), '') END,
      CASE WHEN json_type(j, '$.ExtraData.verificationError') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.ExtraData.verificationError'), '') END,
      CASE WHEN json_type(j, '$.ExtraData.error') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.ExtraData.error'), '') END) AS error,
    coalesce(json_extract_string(j, '{_FS}.file'), '') AS file,
    CASE WHEN json_type(j, '{_FS}.line') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '{_FS}.line') AS BIGINT) END AS line
  FROM docs WHERE json_type(j, '$.DetectorName') = 'VARCHAR'),
parsed AS (SELECT detector, decoder,
    CASE WHEN verified THEN 'verified' WHEN trim(coalesce(error, '')) <> '' THEN 'unknown' ELSE 'unverified' END AS status,
    line, sha256(raw) AS raw_sha256, {mask("raw")} AS masked, file, raw
  FROM typed)"""

DEDUPED = "deduped AS (SELECT DISTINCT replace(file, '/./', '/') AS file, detector, decoder, status, line, raw_sha256, masked FROM parsed)"

FILES = (
    "files AS (SELECT '/data/redacted/user_' || CAST(c_custkey AS STRING) || '.json' AS file, "
    "c_name AS content FROM customer WHERE c_mktsegment <> 'BUILDING')"
)
KNOWN = """known AS (SELECT DISTINCT replace(p.file, '/./', '/') AS file, detector, decoder, status, line, raw_sha256, masked
  FROM parsed p JOIN files f ON replace(p.file, '/./', '/') = f.file)"""

SCAN = f"{FINDINGS},\n{FILES},\n{KNOWN}"

SUMMARY = """summary AS (SELECT file, count(*) AS findings,
    count(*) FILTER (status = 'verified') AS verified,
    count(*) FILTER (status = 'unverified') AS unverified,
    count(*) FILTER (status = 'unknown') AS unknown FROM known GROUP BY file)"""
TOP = """top AS (SELECT file, string_agg(detector, ', ' ORDER BY rank) AS detectors FROM (
    SELECT file, detector, row_number() OVER (PARTITION BY file ORDER BY n DESC, lower(detector), detector DESC) AS rank
    FROM (SELECT file, detector, count(*) AS n FROM known GROUP BY file, detector)) WHERE rank <= 8 GROUP BY file)"""
EXAMPLES = """examples AS (SELECT file, string_agg(detector || ':' || masked, ', ' ORDER BY rank) AS examples FROM (
    SELECT file, detector, masked, row_number() OVER (PARTITION BY file ORDER BY line NULLS LAST, lower(detector),
      detector DESC, status, masked, raw_sha256 NULLS FIRST) AS rank FROM known) WHERE rank <= 5 GROUP BY file)"""
REPORTS = f"""{SUMMARY},
{TOP},
{EXAMPLES},
reports AS (SELECT f.file, sha256(f.content) AS redacted_hash, coalesce(findings, 0) AS findings,
    coalesce(verified, 0) AS verified, coalesce(unverified, 0) AS unverified, coalesce(unknown, 0) AS unknown,
    coalesce(detectors, '') AS top_detectors, coalesce(examples, '') AS examples
  FROM files f LEFT JOIN summary USING (file) LEFT JOIN top USING (file) LEFT JOIN examples USING (file))"""
