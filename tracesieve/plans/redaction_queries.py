"""Registered queries: detectors, literals, counts, residual scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions.text import count_occurrences, once, placeholder
from tracesieve.operators import findings as fnd
from tracesieve.operators import literals as lit
from tracesieve.operators import redaction as red
from tracesieve.operators.joins import cut_lineage
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans.registry import query

KEYS = ["doc_id"]


@query(
    "redact_patterns",
    f"""WITH {o.PLANTED}, {o.detect("planted")}, {o.matches("doc_id")}
    SELECT doc_id, rule, detector, severity, sha256(match) AS match_sha256, {o.mask("match")} AS masked,
      CAST(count(*) AS BIGINT) AS count
    FROM matches GROUP BY doc_id, rule, detector, severity, match""",
)
def redact_patterns(spark, sf_dir):
    return red.pattern_matches(fx.planted(spark, sf_dir), "text", KEYS)


@query(
    "redact_patterns_text",
    f"""WITH {o.PLANTED}, {o.detect("planted")}
    SELECT doc_id, sha256(t) AS redacted_sha, CAST(length(t) AS BIGINT) AS redacted_length,
      CAST({o.finding_total()} AS BIGINT) AS findings, CAST({o.match_total()} AS BIGINT) AS found
    FROM detected""",
)
def redact_patterns_text(spark, sf_dir):
    done = red.redact_patterns(fx.planted(spark, sf_dir))
    total = F.aggregate("findings", F.lit(0).cast("bigint"), lambda n, f: n + f["count"])
    return done.select(
        "doc_id",
        F.sha2("redacted", 256).alias("redacted_sha"),
        F.length("redacted").cast("bigint").alias("redacted_length"),
        F.size("findings").cast("bigint").alias("findings"),
        total.alias("found"),
    )


@query(
    "redacted_text",
    f"""WITH {o.PLANTED}, {o.detect("planted")} SELECT doc_id, sha256(t) AS redacted_sha FROM detected""",
)
def redacted_text(spark, sf_dir):
    docs = fx.planted(spark, sf_dir)
    return docs.select("doc_id", F.sha2(red.redacted_text(F.col("text")), 256).alias("redacted_sha"))


DETECTOR_COUNTS = f"""WITH {o.PLANTED}, {o.detect("planted")}, {o.matches("doc_id")}
    SELECT detector, severity, CAST(count(DISTINCT doc_id) AS BIGINT) AS sessions,
      CAST(count(*) AS BIGINT) AS matches FROM matches GROUP BY detector, severity"""


@query("detector_counts", DETECTOR_COUNTS)
def detector_counts(spark, sf_dir):
    """Sessions and matches per detector: two aggregations, each combining before it
    shuffles, instead of a distinct count over all matches."""
    found = red.pattern_matches(fx.planted(spark, sf_dir), "text", KEYS)
    per_session = found.groupBy("detector", "severity", *KEYS).agg(F.sum("count").alias("n"))
    return per_session.groupBy("detector", "severity").agg(
        F.count("*").alias("sessions"), F.sum("n").alias("matches")
    )


_LINES = f"lines AS (SELECT doc_id, {fx.SECRET_LINE} AS line FROM documents)"
_WORDS = o.quoted(" ".join(dict.fromkeys(d.replacement for d in lit.DETECTORS)))
_ASSIGNED = r"""regexp_extract(trim(line), '(?:export\s+)?\w+=["'']?(.+?)["'']?\s*$', 1)"""
_VALUES = f"""vals AS (SELECT doc_id, trim(line) AS line, CASE WHEN length({_ASSIGNED}) > 2 THEN {_ASSIGNED}
      WHEN position('=' IN line) = 0 AND length(trim(line)) > 3 THEN trim(line) END AS value
    FROM lines WHERE trim(line) <> ''),
    usable AS (SELECT *, value IS NOT NULL AND position(value IN {_WORDS}) = 0 AS ok FROM vals)"""
_SECRETS = """parsed AS (SELECT left(min_by(line, doc_id), 50) AS name, value,
      '[REDACTED:' || left(sha256(value), 8) || ']' AS replacement FROM usable WHERE ok GROUP BY value)"""


def _secret_lines(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.selectExpr(f"{fx.SECRET_LINE} AS line", "doc_id AS line_no")


@query("parse_secrets", f"WITH {_LINES}, {_VALUES}, {_SECRETS} SELECT * FROM parsed")
def parse_secrets(spark, sf_dir):
    return lit.parse_secrets(_secret_lines(spark, sf_dir))


@query(
    "ignored_secret_lines",
    f"WITH {_LINES}, {_VALUES} SELECT doc_id AS line_no, trim(line) AS line FROM usable WHERE NOT coalesce(ok, false)",
)
def ignored_secret_lines(spark, sf_dir):
    ignored = lit.ignored_lines(_secret_lines(spark, sf_dir))
    return ignored.select("line_no", F.trim("line").alias("line"))


@query(
    "secrets_count",
    f"WITH {_LINES}, {_VALUES}, {_SECRETS} SELECT CAST(count(*) AS BIGINT) AS secrets_count FROM parsed",
)
def secrets_count(spark, sf_dir):
    return lit.secrets_count(lit.parse_secrets(_secret_lines(spark, sf_dir)))


@query(
    "placeholder",
    "SELECT doc_id, '[REDACTED:' || left(sha256(text), 8) || ']' AS placeholder FROM documents",
)
def secret_placeholder(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", placeholder(F.col("text")).alias("placeholder"))


@query(
    "count_occurrences",
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS BIGINT) AS an,
      CAST((length(text) - length(replace(text, left(text, 3), ''))) // length(left(text, 3)) AS BIGINT) AS start,
      CAST(0 AS BIGINT) AS nothing FROM documents""",
)
def occurrences(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.select(
        "doc_id",
        count_occurrences(text, F.lit("an")).alias("an"),
        count_occurrences(text, F.left(text, F.lit(3))).alias("start"),
        count_occurrences(text, F.lit("")).alias("nothing"),
    )


_FOLD = """list_reduce(list_filter(secrets, lambda s: contains(text, s.v)),
      lambda acc, s: {'v': replace(acc.v, s.v, s.r), 'r': ''}, {'v': text, 'r': ''}).v"""
_LITERAL_COUNTS = """CAST(len(list_filter(secrets, lambda s: contains(text, s.v))) AS BIGINT) AS secrets_found,
      CAST(coalesce(list_sum(list_transform(secrets, lambda s: (length(text) - length(replace(text, s.v, ''))) // length(s.v))), 0) AS BIGINT) AS found"""
LITERALS = f"""WITH {o.TOKENS}, {o.SECRET_LIST}
    SELECT doc_id, sha256({_FOLD}) AS redacted_sha, {_LITERAL_COUNTS} FROM documents, secret_list"""


def _literal_result(done):
    total = F.aggregate("findings", F.lit(0).cast("bigint"), lambda n, f: n + f["count"])
    return done.select(
        "doc_id",
        F.sha2("redacted", 256).alias("redacted_sha"),
        F.size("findings").cast("bigint").alias("secrets_found"),
        total.alias("found"),
    )


@query("redact_literals", LITERALS)
def redact_literals(spark, sf_dir):
    secrets = fx.token_secrets(spark, sf_dir)
    return _literal_result(lit.redact_literals(fx.plain(spark, sf_dir), secrets, keys=KEYS))


@query("redact_literals_joined", LITERALS)
def redact_literals_joined(spark, sf_dir):
    """The form for any number of secrets: candidates by hash join."""
    secrets = fx.token_secrets(spark, sf_dir)
    docs = fx.plain(spark, sf_dir)
    return _literal_result(lit.redact_literals(docs, secrets, keys=KEYS, inline=0, shared=0))


_HEX = "substr(sha256(md5(text)), 1, 4)"


@query(
    "literal_inside_placeholder",
    f"""WITH vals AS (SELECT md5(text) AS v FROM documents WHERE doc_id % 5 = 0 UNION SELECT {_HEX} FROM documents WHERE doc_id % 5 = 0),
    -- Each secret first becomes one character of its own, so that no placeholder is searched.
    marks AS (SELECT v, chr(CAST(983040 + row_number() OVER (ORDER BY v) AS INT)) AS c FROM vals),
    secret_list AS (SELECT list({{'v': v, 'c': c, 'r': '[REDACTED:' || left(sha256(v), 8) || ']'}} ORDER BY length(v) DESC, v) AS secrets FROM marks),
    texts AS (SELECT doc_id, text || ' ' || md5(text) || ' ' || {_HEX} AS text, secrets FROM documents, secret_list),
    own AS (SELECT doc_id, text, list_filter(secrets, lambda s: contains(text, s.v)) AS secrets FROM texts),
    cut AS (SELECT *, list_reduce(secrets, lambda acc, s: {{'v': replace(acc.v, s.v, s.c), 'c': '', 'r': ''}}, {{'v': text, 'c': '', 'r': ''}}).v AS t FROM own)
    SELECT doc_id, sha256(list_reduce(secrets, lambda acc, s: {{'v': replace(acc.v, s.c, s.r), 'c': '', 'r': ''}}, {{'v': t, 'c': '', 'r': ''}}).v) AS redacted_sha,
      CAST(len(list_filter(secrets, lambda s: contains(t, s.c))) AS BIGINT) AS secrets_found,
      CAST(coalesce(list_sum(list_transform(secrets, lambda s: length(t) - length(replace(t, s.c, '')))), 0) AS BIGINT) AS found FROM cut""",
)
def literal_inside_placeholder(spark, sf_dir):
    """Secrets that are part of other secrets' placeholders: what was put in is not rewritten."""
    docs = fx.documents(spark, sf_dir)
    short = F.left(F.sha2(F.md5("text"), 256), F.lit(4))
    values = docs.where("doc_id % 5 = 0").select(F.explode(F.array(F.md5("text"), short)).alias("value")).distinct()
    texts = docs.select("doc_id", F.concat_ws(" ", "text", F.md5("text"), short).alias("text"))
    secrets = cut_lineage(values.withColumn("replacement", placeholder(F.col("value"))))
    return _literal_result(lit.redact_literals(texts, secrets, keys=KEYS))


@query(
    "redact_text",
    f"""WITH {o.PLANTED}, {o.TOKENS}, {o.SECRET_LIST},
    lit AS (SELECT doc_id, text AS before, {_FOLD} AS text, secrets FROM planted, secret_list),
    {o.detect("lit")}
    SELECT doc_id, sha256(t) AS redacted_sha,
      CAST(len(list_filter(secrets, lambda s: contains(before, s.v))) + {o.finding_total()} AS BIGINT) AS findings
    FROM detected""",
)
def redact_text(spark, sf_dir):
    secrets = fx.token_secrets(spark, sf_dir)
    done = lit.redact_text(fx.planted(spark, sf_dir), secrets, keys=KEYS)
    return done.select(
        "doc_id",
        F.sha2("redacted", 256).alias("redacted_sha"),
        F.size("findings").cast("bigint").alias("findings"),
    )


@query(
    "redact_email",
    f"""SELECT doc_id, sha256(regexp_replace(text, {o.quoted(red.EMAIL)}, '[REDACTED:EMAIL]', 'g')) AS redacted_sha,
      CAST(len(regexp_extract_all(text, {o.quoted(red.EMAIL)})) AS BIGINT) AS emails FROM documents""",
)
def redact_email(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", "text", once(red.redact_email(F.col("text"))).alias("redacted")
    )
    return docs.select(
        "doc_id",
        F.sha2("redacted", 256).alias("redacted_sha"),
        count_occurrences(F.col("redacted"), F.lit("[REDACTED:EMAIL]")).alias("emails"),
    )


_KV = o.quoted(red.KEY_VALUE)


@query(
    "redact_key_value",
    f"""SELECT doc_id, sha256(regexp_replace(text, {_KV}, '\\1[REDACTED:KEY_VALUE]', 'g')) AS redacted_sha,
      CAST(len(regexp_extract_all(text, {_KV})) AS BIGINT) AS pairs FROM documents""",
)
def redact_key_value(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", once(red.redact_key_value(F.col("text"))).alias("redacted")
    )
    return docs.select(
        "doc_id",
        F.sha2("redacted", 256).alias("redacted_sha"),
        count_occurrences(F.col("redacted"), F.lit("[REDACTED:KEY_VALUE]")).alias("pairs"),
    )


@query(
    "re_redact",
    f"""WITH found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[a-z]{{14,}}')) AS v FROM documents),
    lists AS (SELECT doc_id, list({{'v': v, 'r': '[REDACTED:' || left(sha256(v), 8) || ']'}} ORDER BY length(v) DESC, v) AS secrets
      FROM found GROUP BY doc_id)
    SELECT d.doc_id, sha256(CASE WHEN secrets IS NULL THEN text ELSE {_FOLD} END) AS redacted_sha
    FROM documents d LEFT JOIN lists l USING (doc_id)""",
)
def re_redact(spark, sf_dir):
    """Long words stand in for the raw secrets a scanner found."""
    docs = fx.plain(spark, sf_dir)
    words = F.regexp_extract_all("text", F.lit("[a-z]{14,}"), F.lit(0))
    raw = docs.select("doc_id", F.explode(words).alias("raw"))
    done = lit.re_redact(docs, raw, text="text", keys=KEYS)
    return done.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha"))


@query(
    "residual_scan",
    f"""WITH {o.PLANTED}, {o.detect("planted")}, {o.matches("filename, text")}
    SELECT filename AS file, detector, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS BIGINT) AS line,
      'unverified' AS status, sha256(match) AS raw_sha256, {o.mask("match")} AS masked
    FROM (SELECT *, left(text, strpos(text, match)) AS before FROM matches)""",
)
def residual_scan(spark, sf_dir):
    """Before redaction, so that there is something to find."""
    found = fnd.residual_scan(fx.planted(spark, sf_dir), "filename")
    return found.select("file", "detector", "line", "status", "raw_sha256", "masked")


@query(
    "residual_after_redaction",
    f"""WITH {o.PLANTED}, {o.detect("planted")}, again AS (SELECT doc_id, t AS text FROM detected),
    {o.detect("again", "second")}
    SELECT CAST(count(*) AS BIGINT) AS sessions, CAST(sum({o.match_total()}) AS BIGINT) AS findings FROM second""",
)
def residual_after_redaction(spark, sf_dir):
    docs = fx.planted(spark, sf_dir)
    text = docs.select("filename", once(red.redacted_text(F.col("text"))).alias("text"))
    found = fnd.residual_scan(text, "filename").agg(F.count("*").alias("findings"))
    return docs.agg(F.count("*").alias("sessions")).select(
        "sessions", found.scalar().alias("findings")
    )
