"""Registered queries: rules, JSON redaction, collect, manifest, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions.detectors import EMAIL, KEY_VALUE
from tracesieve.functions.json_tree import parsed
from tracesieve.functions.text import once
from tracesieve.operators import hashing
from tracesieve.operators import json_redaction as jr
from tracesieve.operators import manifest as man
from tracesieve.operators import rules
from tracesieve.plans import collect as col
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans.registry import query

KEYS = ["filename"]

# The session texts of fixtures.json_sessions, and what is left of them after parsing.
_JSON = """CASE
    WHEN doc_id % 14 = 6 THEN '{"text":' || js || '} trailing'
    WHEN doc_id % 14 = 13 THEN js
    WHEN doc_id % 7 = 5 THEN '{"text":' || js || '}' || chr(10) || chr(10) || '{"n": 1.5, "tag": "clean"}' || chr(13) || chr(10)
    WHEN doc_id % 3 = 0 THEN '{"doc_id": ' || doc_id || ', "my text": [' || js || ', ' || js || ']}'
    ELSE '{"doc_id": ' || doc_id || ', "messages": [{"role": "user", "text": ' || js || '}]}' END"""
_COMPACT = """CASE
    WHEN doc_id % 14 = 6 THEN NULL
    WHEN doc_id % 14 = 13 THEN {js}
    WHEN doc_id % 7 = 5 THEN '{{"lines":[{{"text":' || {js} || '}},{{"n":1.5,"tag":"clean"}}]}}'
    WHEN doc_id % 3 = 0 THEN '{{"doc_id":' || doc_id || ',"my text":[' || {js} || ',' || {js} || ']}}'
    ELSE '{{"doc_id":' || doc_id || ',"messages":[{{"role":"user","text":' || {js} || '}}]}}' END"""
_TWICE = "(doc_id % 14 <> 6 AND doc_id % 14 <> 13 AND doc_id % 7 <> 5 AND doc_id % 3 = 0)"
SESSIONS = f"""{o.PLANTED},
    escaped AS (SELECT *, CAST(to_json(text) AS VARCHAR) AS js FROM planted),
    sessions AS (SELECT doc_id, lang, source_dir, filename, text, {_JSON} AS content,
      {_COMPACT.format(js="js")} AS compact FROM escaped)"""


def _redacted(source: str) -> str:
    """CTE ``redacted``: sessions of ``source`` with their redacted compact JSON and counts."""
    return f"""{o.detect(source)},
    redacted AS (SELECT * EXCLUDE (t), {_COMPACT.format(js="CAST(to_json(t) AS VARCHAR)")} AS redacted,
      CAST(CASE WHEN {o.match_total()} = 0 THEN 0 WHEN {_TWICE} THEN 2 ELSE 1 END AS BIGINT) AS redactions_count,
      CAST(({o.match_total()}) * CASE WHEN {_TWICE} THEN 2 ELSE 1 END AS BIGINT) AS match_count
      FROM detected)"""


@query(
    "redact_object",
    f"""WITH {SESSIONS}, {_redacted("sessions")}
    SELECT filename, sha256(redacted) AS redacted_hash,
      CASE WHEN compact IS NOT NULL THEN redactions_count END AS redactions_count,
      CASE WHEN compact IS NOT NULL THEN match_count END AS match_count FROM redacted""",
)
def redact_object(spark, sf_dir):
    done = jr.redact_object(fx.json_sessions(spark, sf_dir), keys=KEYS)
    return done.select(
        "filename",
        F.sha2("redacted", 256).alias("redacted_hash"),
        "redactions_count",
        "match_count",
    )


@query(
    "json_leaves",
    f"""WITH {SESSIONS}, leaf AS (
      SELECT filename, '$' AS path, 0 AS leaf, text AS value FROM sessions WHERE doc_id % 14 = 13
      UNION ALL SELECT filename, '$.lines[0].text', 0, text FROM sessions WHERE doc_id % 7 = 5
      UNION ALL SELECT filename, '$.lines[1].tag', 1, 'clean' FROM sessions WHERE doc_id % 7 = 5
      UNION ALL SELECT filename, '$["my text"][0]', 0, text FROM sessions WHERE {_TWICE}
      UNION ALL SELECT filename, '$["my text"][1]', 1, text FROM sessions WHERE {_TWICE}
      UNION ALL SELECT filename, '$.messages[0].role', 0, 'user' FROM sessions
        WHERE doc_id % 14 NOT IN (6, 13) AND doc_id % 7 <> 5 AND doc_id % 3 <> 0
      UNION ALL SELECT filename, '$.messages[0].text', 1, text FROM sessions
        WHERE doc_id % 14 NOT IN (6, 13) AND doc_id % 7 <> 5 AND doc_id % 3 <> 0)
    SELECT filename, path, leaf, sha256(value) AS value_sha FROM leaf""",
)
def json_leaves(spark, sf_dir):
    leaves = jr.json_leaves(fx.json_sessions(spark, sf_dir), "content", KEYS)
    return leaves.select("filename", "path", "leaf", F.sha2("value", 256).alias("value_sha"))


@query(
    "leaf_findings",
    f"""WITH {SESSIONS}, twice AS (
      SELECT doc_id, filename, text, '$' AS path FROM sessions WHERE doc_id % 14 = 13
      UNION ALL SELECT doc_id, filename, text, '$.lines[0].text' FROM sessions WHERE doc_id % 7 = 5
      UNION ALL SELECT doc_id, filename, text, '$["my text"][' || i || ']' FROM sessions, (SELECT unnest([0, 1]) AS i) WHERE {_TWICE}
      UNION ALL SELECT doc_id, filename, text, '$.messages[0].text' FROM sessions
        WHERE doc_id % 14 NOT IN (6, 13) AND doc_id % 7 <> 5 AND doc_id % 3 <> 0),
    {o.detect("twice")}, {o.matches("filename, path")},
    per AS (SELECT filename, path, rule, detector, severity, match, count(*) AS n FROM matches GROUP BY ALL)
    SELECT filename, path, detector, severity, '[REDACTED:' || detector || ']' AS replacement, CAST(n AS BIGINT) AS count FROM per""",
)
def leaf_findings(spark, sf_dir):
    done = jr.redact_object(fx.json_sessions(spark, sf_dir), keys=KEYS)
    return jr.leaf_findings(done, KEYS)


# Images of every length around both thresholds; the second is not marked as an image.
_IMAGE = "'data:image/png;base64,' || left(repeat(md5(text), 12), 60 + CAST(doc_id % 240 AS INT))"
_BLOB = "left(repeat(md5(text), 12), 200 + CAST(doc_id % 120 AS INT))"


def _image_sessions(spark, sf_dir):
    docs = fx.plain(spark, sf_dir)
    return docs.select(
        "filename",
        F.expr(
            f"""'{{"shot": "' || {_IMAGE} || '", "blob": {{"mimeType": "' ||
            CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'text/plain' END ||
            '", "data": "' || {_BLOB} || '"}}, "list": ["' || {_IMAGE} || '"]}}'"""
        ).alias("content"),
    )


@query(
    "strip_images",
    f"""WITH parts AS (SELECT 'doc_' || doc_id || '.json' AS filename, doc_id % 2 = 0 AS img, {_IMAGE} AS shot, {_BLOB} AS blob FROM documents),
    gone AS (SELECT *, CASE WHEN length(shot) > 256 THEN '[IMAGE_REMOVED]' ELSE shot END AS s2,
      CASE WHEN img AND length(blob) > 256 THEN '[IMAGE_REMOVED]' ELSE blob END AS b2 FROM parts)
    SELECT filename, CAST(CASE WHEN length(shot) > 256 THEN 2 ELSE 0 END + CASE WHEN img AND length(blob) > 256 THEN 1 ELSE 0 END AS BIGINT) AS images_stripped,
      sha256('{{"shot":"' || s2 || '","blob":{{"mimeType":"' || CASE WHEN img THEN 'image/png' ELSE 'text/plain' END ||
        '","data":"' || b2 || '"}},"list":["' || s2 || '"]}}') AS redacted_hash FROM gone""",
)
def strip_images(spark, sf_dir):
    done = jr.redact_object(_image_sessions(spark, sf_dir), keys=KEYS, images=True)
    return done.select(
        "filename", "images_stripped", F.sha2("redacted", 256).alias("redacted_hash")
    )


@query(
    "strip_image_leaves",
    f"""WITH parts AS (SELECT doc_id, 'doc_' || doc_id || '.json' AS filename, doc_id % 2 = 0 AS img, {_IMAGE} AS shot, {_BLOB} AS blob FROM documents),
    leaf AS (SELECT filename, '$.shot' AS path, length(shot) > 256 AS image FROM parts
      UNION ALL SELECT filename, '$.blob.mimeType', false FROM parts
      UNION ALL SELECT filename, '$.blob.data', img AND length(blob) > 256 FROM parts
      UNION ALL SELECT filename, '$.list[0]', length(shot) > 256 FROM parts)
    SELECT * FROM leaf""",
)
def strip_image_leaves(spark, sf_dir):
    leaves = jr.json_leaves(_image_sessions(spark, sf_dir), "content", KEYS)
    return jr.strip_images(leaves).select("filename", "path", "image")


@query(
    "extract_images",
    f"""WITH parts AS (SELECT 'doc_' || doc_id AS safe, {_IMAGE} AS shot FROM documents),
    found AS (SELECT safe, substr(shot, 23) AS b64 FROM parts WHERE length(shot) - 22 >= 100),
    fixed AS (SELECT safe, CASE WHEN length(b64) % 4 = 1 THEN left(b64, length(b64) - 1) ELSE b64 END AS b FROM found),
    bytes AS (SELECT safe, from_base64(b || repeat('=', (4 - length(b) % 4) % 4)) AS image FROM fixed)
    SELECT safe || '.json' AS filename, CAST(i AS BIGINT) AS image_index, safe || '_img' || i || '.png' AS image_name,
      sha256(image) AS image_sha, CAST(octet_length(image) AS BIGINT) AS bytes FROM bytes, (SELECT unnest([0, 1]) AS i)""",
)
def extract_images(spark, sf_dir):
    images = jr.extract_images(_image_sessions(spark, sf_dir))
    return images.select(
        "filename",
        "image_index",
        "image_name",
        F.sha2("image", 256).alias("image_sha"),
        F.octet_length("image").cast("bigint").alias("bytes"),
    )


@query(
    "session_hashes",
    f"""WITH {SESSIONS}
    SELECT filename, sha256(content) AS source_hash, sha256('v1:' || sha256(content) || ':' || doc_id % 5) AS redaction_key,
      CAST(strlen(content) AS BIGINT) AS size_bytes FROM sessions""",
)
def session_hashes(spark, sf_dir):
    rows = fx.json_sessions(spark, sf_dir)
    source = hashing.source_hash(F.col("content"))
    return rows.select(
        "filename",
        source.alias("source_hash"),
        hashing.redaction_key(source, F.col("doc_id") % 5).alias("redaction_key"),
        hashing.size_bytes(F.col("content")).alias("size_bytes"),
    )


# Rules


@query(
    "drop_rejected",
    f"WITH {o.PLANTED}, {o.REJECT} SELECT doc_id, filename FROM planted ANTI JOIN reject USING (filename)",
)
def drop_rejected(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS source_dir", f"{fx.FILENAME} AS filename"
    )
    return rules.drop_rejected(docs, fx.reject_list(spark, sf_dir)).select("doc_id", "filename")


@query(
    "deny_by_name",
    f"WITH {o.PLANTED} SELECT doc_id, regexp_matches(filename, '{fx.DENY_NAME}') AS denied FROM planted",
)
def deny_by_name(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{fx.FILENAME} AS filename")
    return docs.select(
        "doc_id", rules.denied_by_name(F.col("filename"), [fx.DENY_NAME]).alias("denied")
    )


@query(
    "deny_by_content",
    f"""WITH {SESSIONS} SELECT filename, regexp_matches(compact, '{fx.DENY_CONTENT}|sk-[0-9a-f]+|track') AS denied
    FROM sessions WHERE compact IS NOT NULL""",
)
def deny_by_content(spark, sf_dir):
    rows = fx.json_sessions(spark, sf_dir).select(
        "filename", once(parsed(F.col("content"))).alias("p")
    )
    deny = [fx.DENY_CONTENT, "sk-[0-9a-f]+", "track"]
    return rows.where("p.ok").select(
        "filename", rules.denied_by_content(F.col("p.compact"), deny).alias("denied")
    )


_PREV = """prev AS (SELECT source_dir, filename,
      CASE WHEN lang = 'fr' THEN sha256(content || ' ') ELSE sha256(content) END AS source_hash
    FROM sessions WHERE lang IN ('en', 'fr'))"""


@query(
    "drop_unchanged",
    f"""WITH {SESSIONS}, {_PREV}
    SELECT s.filename FROM sessions s LEFT JOIN prev p USING (source_dir, filename)
    WHERE p.source_hash IS NULL OR p.source_hash <> sha256(s.content)""",
)
def drop_unchanged(spark, sf_dir):
    rows = fx.json_sessions(spark, sf_dir)
    hashed = rows.select(
        "source_dir", "filename", hashing.source_hash(F.col("content")).alias("source_hash")
    )
    return rules.drop_unchanged(hashed, fx.previous_manifest(rows)).select("filename")


_GREP = "TIONT|[Hh]er[aeiou]n"


def _pages(spark, sf_dir):
    return fx.spread(fx.table(spark, sf_dir, "pages"), "page_id").selectExpr(
        "'web' AS source_dir",
        "'doc_' || CAST(page_id AS STRING) || '.json' AS filename",
        "html AS content",
    )


@query(
    "grep_sessions",
    f"""WITH {o.REJECT} SELECT 'doc_' || page_id || '.json' AS filename FROM pages
    WHERE regexp_matches(html, '{_GREP}') AND 'doc_' || page_id || '.json' NOT IN (SELECT filename FROM reject)""",
)
def grep_sessions(spark, sf_dir):
    found = rules.grep_sessions(_pages(spark, sf_dir), fx.reject_list(spark, sf_dir), _GREP)
    return found.select("filename")


@query(
    "grep_count_ignore_case",
    f"""WITH {o.REJECT} SELECT CAST(count(*) AS BIGINT) AS sessions_matched FROM pages
    WHERE regexp_matches(html, '(?i){_GREP}') AND 'doc_' || page_id || '.json' NOT IN (SELECT filename FROM reject)""",
)
def grep_count(spark, sf_dir):
    reject = fx.reject_list(spark, sf_dir)
    return rules.grep_count(rules.grep_sessions(_pages(spark, sf_dir), reject, _GREP, True))


@query(
    "list_sessions",
    f"WITH {o.PLANTED} SELECT source_dir, filename FROM planted ORDER BY filename",
)
def list_sessions(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "source AS source_dir", f"{fx.FILENAME} AS filename"
    )
    return rules.list_sessions(docs)


@query(
    "list_uploadable",
    f"WITH {o.PLANTED}, {o.REJECT} SELECT source_dir, filename FROM planted ANTI JOIN reject USING (filename)",
)
def list_uploadable(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "source AS source_dir", f"{fx.FILENAME} AS filename"
    )
    return rules.list_sessions(docs, fx.reject_list(spark, sf_dir))


@query(
    "search_names",
    f"WITH {o.PLANTED} SELECT filename FROM planted WHERE contains(lower(filename), lower('OC_1'))",
)
def search_names(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(f"{fx.FILENAME} AS filename")
    return rules.search_names(docs, "OC_1")


# Collect

_COLLECT = f"""{SESSIONS}, {_PREV}, {o.REJECT},
    decided AS (SELECT s.*, sha256(s.content) AS source_hash, CASE
        WHEN s.filename IN (SELECT filename FROM reject) THEN 'on_reject_list'
        WHEN regexp_matches(s.filename, '{fx.DENY_NAME}') THEN 'rejected'
        WHEN p.source_hash = sha256(s.content) THEN 'unchanged'
        WHEN compact IS NULL THEN 'failed'
        WHEN regexp_matches(compact, '{fx.DENY_CONTENT}') THEN 'rejected'
        ELSE 'collected' END AS outcome
      FROM sessions s LEFT JOIN prev p USING (source_dir, filename)),
    {_redacted("decided")},
    collected AS (SELECT doc_id, source_dir, filename, source_hash, outcome,
      CASE WHEN outcome = 'collected' THEN redacted END AS redacted,
      CASE WHEN outcome = 'collected' THEN redactions_count END AS redactions_count,
      CASE WHEN outcome = 'collected' THEN match_count END AS match_count FROM redacted)"""


def json_collect_ctes() -> str:
    """CTEs up to ``collected``, for other queries on the same run."""
    return _COLLECT


_ROWS = """SELECT source_dir, filename, source_hash, outcome, sha256(redacted) AS redacted_hash,
      CASE WHEN redacted IS NOT NULL THEN sha256('v1:' || source_hash || ':' || redactions_count) END AS redaction_key,
      CAST(strlen(redacted) AS BIGINT) AS size_bytes, redactions_count, match_count FROM collected"""


def _collected(spark, sf_dir, small=None):
    rows = fx.json_sessions(spark, sf_dir)
    return col.collect(
        rows,
        deny=[fx.DENY_NAME, fx.DENY_CONTENT],
        reject=fx.reject_list(spark, sf_dir),
        prev=fx.previous_manifest(rows),
        small=small,
    )


_COLUMNS = [
    "source_dir",
    "filename",
    "source_hash",
    "outcome",
    "redacted_hash",
    "redaction_key",
    "size_bytes",
    "redactions_count",
    "match_count",
]


@query("collect", f"WITH {_COLLECT} {_ROWS}")
def collect(spark, sf_dir):
    return _collected(spark, sf_dir).select(*_COLUMNS)


@query("collect_with_long_lists", f"WITH {_COLLECT} {_ROWS}")
def collect_long(spark, sf_dir):
    """The form for manifests and reject lists too long to broadcast."""
    return _collected(spark, sf_dir, small=False).select(*_COLUMNS)


@query(
    "collect_with_secrets",
    f"""WITH {SESSIONS}, {o.TOKENS}, {o.SECRET_LIST},
    lit AS (SELECT * EXCLUDE (text, secrets), list_reduce(list_filter(secrets, lambda s: contains(text, s.v)),
      lambda acc, s: {{'v': replace(acc.v, s.v, s.r), 'r': ''}}, {{'v': text, 'r': ''}}).v AS text
      FROM sessions, secret_list),
    {_redacted("lit")}
    SELECT filename, CASE WHEN compact IS NULL THEN 'failed' ELSE 'collected' END AS outcome,
      sha256(redacted) AS redacted_hash FROM redacted""",
)
def collect_with_secrets(spark, sf_dir):
    secrets = fx.token_secrets(spark, sf_dir)
    done = col.collect(fx.json_sessions(spark, sf_dir), secrets=secrets)
    return done.select("filename", "outcome", "redacted_hash")


@query(
    "collect_summary",
    f"""WITH {_COLLECT} SELECT CAST(count(*) FILTER (outcome = 'collected') AS BIGINT) AS collected,
      CAST(count(*) FILTER (outcome = 'unchanged') AS BIGINT) AS unchanged,
      CAST(count(*) FILTER (outcome = 'rejected') AS BIGINT) AS rejected,
      CAST(count(*) FILTER (outcome = 'on_reject_list') AS BIGINT) AS on_reject_list,
      CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total FROM collected""",
)
def collect_summary(spark, sf_dir):
    return col.collect_summary(_collected(spark, sf_dir))


@query(
    "redaction_report",
    f"""WITH {_COLLECT} SELECT filename, sha256(redacted) AS redacted_hash, redactions_count, CAST(0 AS BIGINT) AS images_stripped,
      redactions_count AS reported, redactions_count AS detailed,
      CASE WHEN redactions_count = 0 THEN NULL WHEN doc_id % 14 = 13 THEN '$' WHEN doc_id % 7 = 5 THEN '$.lines[0].text'
        WHEN doc_id % 3 = 0 THEN '$["my text"][0]' ELSE '$.messages[0].text' END AS first_path
    FROM collected WHERE outcome = 'collected'""",
)
def redaction_report(spark, sf_dir):
    reports = col.redaction_report(_collected(spark, sf_dir))
    return reports.select(
        "filename",
        "redacted_hash",
        "redactions_count",
        "images_stripped",
        F.size("redactions").cast("bigint").alias("reported"),
        F.size("redaction_details").cast("bigint").alias("detailed"),
        F.try_element_at("redactions", F.lit(1))["path"].alias("first_path"),
    )


# Manifest and reject list: orders stand in for a manifest of realistic length.

_OLD = """SELECT 'clerk' AS source_dir, 'order_' || CAST(o_orderkey AS STRING) || '.json' AS filename,
    md5(o_orderstatus) AS source_hash, CAST(o_custkey AS BIGINT) AS size_bytes, o_orderdate AS created_at FROM orders"""
_NEW = """SELECT 'clerk' AS source_dir, 'order_' || CAST(l_orderkey * 2 AS STRING) || '.json' AS filename,
    md5(l_returnflag) AS source_hash, CAST(l_partkey AS BIGINT) AS size_bytes, l_shipdate AS created_at
    FROM lineitem"""


def _manifests(spark, sf_dir):
    for name in ("orders", "lineitem"):
        fx.table(spark, sf_dir, name).createOrReplaceTempView(f"_ts_{name}")
    old = spark.sql(_OLD.replace("FROM orders", "FROM _ts_orders"))
    new = spark.sql(_NEW.replace("FROM lineitem", "FROM _ts_lineitem"))
    return old, new


_UPSERT = f"""old AS ({_OLD}), new AS ({_NEW}),
    newest AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY source_dir, filename
      ORDER BY created_at DESC, source_hash DESC, size_bytes DESC) = 1),
    merged AS (SELECT * FROM newest UNION ALL SELECT * FROM old ANTI JOIN newest USING (source_dir, filename))"""


@query(
    "upsert_manifest",
    f"WITH {_UPSERT} SELECT source_dir, filename, source_hash, size_bytes FROM merged",
)
def upsert_manifest(spark, sf_dir):
    merged = man.upsert_manifest(*_manifests(spark, sf_dir))
    return merged.select("source_dir", "filename", "source_hash", "size_bytes")


@query(
    "session_metadata",
    f"WITH old AS ({_OLD}) SELECT filename, source_hash, size_bytes FROM old WHERE filename = 'order_7.json'",
)
def session_metadata(spark, sf_dir):
    old, _ = _manifests(spark, sf_dir)
    return man.session_metadata(old, "order_7.json").select(
        "filename", "source_hash", "size_bytes"
    )


@query(
    "load_session",
    f"WITH {o.PLANTED} SELECT filename, text FROM planted WHERE filename = 'doc_42.json'",
)
def load_session(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        f"{fx.FILENAME} AS filename", f"{fx.PLANTED_TEXT} AS text"
    )
    return man.load_session(docs, "doc_42.json")


_PATHS = "'/work/red/doc_' || CAST(l_orderkey % 1000 AS STRING) || '.json'"


def _paths(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").selectExpr(f"{_PATHS} AS filename")


@query(
    "add_rejected",
    f"""WITH {o.REJECT} SELECT filename FROM reject UNION
    SELECT regexp_extract({_PATHS}, '[^/]+$', 0) FROM lineitem""",
)
def add_rejected(spark, sf_dir):
    return man.add_rejected(fx.reject_list(spark, sf_dir), _paths(spark, sf_dir))


@query(
    "remove_rejected",
    f"""WITH {o.REJECT} SELECT filename FROM reject EXCEPT
    SELECT 'doc_' || l_orderkey || '.json' FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05""",
)
def remove_rejected(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.05")
    names = lines.selectExpr("'red/doc_' || CAST(l_orderkey AS STRING) || '.json' AS filename")
    return man.remove_rejected(fx.reject_list(spark, sf_dir), names)


@query(
    "collect_extra_rules",
    f"""WITH e AS (SELECT doc_id, text, regexp_replace(text, {o.quoted(EMAIL)}, '[REDACTED:EMAIL]', 'g') AS t FROM documents),
    k AS (SELECT *, regexp_replace(t, {o.quoted(KEY_VALUE)}, '\\1[REDACTED:KEY_VALUE]', 'g') AS done FROM e)
    SELECT {fx.FILENAME} AS filename, sha256(done) AS text_sha, CAST(len(regexp_extract_all(text, {o.quoted(EMAIL)})) AS BIGINT) AS emails,
      CAST(len(regexp_extract_all(t, {o.quoted(KEY_VALUE)})) AS BIGINT) AS pairs FROM k WHERE done <> text""",
)
def collect_extra_rules(spark, sf_dir):
    """E-mail and key-value rules within the collect run; the documents have nothing for the detectors."""
    docs = fx.plain(spark, sf_dir)
    rows = docs.select("source_dir", "filename", F.to_json(F.struct(F.col("text").alias("t"))).alias("content"))
    done = col.collect(rows, extra_rules=["key_value", "email"])
    leaf = done.where("size(changed) > 0").select("filename", F.explode("changed").alias("l"))

    def count(name):
        own = F.filter("l.findings", lambda f: f["detector"] == name)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda n, f: n + f["count"])

    return leaf.select("filename", F.sha2("l.text", 256).alias("text_sha"), count("EMAIL").alias("emails"), count("KEY_VALUE").alias("pairs"))
