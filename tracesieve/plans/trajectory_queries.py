"""Registered queries: trajectories, listings and report lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesieve.functions.text import once
from tracesieve.operators import trajectories as tr
from tracesieve.plans import fixtures as fx
from tracesieve.plans import oracle_sql as o
from tracesieve.plans.registry import query

KEYS = ["conv_id", "segment"]
STEP_KEYS = [*KEYS, "step_index"]

# Every turn is a session of its own with this many lines, so that no session grows with the
# length of a conversation. Line i of turn n counts as turn 4 n + i below.
LINES = 4

# One turn as a JSON line. Some are lines with a source, some wrap one step in ``steps``,
# some are neither; names, ids, results and metrics are missing now and then.
_CALLS = """CASE turn % 4 WHEN 0 THEN ', "tool_calls": [{"tool_call_id": "c' || turn || '", "function_name": "read", "arguments": {"n": ' || turn || '}}, {"name": "write", "args": {"ok": true}}]'
    WHEN 1 THEN ', "tool_calls": [{"tool_call_id": "d' || turn || '"}]' WHEN 2 THEN ', "tool_calls": []' ELSE '' END"""
_OBS = """CASE turn % 5 WHEN 0 THEN ', "observation": {"results": [{"source_call_id": "c' || turn || '", "content": "seen ' || conv_id || '"}, {"output": "out"}]}'
    WHEN 1 THEN ', "observation": {"content": "", "result": "bare"}' WHEN 2 THEN ', "observation": {"results": [{"source_call_id": "x"}]}'
    WHEN 3 THEN ', "observation": {"results": ["txt", {"stdout": "s' || turn || '"}, 5]}' ELSE CASE WHEN turn % 2 = 0 THEN ', "observation": "plain ' || turn || '"' ELSE '' END END"""
_METRICS = """CASE turn % 3 WHEN 0 THEN ', "metrics": {"prompt_tokens": ' || length(text) || ', "completion_tokens": ' || turn || ', "cost_usd": ' || CAST(length(text) * 1373 AS STRING) || 'e-8}'
    WHEN 1 THEN ', "metrics": {"cached_tokens": 1, "total_tokens": ' || length(text) || '}' ELSE '' END"""
_TIME = """CASE turn % 3 WHEN 0 THEN ', "timestamp": "2024-05-0' || (1 + turn % 9) || 'T10:0' || (turn % 10) || ':30Z"'
    WHEN 1 THEN ', "timestamp": ""' ELSE ', "timestamp": "some day"' END"""
_STEP = f"""'"source": "' || CASE WHEN turn % 6 = 5 THEN 'Sub-Agent' ELSE role END || '", "message": ' || js ||
    CASE WHEN turn % 2 = 1 THEN ', "reasoning_content": "because ' || turn || '"' ELSE ', "reasoning_content": ""' END ||
    {_CALLS} || {_OBS} || {_METRICS} || {_TIME}"""
_LINE = f"""CASE WHEN turn % 16 = 14 THEN '"junk"' WHEN turn % 8 = 6 THEN '{{"note": "no step"}}'
    WHEN turn % 8 = 3 THEN '{{"steps": [{{"step_id": ' || (100 + turn) || ', ' || {_STEP} || '}}]}}'
    WHEN turn % 8 = 4 THEN '{{"step_id": ' || turn || ', ' || {_STEP} || '}}'
    ELSE '{{' || {_STEP} || '}}' END"""


def _segments(spark, sf_dir):
    """Conversation turns as collected JSON-lines sessions."""
    turns = fx.table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.col("turn").alias("segment"),
        "role",
        "text",
        once(fx.json_string(F.col("text"))).alias("js"),
    )
    head = F.expr(
        """'{"schema_version": "v' || conv_id % 3 || '", "session_id": "' ||
        CASE WHEN conv_id % 4 = 0 THEN '' ELSE 's' || conv_id END || '"' ||
        CASE conv_id % 3 WHEN 0 THEN ', "agent": {"name": "coder", "version": "' || conv_id || '", "model_name": "m1"}'
          WHEN 1 THEN ', "agent": {"name": "coder"}' ELSE '' END ||
        CASE WHEN conv_id % 2 = 0 THEN ', "final_metrics": {"prompt_tokens": ' || conv_id || ', "cost_usd": 0.12346}' ELSE '' END"""
    )
    lines = F.expr(
        f"transform(sequence(segment * {LINES}, segment * {LINES} + {LINES - 1}), turn -> {_LINE})"
    )
    content = F.concat(head, F.lit(', "lines": ['), F.array_join(lines, ","), F.lit("]}"))
    return tr.parse_trajectory(turns.select(*KEYS, once(content).alias("redacted")))


def _steps(spark, sf_dir, *fields):
    return tr.steps(_segments(spark, sf_dir), KEYS, fields=fields)


# The expected steps come straight from the turns, not from the JSON.
_T = """t AS (SELECT conv_id, turn AS segment, turn * 4 + i AS turn, i + 1 AS place, role, text, length(text) AS n,
      CASE WHEN (turn * 4 + i) % 6 = 5 THEN 'Sub-Agent' ELSE role END AS source
      FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS i)),
    s AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn) - 1 AS BIGINT) AS step_index,
      CAST(CASE WHEN turn % 8 = 3 THEN 100 + turn WHEN turn % 8 = 4 AND turn > 0 THEN turn ELSE place END AS BIGINT) AS step_id
      FROM t WHERE turn % 8 <> 6)"""


@query(
    "trajectory_steps",
    f"WITH {_T} SELECT conv_id, segment, step_index, step_id, source, sha256(text) AS message_sha FROM s",
)
def trajectory_steps(spark, sf_dir):
    return _steps(spark, sf_dir, "step_id", "source", "message").select(
        *STEP_KEYS, "step_id", "source", F.sha2("message", 256).alias("message_sha")
    )


@query(
    "session_info",
    """SELECT conv_id, turn AS segment, 'v' || conv_id % 3 AS schema_version,
      CASE WHEN conv_id % 4 = 0 THEN '—' ELSE 's' || conv_id END AS session,
      CASE conv_id % 3 WHEN 0 THEN 'coder v' || conv_id WHEN 1 THEN 'coder v' ELSE '— v' END AS agent,
      CASE conv_id % 3 WHEN 0 THEN 'm1' ELSE '—' END AS model FROM conversations""",
)
def session_info(spark, sf_dir):
    return tr.session_info(_segments(spark, sf_dir), KEYS)


@query(
    "step_role",
    f"""WITH {_T} SELECT conv_id, segment, step_index, CASE WHEN turn % 6 = 5 THEN 'assistant' WHEN role IN ('user', 'assistant') THEN role
      ELSE 'system' END AS role FROM s""",
)
def step_role(spark, sf_dir):
    return _steps(spark, sf_dir, "source").select(
        *STEP_KEYS, tr.step_role(F.col("source")).alias("role")
    )


@query(
    "tool_calls",
    f"""WITH {_T}
    SELECT conv_id, segment, step_index, CAST(0 AS BIGINT) AS call_index, 'c' || turn AS tool_call_id, 'read' AS name, '{{"n":' || turn || '}}' AS arguments FROM s WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, segment, step_index, 1, NULL, 'write', '{{"ok":true}}' FROM s WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, segment, step_index, 0, 'd' || turn, 'unknown', '{{}}' FROM s WHERE turn % 4 = 1""",
)
def tool_calls(spark, sf_dir):
    return tr.tool_calls(_steps(spark, sf_dir, "tool_calls"), STEP_KEYS)


@query(
    "observations",
    f"""WITH {_T}
    SELECT conv_id, segment, step_index, CAST(0 AS BIGINT) AS result_index, 'c' || turn AS source_call_id, 'seen ' || conv_id AS content FROM s WHERE turn % 5 = 0
    UNION ALL SELECT conv_id, segment, step_index, 1, NULL, 'out' FROM s WHERE turn % 5 = 0
    UNION ALL SELECT conv_id, segment, step_index, 0, NULL, 'bare' FROM s WHERE turn % 5 = 1
    UNION ALL SELECT conv_id, segment, step_index, 0, 'x', '{{"source_call_id":"x"}}' FROM s WHERE turn % 5 = 2
    UNION ALL SELECT conv_id, segment, step_index, 0, NULL, '"txt"' FROM s WHERE turn % 5 = 3
    UNION ALL SELECT conv_id, segment, step_index, 1, NULL, '{{"stdout":"s' || turn || '"}}' FROM s WHERE turn % 5 = 3
    UNION ALL SELECT conv_id, segment, step_index, 2, NULL, '5' FROM s WHERE turn % 5 = 3
    UNION ALL SELECT conv_id, segment, step_index, 0, NULL, '"plain ' || turn || '"' FROM s WHERE turn % 5 = 4 AND turn % 2 = 0""",
)
def observations(spark, sf_dir):
    return tr.observations(_steps(spark, sf_dir, "observation"), STEP_KEYS)


@query(
    "step_metrics",
    f"""WITH {_T} SELECT conv_id, segment, step_index, CASE WHEN turn % 3 = 0 THEN n END AS prompt_tokens, CASE WHEN turn % 3 = 0 THEN turn END AS completion_tokens,
      CAST(CASE WHEN turn % 3 = 1 THEN 1 END AS BIGINT) AS cached_tokens, CASE WHEN turn % 3 = 1 THEN n END AS total_tokens,
      CASE WHEN turn % 3 = 0 THEN CAST(n * 1373 || 'e-8' AS DOUBLE) END AS cost_usd,
      CASE WHEN turn % 3 = 0 THEN printf('$%.4f', CAST(n * 1373 || 'e-8' AS DOUBLE)) END AS cost_text FROM s WHERE turn % 3 < 2""",
)
def step_metrics(spark, sf_dir):
    return tr.step_metrics(_steps(spark, sf_dir, "metrics"), STEP_KEYS)


@query(
    "final_metrics",
    """SELECT conv_id, turn AS segment, conv_id AS prompt_tokens, CAST(NULL AS BIGINT) AS completion_tokens,
      CAST(NULL AS BIGINT) AS cached_tokens, CAST(NULL AS BIGINT) AS total_tokens, CAST(0.12346 AS DOUBLE) AS cost_usd,
      '$0.1235' AS cost_text FROM conversations WHERE conv_id % 2 = 0""",
)
def final_metrics(spark, sf_dir):
    return tr.final_metrics(_segments(spark, sf_dir), KEYS)


@query(
    "step_text",
    f"""WITH {_T} SELECT conv_id, segment, step_index, nullif(text, '') AS message,
      CASE WHEN turn % 2 = 1 THEN 'because ' || turn END AS reasoning FROM s""",
)
def step_text(spark, sf_dir):
    return tr.step_text(_steps(spark, sf_dir, "message", "reasoning_content"), STEP_KEYS)


@query(
    "step_time",
    f"""WITH {_T} SELECT conv_id, segment, step_index, CASE WHEN turn % 3 = 0 THEN
      CAST(epoch(make_timestamp(2024, 5, 1 + turn % 9, 10, turn % 10, 30)) AS BIGINT) END AS seconds FROM s""",
)
def step_time(spark, sf_dir):
    at = tr.step_time(F.col("timestamp"))
    return _steps(spark, sf_dir, "timestamp").select(*STEP_KEYS, F.unix_seconds(at).alias("seconds"))


@query(
    "calls_with_results",
    f"""WITH {_T} SELECT conv_id, segment, step_index, 'c' || turn AS tool_call_id, 'read' AS name, 'seen ' || conv_id AS content
    FROM s WHERE turn % 20 = 0""",
)
def calls_with_results(spark, sf_dir):
    """Tool calls beside what they returned, joined on the call id within a step."""
    steps = _steps(spark, sf_dir, "tool_calls", "observation")
    calls = tr.tool_calls(steps, STEP_KEYS)
    results = tr.observations(steps, STEP_KEYS).withColumnRenamed("source_call_id", "tool_call_id")
    joined = calls.join(results, [*STEP_KEYS, "tool_call_id"])
    return joined.select(*STEP_KEYS, "tool_call_id", "name", "content")


@query(
    "session_listing",
    f"""WITH {o.REJECT}, l AS (SELECT CAST(o_orderkey AS STRING) AS k, o_custkey, o_orderdate FROM orders)
    SELECT 'doc_' || k || '.json' AS filename, o_custkey AS size, CAST(epoch(o_orderdate) AS BIGINT) AS modified,
      'doc_' || k || '.json' IN (SELECT filename FROM reject) AS rejected FROM l""",
)
def session_listing(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").selectExpr(
        "'desk' AS source_dir",
        "'doc_' || CAST(o_orderkey AS STRING) || '.json' AS filename",
        "o_custkey AS size",
        "CAST(timestampdiff(SECOND, timestamp_ntz'1970-01-01', o_orderdate) AS BIGINT) AS modified",
    )
    listing = tr.session_listing(orders, fx.reject_list(spark, sf_dir))
    return listing.select("filename", "size", "modified", "rejected")


@query(
    "report_for",
    """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'scan' ELSE 'redaction' END AS kind,
      CASE WHEN o_orderstatus = 'F' THEN '{"customer":' || o_custkey || '}' ELSE '{"status":"' || o_orderstatus || '"}' END AS report
    FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority < '3'""",
)
def report_for(spark, sf_dir):
    names = fx.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    scan = names.where("o_orderstatus = 'F'").select(
        "k", F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias("report")
    )
    redaction = names.where("o_orderpriority < '3'").select(
        "k", F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("report")
    )
    return tr.report_for(names, scan, redaction, ["k"])
