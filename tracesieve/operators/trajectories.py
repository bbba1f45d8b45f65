"""Agent trajectories as tables: steps, tool calls, observations, metrics.

All of it is projection and ``posexplode``: no shuffle, so a session's steps come out where
the session was read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.text import first_non_empty, let, once
from tracesieve.operators.rules import KEY, mark_rejected

METRICS = (
    "prompt_tokens BIGINT, completion_tokens BIGINT, cached_tokens BIGINT, "
    "total_tokens BIGINT, cost_usd DOUBLE"
)
CALL = (
    "tool_call_id STRING, function_name STRING, name STRING, arguments STRING, args STRING"
)
STEP_TYPES = {
    "step_id": "BIGINT",
    "source": "STRING",
    "timestamp": "STRING",
    "message": "STRING",
    "reasoning_content": "STRING",
    "tool_calls": f"ARRAY<STRUCT<{CALL}>>",
    "observation": "VARIANT",
    "metrics": f"STRUCT<{METRICS}>",
}
STEP_FIELDS = list(STEP_TYPES)
TRAJECTORY = (
    "schema_version STRING, session_id STRING, "
    "agent STRUCT<name STRING, version STRING, model_name STRING>, "
    f"steps ARRAY<STRING>, final_metrics STRUCT<{METRICS}>, lines ARRAY<STRING>"
)


def _schema(fields: Iterable[str]) -> str:
    return ", ".join(f"{f} {STEP_TYPES[f]}" for f in STEP_FIELDS if f in fields)


def parse_trajectory(df: DataFrame, content: str = "redacted") -> DataFrame:
    """Typed ``trajectory`` struct of a session's JSON text. Tool arguments stay JSON text; so do
    steps and lines, each of which is typed by itself: an odd one costs no other.

    JSON-lines sessions are expected as collected, that is as ``{"lines": [...]}``.
    """
    return df.withColumn("trajectory", F.from_json(F.col(content), TRAJECTORY))


def session_steps(steps: Column, lines: Column, fields: Iterable[str] = STEP_FIELDS) -> Column:
    """The steps of a session, with these fields only: others are not parsed. With ``lines``, those are
    the steps of each line, or the line itself when it has a source (its ``step_id`` defaults to its
    place, counted from 1). A step that is no object is one without fields."""
    wanted = [f for f in STEP_FIELDS if f in set(fields)]
    step, line_type = _schema(wanted), f"steps ARRAY<STRING>, {_schema({*wanted, 'source', 'step_id'})}"

    def typed(texts: Column) -> Column:
        return F.transform(texts, lambda text: F.from_json(text, step))

    def of_line(line: Column, index: Column) -> Column:
        place = (index + 1).cast("bigint")
        step_id = F.coalesce(F.nullif(line["step_id"], F.lit(0).cast("bigint")), place)
        alone = F.struct(*[(step_id if f == "step_id" else line[f]).alias(f) for f in wanted])
        return (
            F.when(line["steps"].isNotNull(), typed(line["steps"]))
            .when(first_non_empty(line["source"]).isNotNull(), F.array(alone))
            .otherwise(F.array().cast(f"array<struct<{step}>>"))
        )

    def of_text(text: Column, index: Column) -> Column:
        return let(F.from_json(text, line_type), lambda line: of_line(line, index))

    return F.coalesce(F.flatten(F.transform(lines, of_text)), typed(steps))


def steps(
    sessions: DataFrame, keys: list[str], trajectory: str = "trajectory", fields: Iterable[str] = STEP_FIELDS
) -> DataFrame:
    """One row per step with its 0-based place ``step_index``. Name the ``fields`` that are needed: steps
    are parsed once, before Catalyst can tell which of them are read."""
    t = F.col(trajectory)
    wanted = [f for f in STEP_FIELDS if f in set(fields)]
    listed = sessions.select(*keys, once(session_steps(t["steps"], t["lines"], wanted)).alias("_steps"))
    rows = listed.select(*keys, F.posexplode("_steps").alias("step_index", "_s"))
    return rows.select(
        *keys,
        F.col("step_index").cast("bigint").alias("step_index"),
        *[F.col(f"_s.{f}").alias(f) for f in wanted],
    )


def session_info(
    sessions: DataFrame,
    keys: list[str],
    trajectory: str = "trajectory",
    missing: str = "—",
    missing_version: str = "",
) -> DataFrame:
    """Schema, session, agent and model with a text for what is missing."""
    t = F.col(trajectory)

    def shown(value: Column, default: str = missing) -> Column:
        return F.coalesce(first_non_empty(value), F.lit(default))

    agent = F.concat(
        shown(t["agent"]["name"]), F.lit(" v"), shown(t["agent"]["version"], missing_version)
    )
    return sessions.select(
        *keys,
        shown(t["schema_version"]).alias("schema_version"),
        shown(t["session_id"]).alias("session"),
        agent.alias("agent"),
        shown(t["agent"]["model_name"]).alias("model"),
    )


def step_role(source: Column) -> Column:
    """user, assistant or system, by what the lower-case source contains."""
    name = F.lower(F.coalesce(first_non_empty(source), F.lit("unknown")))
    return (
        F.when(name.contains("user"), "user")
        .when(name.contains("assistant") | name.contains("agent"), "assistant")
        .otherwise("system")
    )


def tool_calls(step_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tool call: name and arguments (JSON text) with their defaults."""
    rows = step_rows.select(*keys, F.posexplode("tool_calls").alias("call_index", "c"))
    given = [F.nullif(F.col(f"c.{f}"), F.lit("null")) for f in ("arguments", "args")]
    return rows.select(
        *keys,
        F.col("call_index").cast("bigint").alias("call_index"),
        F.col("c.tool_call_id").alias("tool_call_id"),
        F.coalesce(
            first_non_empty(F.col("c.function_name"), F.col("c.name")), F.lit("unknown")
        ).alias("name"),
        F.coalesce(first_non_empty(*given), F.lit("{}")).alias("arguments"),
    )


def observations(step_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per observation result, or one for an observation without ``results``.

    A result that has none of the text fields is shown as JSON, whatever it is; objects then have
    their keys in alphabetical order."""
    obs = F.col("observation")
    empty = F.coalesce(F.to_json(obs), F.lit("null")).isin("null", '""', "0", "false")
    listed_results = F.try_variant_get(obs, "$.results", "array<variant>")
    results = F.when(~empty, F.coalesce(listed_results, F.array(obs)))
    listed = step_rows.select(*keys, once(results).alias("_r"))
    rows = listed.select(*keys, F.posexplode("_r").alias("result_index", "r"))

    def field(name: str) -> Column:
        return F.try_variant_get("r", f"$.{name}", "string")

    return rows.select(
        *keys,
        F.col("result_index").cast("bigint").alias("result_index"),
        field("source_call_id").alias("source_call_id"),
        F.coalesce(
            first_non_empty(field("content"), field("output"), field("result")), F.to_json("r")
        ).alias("content"),
    )


def metric_columns(metrics: Column) -> list[Column]:
    """Token counts, cost, and the cost as text with four decimals; absent stays absent."""
    names = ["prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens", "cost_usd"]
    cost = metrics["cost_usd"]
    return [
        *[metrics[n].alias(n) for n in names],
        F.when(cost.isNotNull(), F.format_string("$%.4f", cost)).alias("cost_text"),
    ]


def step_metrics(step_rows: DataFrame, keys: list[str]) -> DataFrame:
    return step_rows.where("metrics is not null").select(*keys, *metric_columns(F.col("metrics")))


def final_metrics(
    sessions: DataFrame, keys: list[str], trajectory: str = "trajectory"
) -> DataFrame:
    final = F.col(trajectory)["final_metrics"]
    return sessions.where(final.isNotNull()).select(*keys, *metric_columns(final))


def step_text(step_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Message and reasoning; empty ones are null."""
    return step_rows.select(
        *keys,
        first_non_empty(F.col("message")).alias("message"),
        first_non_empty(F.col("reasoning_content")).alias("reasoning"),
    )


def step_time(timestamp: Column) -> Column:
    """Time of a step; null when missing or not a time. Give ISO times with their offset:
    those without one are read in the session's zone, which should be UTC."""
    return F.try_to_timestamp(first_non_empty(timestamp))


def session_listing(sessions: DataFrame, reject: DataFrame) -> DataFrame:
    """Name, size, time and reject flag of every session, newest first."""
    marked = mark_rejected(sessions.select(*KEY, "size", "modified"), reject)
    return marked.orderBy(F.col("modified").desc(), "filename", "source_dir")


def report_for(
    names: DataFrame, scan_reports: DataFrame, redaction_reports: DataFrame, keys: list[str]
) -> DataFrame:
    """For each session its scanner report when there is one, else its redaction report.

    Both report tables have the keys and ``report`` (JSON text); sessions with neither are
    left out.
    """
    scan = scan_reports.select(*keys, F.col("report").alias("_scan"))
    redaction = redaction_reports.select(*keys, F.col("report").alias("_redaction"))
    joined = names.select(*keys).join(scan, keys, "left").join(redaction, keys, "left")
    chosen = joined.select(
        *keys,
        F.when(F.col("_scan").isNotNull(), "scan").otherwise("redaction").alias("kind"),
        F.coalesce("_scan", "_redaction").alias("report"),
    )
    return chosen.where("report is not null")
