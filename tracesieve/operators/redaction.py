"""Detector redaction of text columns.

Everything here is row-local: no shuffle, no Python. Two forms share the same rules:

* :func:`redacted_text` is one expression giving only the rewritten text. It nests inside
  ``transform`` and ``withField``.
* :func:`redact_patterns` also reports what was found.

Matches are replaced where they stand. (The reference replaces each distinct match
everywhere by splitting on it, so a short match that is a prefix of a longer one leaves the
tail of the longer one readable.)
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.detectors import DETECTORS, EMAIL_ONE_PASS, KEY_VALUE, chosen_rules, detector_info
from tracesieve.functions.detectors import EMAIL as EMAIL
from tracesieve.functions.text import let, let_sql, mask_secret, once

HIT_TYPE = "array<struct<rule:int,match:string>>"

def redacted_text(text: Column) -> Column:
    """``text`` after all detectors, in order."""
    body = "t"
    for d in DETECTORS:
        n = f"t{d.index}"
        step = f"CASE WHEN {d.may_match(n)} THEN {d.replace_in(n)} ELSE {n} END"
        body = f"transform(array({body}), {n} -> {step})[0]"
    return let_sql(text, "t", body)


def scan_text(text: Column, extra: Iterable[str] = ()) -> Column:
    """``struct<text, hits>``: the rewritten text and every match as (rule, match). ``extra`` names rules
    that run after the detectors: ``email``, ``key_value``.

    ``hits`` holds raw secrets: turn it into findings or masks before anything is written.

    Each step reads the previous text several times. Binding it to a lambda variable keeps
    the expression linear in size; as a chain of projections it would grow exponentially
    once Catalyst pushed a filter or a join key through it.
    """
    body = f"named_struct('text', t, 'hits', CAST(array() AS {HIT_TYPE}))"
    for d in chosen_rules(extra):
        s = f"s{d.index}"
        t = f"{s}.text"
        found = f"transform({d.matches_in(t)}, m -> named_struct('rule', {d.index}, 'match', m))"
        new = f"named_struct('text', {d.replace_in(t)}, 'hits', concat({s}.hits, {found}))"
        step = f"CASE WHEN {d.may_match(t)} THEN {new} ELSE {s} END"
        body = f"transform(array({body}), {s} -> {step})[0]"
    return let_sql(text, "t", body)


def tally_hits(hits: Column) -> Column:
    """Distinct matches of one text with their counts, in detector order.

    Sorts the hits once and measures the runs, so the cost stays near linear even for a text
    made of nothing but secrets.
    """
    starts = "filter(sequence(1, size(s)), p -> p = 1 OR get(s, p - 1) <> get(s, p - 2))"
    run = (
        "named_struct('rule', get(s, p - 1).rule, 'match', get(s, p - 1).match, 'count', "
        "CAST(coalesce(get(st, j + 1), size(s) + 1) - p AS BIGINT))"
    )
    runs = f"transform(array({starts}), st -> transform(st, (p, j) -> {run}))[0]"
    none = "CAST(array() AS array<struct<rule:int,match:string,count:bigint>>)"
    body = f"CASE WHEN size(s) = 0 THEN {none} ELSE {runs} END"
    return let_sql(F.sort_array(hits), "s", body)


def findings_from_hits(hits: Column) -> Column:
    """``array<struct<detector, severity, replacement, count>>`` without the raw matches."""
    return F.transform(
        tally_hits(hits),
        lambda t: let(
            F.element_at(detector_info(), t["rule"] + 1),
            lambda d: F.struct(
                d["detector"].alias("detector"),
                d["severity"].alias("severity"),
                d["replacement"].alias("replacement"),
                t["count"].alias("count"),
            ),
        ),
    )


def redact_patterns(
    df: DataFrame, text: str = "text", out: str = "redacted", findings: str = "findings"
) -> DataFrame:
    """Add the redacted text and one finding per distinct match."""
    kept = [c for c in df.columns if c not in (out, findings)]
    return df.select(*kept, once(scan_text(F.col(text))).alias("_scan")).select(
        *kept,
        F.col("_scan.text").alias(out),
        findings_from_hits(F.col("_scan.hits")).alias(findings),
    )


def pattern_matches(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per (key, detector, distinct match): hash, mask and count instead of the match."""
    tallied = df.select(*keys, once(tally_hits(scan_text(F.col(text))["hits"])).alias("t"))
    rows = tallied.select(*keys, F.explode("t").alias("t"))
    return rows.select(
        *keys,
        F.col("t.rule").alias("rule"),
        F.element_at(detector_info(), F.col("t.rule") + 1)["detector"].alias("detector"),
        F.element_at(detector_info(), F.col("t.rule") + 1)["severity"].alias("severity"),
        F.sha2(F.col("t.match"), 256).alias("match_sha256"),
        mask_secret(F.col("t.match")).alias("masked"),
        F.col("t.count").alias("count"),
    )


def redact_email(text: Column) -> Column:
    """Opt-in: e-mail addresses become ``[REDACTED:EMAIL]``."""
    return F.when(
        text.contains("@"), F.regexp_replace(text, EMAIL_ONE_PASS, "[REDACTED:EMAIL]")
    ).otherwise(text)


def redact_key_value(text: Column) -> Column:
    """Opt-in: the value of ``token = "…"``, ``api_key: …`` and the like; the key stays."""
    return F.regexp_replace(text, KEY_VALUE, "$1[REDACTED:KEY_VALUE]")
