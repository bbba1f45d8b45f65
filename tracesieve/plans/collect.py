"""The collect run: from session rows to redacted sessions with one outcome each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.text import once
from tracesieve.operators import hashing
from tracesieve.operators.joins import cut_lineage, fits_broadcast
from tracesieve.operators.json_redaction import redaction_counts, with_parsed, with_redaction
from tracesieve.operators.membership import keep_known
from tracesieve.operators.rules import (
    KEY,
    comparable,
    denied_by_content,
    denied_by_name,
    mark_rejected,
    mark_unchanged,
)

# Why a session without content fails.
TOO_LARGE = "too large for one JSON value"

# Fixed value: a report repeats this many redacted leaves at its head.
REPORTED_LEAVES = 20

MANIFEST_COLUMNS = [
    *KEY,
    "source_hash",
    "redacted_hash",
    "redaction_key",
    "size_bytes",
    "redactions_count",
]


def decide(
    hashed: DataFrame,
    reject: DataFrame | None,
    deny: list[str],
    prev: DataFrame | None,
    small: bool | None = None,
) -> DataFrame:
    """Add ``outcome`` of the rules that need no parsing; null means: go on."""
    columns = hashed.columns
    never = F.lit(False)
    df = hashed
    if reject is not None:
        df = mark_rejected(df, reject, "_listed", small)
    if prev is not None:
        df = mark_unchanged(df, prev, flag="_same", small=small)
    outcome = (
        F.when(F.col("_listed") if reject is not None else never, "on_reject_list")
        .when(denied_by_name(F.col("filename"), deny), "rejected")
        .when(F.col("_same") if prev is not None else never, "unchanged")
    )
    return df.select(*columns, outcome.alias("outcome"))


def collect(
    sessions: DataFrame,
    secrets: DataFrame | None = None,
    deny: Iterable[str] = (),
    reject: DataFrame | None = None,
    prev: DataFrame | None = None,
    force: bool = False,
    strip_images: bool = False,
    rules_hash: str | None = None,
    small: bool | None = None,
    extra_rules: Iterable[str] = (),
    **bounds: int,
) -> DataFrame:
    """One row per session with ``outcome``: ``on_reject_list``, ``rejected`` (a deny pattern
    matched), ``unchanged``, ``failed`` (not JSON) or ``collected``; the redacted text, its
    hashes and counts, and what was redacted where.

    Short reject lists and manifests are broadcast and the sessions are read once. Long ones
    meet only names and hashes; the sessions left over are then read again and picked out where they
    are read (:func:`~tracesieve.operators.membership.keep_known`), so no text is shuffled.
    ``small`` overrides the measurement.

    ``rules_hash`` (see :func:`~tracesieve.operators.hashing.rules_fingerprint`) limits the
    comparison to sessions redacted under the same rules. ``extra_rules`` names rules beside the
    detectors: ``email``, ``key_value``.
    """
    deny, extra = list(deny), list(extra_rules)
    if force:
        prev = None
    if prev is not None:
        prev = comparable(prev, rules_hash)
    if small is None:
        sides = [s for s in (reject, prev) if s is not None]
        small = all(fits_broadcast(s) for s in sides)
    rows = sessions.select(*KEY, "content", hashing.source_hash(F.col("content")).alias("source_hash"))
    if small:
        return _process(decide(rows, reject, deny, prev, True), secrets, deny, strip_images, extra, bounds)
    decided = cut_lineage(decide(rows.drop("content"), reject, deny, prev, False))
    stopped = decided.where("outcome is not null")
    todo = keep_known(rows, decided.where("outcome is null"), stopped, KEY)
    todo = todo.withColumn("outcome", F.lit(None).cast("string"))
    done = _process(todo, secrets, deny, strip_images, extra, bounds)
    return done.unionByName(stopped, allowMissingColumns=True)


def _process(
    decided: DataFrame,
    secrets: DataFrame | None,
    deny: list[str],
    strip_images: bool,
    extra: list[str],
    bounds: dict,
) -> DataFrame:
    base = [*KEY, "source_hash"]
    text = F.when(F.col("outcome").isNull(), F.col("content"))
    df = with_parsed(decided, text, [*base, "outcome"])
    outcome = F.coalesce(
        F.col("outcome"),
        F.when(~F.coalesce(F.col("_ok"), F.lit(False)), F.lit("failed")),
        F.when(denied_by_content(F.col("_compact"), deny), F.lit("rejected")),
        F.lit("collected"),
    )
    error = F.when(outcome == "failed", F.coalesce("_error", F.lit(TOO_LARGE)))
    df = df.select(*base, once(F.struct(outcome.alias("outcome"), error.alias("error"))).alias("_o"), "_compact", "_leaves")
    going = F.col("_o.outcome") == "collected"
    df = df.select(*base, "_o.*", *[F.when(going, F.col(c)).alias(c) for c in ("_compact", "_leaves")])
    df = with_redaction(df, KEY, secrets, strip_images, extra, **bounds)
    count, matches, images = redaction_counts(F.col("changed"))
    df = df.select(*base, "outcome", "error", "redacted", count, matches, images, "changed")
    text = F.col("redacted")
    return df.select(
        *base,
        "outcome",
        "error",
        "redacted",
        hashing.redacted_hash(text).alias("redacted_hash"),
        F.when(
            text.isNotNull(),
            hashing.redaction_key(F.col("source_hash"), F.col("redactions_count")),
        ).alias("redaction_key"),
        hashing.size_bytes(text).alias("size_bytes"),
        "redactions_count",
        "match_count",
        "images_stripped",
        "changed",
    )


def collect_summary(collected: DataFrame) -> DataFrame:
    """Counts per outcome. Sessions on the reject list are counted as such; the reference
    reports them as unchanged."""

    def count(name: str) -> Column:
        return F.count_if(F.col("outcome") == name).alias(name)

    names = ["collected", "unchanged", "rejected", "on_reject_list", "failed"]
    return collected.agg(*[count(n) for n in names], F.count("*").alias("total"))


def redaction_report(collected: DataFrame) -> DataFrame:
    """One report per collected session: hashes, counts, its first redacted leaves and all of
    them. The arrays are bounded by the session they describe."""
    leaves = F.transform(
        F.filter("changed", lambda r: F.size(r["findings"]) > 0),
        lambda r: F.struct(
            r["path"].alias("path"), r["text"].alias("text"), r["findings"].alias("redactions")
        ),
    )
    done = collected.where("outcome = 'collected'").withColumn("redaction_details", leaves)
    return done.select(
        *KEY,
        "source_hash",
        "redacted_hash",
        "redaction_key",
        "redactions_count",
        "images_stripped",
        F.slice("redaction_details", 1, REPORTED_LEAVES).alias("redactions"),
        "redaction_details",
    )


def manifest_rows(collected: DataFrame, rules_hash: str | None = None) -> DataFrame:
    """Manifest entries of the collected sessions."""
    return collected.where("outcome = 'collected'").select(
        *MANIFEST_COLUMNS,
        hashing.created_at().alias("created_at"),
        F.lit(rules_hash).cast("string").alias("rules_hash"),
    )
