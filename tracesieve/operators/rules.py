"""Which sessions are processed, listed and searched."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.patterns import matches_any
from tracesieve.operators.joins import fits_broadcast, sized_join

KEY = ["source_dir", "filename"]


def drop_rejected(sessions: DataFrame, reject: DataFrame, name: str = "filename") -> DataFrame:
    """Sessions whose name is not on the reject list.

    The same name may occur in very many directories, so a long list is joined salted.
    """
    names = reject.select(F.col("filename").alias(name)).distinct()
    return sized_join(sessions, names, [name], "left_anti", spread=_spread(sessions, name))


def mark_rejected(
    sessions: DataFrame, reject: DataFrame, flag: str = "rejected", small: bool | None = None
) -> DataFrame:
    """Add whether each session's name is on the reject list."""
    names = reject.select("filename").distinct().withColumn(flag, F.lit(True))
    spread = _spread(sessions, "filename")
    joined = sized_join(sessions, names, ["filename"], "left", spread, small)
    return joined.select(*sessions.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def _spread(df: DataFrame, name: str) -> list[str]:
    others = [c for c in ("source_dir", "source_hash") if c in df.columns]
    return others or [name]


def denied_by_name(filename: Column, deny: Iterable[str]) -> Column:
    """Constant patterns on a file name also prune ``binaryFile`` scans when the column is
    the file name metadata."""
    return matches_any(filename, deny)


def denied_by_content(compact_json: Column, deny: Iterable[str]) -> Column:
    """Deny patterns see the compact JSON before redaction, and are case-sensitive."""
    return matches_any(compact_json, deny)


def comparable(prev: DataFrame, rules_hash: str | None = None) -> DataFrame:
    """Keys and hashes of the manifest rows that were made under the given rules."""
    if rules_hash is not None and "rules_hash" in prev.columns:
        prev = prev.where(F.col("rules_hash") == rules_hash)
    return prev.select(*KEY, "source_hash").distinct()


def mark_unchanged(
    hashed: DataFrame,
    prev: DataFrame,
    rules_hash: str | None = None,
    flag: str = "unchanged",
    small: bool | None = None,
) -> DataFrame:
    """Flag sessions whose ``source_hash`` is the one in the previous manifest.

    With ``rules_hash``, manifest rows made under other rules do not count, so a new secret
    or deny pattern causes everything to be redacted again. (The reference compares the
    source only and needs a manual force.) ``hashed`` should be narrow: a manifest grows
    with the sessions and this join may shuffle. Its keys are unique on both sides, so no
    task gets more than its share.
    """
    seen = comparable(prev, rules_hash).withColumn(flag, F.lit(True))
    if fits_broadcast(seen) if small is None else small:
        seen = F.broadcast(seen)
    joined = hashed.join(seen, [*KEY, "source_hash"], "left")
    return joined.select(*hashed.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def drop_unchanged(
    hashed: DataFrame, prev: DataFrame, force: bool = False, rules_hash: str | None = None
) -> DataFrame:
    if force:
        return hashed
    return mark_unchanged(hashed, prev, rules_hash, "_same").where("not _same").drop("_same")


def grep_sessions(
    sessions: DataFrame,
    reject: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    content: str = "content",
) -> DataFrame:
    """Sessions that may be published and whose whole redacted text matches.

    The text is searched where it is read; only the names that match meet the reject list and, where
    sessions have copies (``created_at``), the newest copies.
    """
    searched = f"(?i){pattern}" if ignore_case else pattern
    matching = sessions.where(F.col(content).rlike(searched))
    if "created_at" in sessions.columns:
        newest = sessions.groupBy(*KEY).agg(F.max("created_at").alias("created_at"))
        matching = matching.select(*KEY, "created_at").join(newest, [*KEY, "created_at"], "left_semi").distinct()
    return drop_rejected(matching.select(*KEY), reject)


def grep_count(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("sessions_matched"))


def list_sessions(sessions: DataFrame, reject: DataFrame | None = None) -> DataFrame:
    """Names in order; with a reject list, only those that may be published."""
    names = sessions.select(*KEY)
    if reject is not None:
        names = drop_rejected(names, reject)
    return names.orderBy("filename", "source_dir")


def search_names(sessions: DataFrame, query: str) -> DataFrame:
    """Names that contain ``query``, whatever the case; an empty query keeps all."""
    return sessions.where(F.lower("filename").contains(query.lower()))


def only_verified(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status") == "verified")
