"""Content hashes and the fingerprint of a rule set."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.detectors import DETECTOR_TABLE, EXTRA_RULES


def source_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def redaction_key(source: Column, redactions: Column) -> Column:
    """SHA-256 of ``v1:<source_hash>:<redactions_count>``."""
    return F.sha2(F.concat_ws(":", F.lit("v1"), source, redactions.cast("string")), 256)


def redacted_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def size_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def created_at() -> Column:
    return F.current_timestamp()


def rules_fingerprint(
    secrets: DataFrame | None = None,
    deny: Iterable[str] = (),
    strip_images: bool = False,
    salt: str = "",
    extra_rules: Iterable[str] = (),
) -> str:
    """One hash for everything that decides what redaction does.

    The secrets enter as an order-free combination of their hashes, computed by Spark: two
    numbers and a count reach the driver, however many secrets there are.
    """
    extra = [vars(EXTRA_RULES[name]) for name in sorted(extra_rules)]
    parts = [DETECTOR_TABLE, sorted(deny), strip_images, salt, *([extra] if extra else [])]
    if secrets is not None:
        sha = F.sha2(F.col("value"), 256)
        halves = [F.conv(F.substring(sha, at, 15), 16, 10).cast("bigint") for at in (1, 16)]
        row = secrets.select("value").distinct().agg(
            F.count("*"), *[F.coalesce(F.bit_xor(h), F.lit(0)) for h in halves]
        )
        parts.append(list(row.first()))
    return hashlib.sha256(json.dumps(parts).encode("utf-8")).hexdigest()
