"""Redaction of JSON sessions of any shape, leaf by leaf.

A session stays one row throughout: its string leaves are an array column, so neither
redaction nor rebuilding shuffles any content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.detectors import any_may_match
from tracesieve.functions.json_tree import parsed, with_leaves
from tracesieve.functions.text import let, let_sql, once
from tracesieve.operators.literals import (
    PRESENT_TYPE,
    attach_present,
    literal_findings,
    replace_literals,
)
from tracesieve.operators.redaction import findings_from_hits, scan_text

IMAGE_REMOVED = "[IMAGE_REMOVED]"

# A string counts as an image from 257 characters on; a base64 run is
# extracted from 100 characters on.
IMAGE_STRING_OVER = 256
DATA_URI = r"data:image/(\w+);base64,([A-Za-z0-9+/=]{100,})"


_FINDING = "struct<detector:string,severity:string,replacement:string,count:bigint>"


def json_leaves(df: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """One row per string leaf: ``keys, leaf, path, value, mime``. Sessions that are not
    JSON have none."""
    listed = df.select(*keys, once(parsed(F.col(content))["leaves"]).alias("_leaves"))
    rows = listed.select(*keys, F.explode("_leaves").alias("l"))
    return rows.select(*keys, "l.leaf", "l.path", "l.value", "l.mime")


def is_image(value: Column, mime: Column) -> Column:
    """A long data URI, or long ``data`` beside an image ``mimeType``; one leaf counts once."""
    return (F.length(value) > IMAGE_STRING_OVER) & (
        value.startswith("data:image/") | F.coalesce(mime.startswith("image/"), F.lit(False))
    )


def strip_images(leaves: DataFrame, value: str = "value", mime: str = "mime") -> DataFrame:
    """Replace image leaves by ``[IMAGE_REMOVED]`` and mark them."""
    image = is_image(F.col(value), F.col(mime))
    return leaves.withColumn("image", image).withColumn(
        value, F.when(F.col("image"), F.lit(IMAGE_REMOVED)).otherwise(F.col(value))
    )


def _leaf_result(leaf: Column, secrets: Column | None, images: bool, extra: Sequence[str]) -> Column:
    none = F.array().cast(f"array<{_FINDING}>")

    def finish(lit: Column) -> Column:
        def result(scan: Column) -> Column:
            found = findings_from_hits(scan["hits"])
            if secrets is not None:
                found = F.concat(literal_findings(lit["found"]), found)
            image = is_image(scan["text"], leaf["mime"]) if images else F.lit(False)
            return F.struct(
                leaf["leaf"].alias("leaf"),
                leaf["path"].alias("path"),
                F.when(image, F.lit(IMAGE_REMOVED)).otherwise(scan["text"]).alias("text"),
                found.alias("findings"),
                image.alias("image"),
            )

        return let(scan_text(lit["text"], extra), result)

    if secrets is None:
        start = F.struct(leaf["value"].alias("text"), none.alias("found"))
        return let(start, finish)
    present = F.filter(secrets, lambda s: leaf["value"].contains(s["value"]))
    return let(let(present, lambda own: replace_literals(leaf["value"], own)), finish)


def redacted_leaves(leaves: Column, secrets: Column | None, images: bool, extra: Sequence[str] = ()) -> Column:
    """Result of every leaf that changes; the others are passed over after cheap tests."""

    def may_change(leaf: Column) -> Column:
        test = let_sql(leaf["value"], "t", any_may_match("t", extra))
        if secrets is not None:
            test = test | F.exists(secrets, lambda s: leaf["value"].contains(s["value"]))
        if images:
            test = test | is_image(leaf["value"], leaf["mime"])
        return F.coalesce(test, F.lit(False))

    done = F.transform(
        F.filter(leaves, may_change), lambda leaf: _leaf_result(leaf, secrets, images, extra)
    )
    return F.filter(done, lambda r: (F.size(r["findings"]) > 0) | r["image"])


def with_parsed(df: DataFrame, content: Column, kept: Sequence[str]) -> DataFrame:
    """``kept`` columns plus ``_ok``, ``_error``, ``_compact`` and ``_leaves`` of the session text."""
    done = df.select(*kept, once(parsed(content)).alias("_p"))
    parts = [F.col(f"_p.{f}").alias(f"_{f}") for f in ("ok", "error", "compact", "leaves")]
    return done.select(*kept, *parts)


def with_redaction(
    df: DataFrame,
    keys: Sequence[str],
    secrets: DataFrame | None = None,
    images: bool = False,
    extra: Sequence[str] = (),
    **bounds: int,
) -> DataFrame:
    """Replace ``_compact`` and ``_leaves`` by ``changed`` (array of leaf results) and
    ``redacted`` (compact JSON).

    Literal secrets are looked for once per session, in all leaves joined by a NUL byte
    (which no secret contains), and only those present are tried on single leaves.
    """
    leaves, compact = F.col("_leaves"), F.col("_compact")
    kept = [c for c in df.columns if c not in ("_leaves", "_compact")]
    held = None
    if secrets is not None:
        joined = F.array_join(F.transform(leaves, lambda x: x["value"]), "\0")
        df = attach_present(
            df.withColumn("_joined", joined), "_joined", secrets, keys, "_secrets", **bounds
        ).drop("_joined")
        held = F.coalesce(F.col("_secrets"), F.array().cast(PRESENT_TYPE))
    df = df.select(
        *kept, "_compact", once(redacted_leaves(leaves, held, images, extra)).alias("changed")
    )
    rewrite = F.size("changed") > 0
    new = with_leaves(
        F.when(rewrite, compact),
        F.transform("changed", lambda r: F.struct(r["leaf"].alias("leaf"), r["text"].alias("text"))),
    )
    return df.withColumn("_new", new).select(
        *kept,
        "changed",
        F.coalesce(F.col("_new"), compact).alias("redacted"),
    )


def redact_object(
    df: DataFrame,
    content: str = "content",
    keys: Sequence[str] = ("source_dir", "filename"),
    secrets: DataFrame | None = None,
    images: bool = False,
    extra: Sequence[str] = (),
    **bounds: int,
) -> DataFrame:
    """Redact every string leaf of each JSON session; keys, numbers and booleans stay. ``extra`` names
    rules beside the detectors (``email``, ``key_value``).

    Adds ``redacted`` (compact JSON, null when not JSON), ``redactions_count`` (leaves with a
    finding), ``match_count`` (single matches), ``images_stripped`` and ``changed``.
    """
    listed = with_parsed(df, F.col(content), df.columns).drop("_ok", "_error")
    done = with_redaction(listed, keys, secrets, images, extra, **bounds)
    return done.select("*", *redaction_counts(F.col("changed")))


def redaction_counts(changed: Column) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    found = F.filter(changed, lambda r: F.size(r["findings"]) > 0)
    return [
        F.size(found).cast("bigint").alias("redactions_count"),
        F.aggregate(
            found,
            zero,
            lambda n, r: n + F.aggregate(r["findings"], zero, lambda m, f: m + f["count"]),
        ).alias("match_count"),
        F.size(F.filter(changed, lambda r: r["image"])).cast("bigint").alias("images_stripped"),
    ]


def leaf_findings(redacted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per finding with its JSON path, from the result of :func:`redact_object`."""
    leaves = redacted.select(*keys, F.explode("changed").alias("l"))
    rows = leaves.select(*keys, "l.path", F.explode("l.findings").alias("f"))
    return rows.select(
        *keys, "path", "f.detector", "f.severity", "f.replacement", "f.count"
    )


def extract_images(
    df: DataFrame, content: str = "content", filename: str = "filename", keys: Sequence[str] = ()
) -> DataFrame:
    """One row per embedded base64 image: name, index in its session, bytes.

    Padding is repaired before decoding, so runs cut off in the middle decode as far as they
    go instead of failing.
    """
    uris = F.regexp_extract_all(content, F.lit(DATA_URI), F.lit(0))
    found = df.select(*keys, filename, once(uris).alias("_uris")).select(
        *keys,
        filename,
        F.posexplode("_uris").alias("image_index", "_uri"),
    )
    ext = F.regexp_extract("_uri", DATA_URI, 1)
    b64 = F.regexp_extract(F.regexp_extract("_uri", DATA_URI, 2), r"^[A-Za-z0-9+/]*", 0)
    safe = F.regexp_replace(
        F.regexp_replace(F.col(filename), r"\.(json|jsonl)$", ""), r"[^a-zA-Z0-9_-]", "_"
    )
    usable = F.left(b64, F.length(b64) - F.when(F.length(b64) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(usable, F.ceil(F.length(usable) / 4).cast("int") * 4, F.lit("="))
    return found.select(
        *keys,
        filename,
        F.col("image_index").cast("bigint").alias("image_index"),
        F.concat(safe, F.lit("_img"), F.col("image_index"), F.lit("."), ext).alias("image_name"),
        F.unbase64(padded).alias("image"),
    )
