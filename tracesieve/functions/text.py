"""Small column functions: placeholders, masks, counts, names and bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def let_sql(value: Column, name: str, body: str) -> Column:
    """:func:`let` with a body in SQL text, where ``name`` is the bound value.

    Large bodies are much quicker to build as one text than call by call.
    """
    return F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}"))[0]


def sql_string(text: str) -> str:
    """``text`` as a SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def once(value: Column) -> Column:
    """Compute an expensive column exactly once; use it in ``select``.

    Catalyst merges neighbouring projections and pushes filters through them, copying an
    expression to every place that reads it. It does neither through a generator, and this
    one emits its single value unchanged.
    """
    return F.explode(F.array(value))


def placeholder(value: Column, salt: str = "") -> Column:
    """``[REDACTED:<first 8 hex of SHA-256>]``; a salt makes weak secrets harder to guess."""
    salted = F.concat(F.lit(salt), value) if salt else value
    return F.concat(F.lit("[REDACTED:"), F.left(F.sha2(salted, 256), F.lit(8)), F.lit("]"))


def count_occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle``; 0 for an empty needle."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(needle == "", F.lit(0).cast("bigint")).otherwise(
        (removed / F.length(needle)).cast("bigint")
    )


def mask_secret(raw: Column) -> Column:
    """Keep only the ends of a secret: ``abcd***wxyz``.

    Eight characters or fewer become ``***``. Tokens starting ``npm_`` keep up to eight
    leading characters. A missing or empty value gives ``[REDACTED]``.
    """
    n = F.length(raw)
    keep = F.when(raw.startswith("npm_"), F.lit(8)).otherwise(F.lit(4))
    head = F.least(keep, n - 4)
    tail = F.least(F.lit(4), n - head)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("[REDACTED]"))
        .when(n <= 8, F.lit("***"))
        .otherwise(F.concat(F.left(raw, head), F.lit("***"), F.right(raw, tail)))
    )


def trimmed(value: Column) -> Column:
    """``value`` without white space around it."""
    return F.btrim(value, F.lit(" \t\r\n\f\x0b"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def normalize_path(path: Column) -> Column:
    """Drop a scheme, ``.`` parts, doubled slashes, ``x/..`` pairs and a trailing slash.

    ``..`` at the root of an absolute path vanishes, at the beginning of a relative one it
    stays. Plain paths, nearly all of them, are only tested.
    """
    plain = ~path.rlike(r"^file:|^\./|/\.|//|\.\.|./$")
    return F.when(plain, path).otherwise(_normalized(path))


def _normalized(path: Column) -> Column:
    p = F.regexp_replace(path, r"^file:(//)?(?=/)", "")
    absolute = p.startswith("/")

    def step(done: Column, part: Column) -> Column:
        climbs = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        up = (
            F.when(climbs, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.array_append(done, part))
        )
        return (
            F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))
        )

    start = F.array().cast("array<string>")
    parts = F.aggregate(F.split(p, "/", -1), start, step)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def kilobytes(size: Column) -> Column:
    """Bytes to KB with one decimal."""
    return F.round(size / F.lit(1024), 1)


def unicode_order(value: Column) -> Column:
    """Sort key in language order (a, B, c) rather than byte order (B, a, c)."""
    return F.collate(value, "UNICODE")


def _none_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[_none_if_empty(v) for v in values])
