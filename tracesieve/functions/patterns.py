"""User-supplied regexes: validation and combination."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Patterns:
    valid: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


def compile_patterns(spark: SparkSession, lines: Iterable[str]) -> Patterns:
    """Trim, drop blanks, and set aside regexes Spark cannot compile.

    Each pattern is tried on a constant, which the optimizer folds without starting a job.
    The reference drops invalid patterns silently; here they are returned as well.
    """
    valid, dropped = [], []
    for line in lines:
        pattern = line.strip()
        if not pattern:
            continue
        try:
            spark.sql("SELECT '' RLIKE :p AS ok", args={"p": pattern}).collect()
            valid.append(pattern)
        except PySparkException:
            dropped.append(pattern)
    return Patterns(valid, dropped)


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True when any regex is found in ``text``.

    Plain patterns share one alternation, so the text is decoded and scanned once. Those
    with group references, named groups, quoting or inline flags would change meaning inside it and stay apart.
    """
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    apart = [p for p in patterns if re.search(r"\\[1-9kQE]|\(\?[^:=!]", p)]
    together = [p for p in patterns if p not in apart]
    tests = [text.rlike(p) for p in apart]
    if together:
        tests.insert(0, text.rlike("|".join(f"(?:{p})" for p in together)))
    return reduce(lambda a, b: a | b, tests)
