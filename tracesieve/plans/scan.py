"""The scan run: from scanner output to reports, totals and blocking reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracesieve.operators import findings as fnd
from tracesieve.operators.joins import cut_lineage


@dataclass(frozen=True)
class Scan:
    findings: DataFrame
    reports: DataFrame
    totals: DataFrame
    blocking: DataFrame


def assess(files: DataFrame, found: DataFrame, content: str = "content") -> Scan:
    """Assess findings (parsed, possibly repeated) of the scanned ``files`` (``file, content``).

    Copies are dropped before findings meet the files, so that a flood of repeated findings
    never reaches the join. What is left is stored once: all results derive from it.
    """
    known = cut_lineage(fnd.attach_source(fnd.dedup_findings(found), files))
    reports = fnd.scan_reports(files, known, content)
    return Scan(known, reports, fnd.scan_totals(reports), fnd.blocking_reasons(reports))


def scan_lines(files: DataFrame, lines: DataFrame, content: str = "content") -> Scan:
    """Assess raw scanner output lines (column ``value``)."""
    return assess(files, fnd.parse_findings(lines), content)
