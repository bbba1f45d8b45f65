"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)

Every query runs to completion into a sink that discards rows. Times are the second of two
runs and include planning; the first one pays for starting the JVM's compilers and Python.
"""

from __future__ import annotations

import json
import os
import time

from tracesieve.plans import catalog
from tracesieve.session import local_session

HEADLINE = [
    "redact_patterns",
    "redact_patterns_text",
    "redacted_text",
    "detector_counts",
    "redact_literals",
    "redact_literals_joined",
    "redact_text",
    "re_redact",
    "residual_scan",
    "redact_object",
    "json_leaves",
    "strip_images",
    "extract_images",
    "collect",
    "collect_with_long_lists",
    "collect_with_secrets",
    "collect_summary",
    "upsert_manifest",
    "grep_sessions",
    "drop_unchanged",
    "parse_findings",
    "dedup_findings",
    "scan_reports",
    "blocking_reasons",
    "upload_plan",
    "workspace_stats",
    "trajectory_steps",
    "tool_calls",
    "observations",
    "session_listing",
]


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    times = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        timed(query, spark, sf_dir)
        times[name] = round(timed(query, spark, sf_dir), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
