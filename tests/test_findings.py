import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracesieve.functions.text import normalize_path
from tracesieve.operators import findings as fnd
from tracesieve.operators import manifest
from tracesieve.plans import scan


def line(detector="Aws", file="/r/a.json", **fields):
    doc = {"DetectorName": detector, **fields}
    at = {"file": file}
    if "line" in doc:
        at["line"] = doc.pop("line")
    doc["SourceMetadata"] = {"Data": {"Filesystem": at}}
    return json.dumps(doc)


def lines_df(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_parse(spark):
    texts = [
        "scanning ...",
        "",
        line(Raw="abcdefghijkl", Verified=True, DecoderName="PLAIN", line=3) + " ",
        line(5),
        '{"DetectorName":"torn"',
        '{"DetectorName":"two"} {}',
        '[{"DetectorName":"list"}]',
        line("B", DecoderName=7, Verified="true", Raw=12, line="9"),
        json.dumps({"DetectorName": "C", "SourceMetadata": None}),
    ]
    rows = {r["detector"]: r for r in fnd.parse_findings(lines_df(spark, texts)).collect()}
    assert set(rows) == {"Aws", "B", "C"}
    aws, b, c = rows["Aws"], rows["B"], rows["C"]
    assert (aws["decoder"], aws["status"], aws["line"], aws["masked"]) == ("PLAIN", "verified", 3, "abcd***ijkl")
    assert aws["raw_sha256"] == hashlib.sha256(b"abcdefghijkl").hexdigest()
    assert (b["decoder"], b["status"], b["line"], b["raw_sha256"], b["masked"]) == (None, "unverified", None, None, "[REDACTED]")
    assert (c["file"], c["line"]) == ("", None)


@pytest.mark.parametrize(
    "extra, status",
    [
        ({}, "unverified"),
        ({"error": "late"}, "unknown"),
        ({"verification_error": "", "verificationError": "x"}, "unknown"),
        ({"verification_error": " ", "error": "hidden"}, "unverified"),
        ({"verification_error": 5}, "unverified"),
        ({"verification_error": "\t"}, "unverified"),
        (None, "unverified"),
    ],
)
def test_status(spark, extra, status):
    df = lines_df(spark, [line(ExtraData=extra)])
    assert fnd.parse_findings(df).first()["status"] == status


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/r/a.json", "/r/a.json"),
        ("file:///r/a.json", "/r/a.json"),
        ("/r/./a.json", "/r/a.json"),
        ("/r//x/../a.json", "/r/a.json"),
        ("/r/x/y/../../a.json", "/r/a.json"),
        ("./a.json", "a.json"),
        ("/r/.hidden.json", "/r/.hidden.json"),
        ("/r/a/", "/r/a"),
    ],
)
def test_normalize_path(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(normalize_path(F.col("p"))).first()[0] == expected


@pytest.fixture(scope="module")
def result(spark):
    texts = [
        line("b", Raw="secret-one-1", line=2),
        line("b", Raw="secret-one-1", line=2),
        line("b", Raw="secret-one-1", line=2, file="/r/./a.json"),
        line("B", Raw="secret-two-2", line=2),
        line("a", Raw="secret-three", Verified=True),
        line("c", Raw="s", line=1, ExtraData={"error": "e"}),
        line("x", Raw="elsewhere-1", file="/other/a.json"),
        *[line(f"d{i}", Raw=f"secret-{i:05d}", file="/r/b.json", line=i) for i in range(12)],
    ]
    files = spark.createDataFrame(
        [("/r/a.json", "A"), ("/r/b.json", "B"), ("/r/none.json", "N")], "file string, content string"
    )
    return scan.scan_lines(files, lines_df(spark, texts))


def test_reports(result):
    reports = {r["file"]: r for r in result.reports.collect()}
    assert set(reports) == {"/r/a.json", "/r/b.json", "/r/none.json"}
    a, b, none = (reports[f"/r/{n}.json"] for n in ("a", "b", "none"))
    assert (a["findings"], a["verified"], a["unverified"], a["unknown"]) == (4, 1, 2, 1)
    assert a["top_detectors"] == ["a", "b", "B", "c"]
    assert a["examples"] == ["c:***", "b:secr***ne-1", "B:secr***wo-2", "a:secr***hree"]
    assert a["redacted_hash"] == hashlib.sha256(b"A").hexdigest()
    assert (len(b["top_detectors"]), len(b["examples"])) == (8, 5)
    assert b["top_detectors"][:3] == ["d0", "d1", "d10"]
    assert (none["findings"], none["top_detectors"], none["examples"]) == (0, [], [])


def test_blocking_and_totals(result):
    blocking = {r["file"]: r for r in result.blocking.collect()}
    assert set(blocking) == {"/r/a.json", "/r/b.json"}
    assert blocking["/r/a.json"]["missed_sensitive_data"] == "yes"
    assert blocking["/r/b.json"]["missed_sensitive_data"] == "maybe"
    assert blocking["/r/a.json"]["evidence"] == (
        "verified=1, unknown=1, unverified=2, detectors=a, b, B, c, "
        "examples=c:***, b:secr***ne-1, B:secr***wo-2, a:secr***hree"
    )
    totals = result.totals.first()
    assert (totals["total_findings"], totals["verified_count"], totals["scanned_files"]) == (16, 1, 3)
    none = result.reports.where("findings = 0").select(fnd.evidence()).first()[0]
    assert none == "verified=0, unknown=0, unverified=0, detectors=none"


def test_totals_of_nothing(result):
    totals = fnd.scan_totals(result.reports.limit(0)).first()
    assert tuple(totals) == (0, 0, 0, 0, 0)


def test_order_details_and_reject(spark, result):
    ordered = fnd.order_findings(result.findings.where("file = '/r/a.json'")).collect()
    assert [r["detector"] for r in ordered] == ["c", "b", "B", "a"]
    details = {r["detail"] for r in fnd.finding_details(result.findings).collect()}
    assert "[VERIFIED] a: secr***hree" in details and "[UNKNOWN] c L1: ***" in details
    reject = spark.createDataFrame([("old.json",)], "filename string")
    names = sorted(r[0] for r in fnd.auto_reject(reject, result.reports).collect())
    assert names == ["a.json", "old.json"]
    assert manifest.add_rejected(reject, reject).count() == 1


def test_one_file_with_a_third_of_all_findings(spark):
    """Joined as if the file list were long; counted against a plain aggregation."""
    from tracesieve.operators.joins import salted_join

    found = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "/r/hot.json").otherwise(F.concat(F.lit("/r/"), F.col("id") % 50)).alias("file"),
        F.concat(F.lit("d"), F.col("id") % 11).alias("detector"),
        F.lit("unverified").alias("status"),
        F.col("id").alias("line"),
        F.sha2(F.col("id").cast("string"), 256).alias("raw_sha256"),
        F.lit("***").alias("masked"),
    )
    files = found.select("file").distinct().where("file <> '/r/7'")
    kept = salted_join(found, files, ["file"], ["line", "detector"], "left_semi")
    assert kept.count() == found.where("file <> '/r/7'").count()
    hot = fnd.summarize_findings(kept).where("file = '/r/hot.json'").first()
    assert hot["findings"] == 3000


def test_residual_scan_lines(spark):
    key, npm = "AKIA" + "C" * 16, "npm_" + "d" * 36
    text = f"first\n{key}\n\n{npm} {npm} {key}"
    df = spark.createDataFrame([("f", text), ("clean", "a\nb")], "file string, text string")
    rows = fnd.residual_scan(df).collect()
    got = sorted((r["line"], r["detector"], r["masked"]) for r in rows)
    assert got == [
        (2, "AWS_ACCESS_KEY", "AKIA***CCCC"),
        (4, "AWS_ACCESS_KEY", "AKIA***CCCC"),
        (4, "NPM_TOKEN", "npm_dddd***dddd"),
        (4, "NPM_TOKEN", "npm_dddd***dddd"),
    ]


def test_paths_with_any_depth_of_parents(spark):
    given = {"/" + "/".join("abcdefghijkl"[:n]) + "/.." * n + "/z": "/z" for n in range(1, 13)}
    given |= {"/../r/x.json": "/r/x.json", "a/../../b": "../b", "file:///a//b/./c/": "/a/b/c", "/a/..": "/"}
    rows = spark.createDataFrame([(p,) for p in given], "p string").select("p", normalize_path(F.col("p")).alias("q"))
    assert {r.p: r.q for r in rows.collect()} == given
