import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracesieve.operators import hashing, manifest, rules
from tracesieve.operators.literals import parse_secrets
from tracesieve.plans import collect as col

KEY = "AKIA" + "Z" * 16


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


FILES = {
    ("a", "plain.json"): json.dumps({"t": "hello"}),
    ("a", "key.json"): json.dumps({"t": KEY, "u": [KEY]}),
    ("a", "same.json"): json.dumps({"t": "same"}),
    ("a", "edited.json"): json.dumps({"t": "edited"}),
    ("a", "listed.json"): json.dumps({"t": "listed"}),
    ("b", "listed.json"): json.dumps({"t": "listed too"}),
    ("b", "private-1.json"): "not even json",
    ("b", "topic.json"): json.dumps({"t": "the forbidden topic"}),
    ("b", "upper.json"): json.dumps({"t": "the FORBIDDEN topic"}),
    ("b", "bad.jsonl"): '{"a":1}\n{',
    ("b", "lines.jsonl"): '{"a":1}\n{"t":"x"}',
}
EXPECTED = {
    ("a", "plain.json"): "collected",
    ("a", "key.json"): "collected",
    ("a", "same.json"): "unchanged",
    ("a", "edited.json"): "collected",
    ("a", "listed.json"): "on_reject_list",
    ("b", "listed.json"): "on_reject_list",
    ("b", "private-1.json"): "rejected",
    ("b", "topic.json"): "rejected",
    ("b", "upper.json"): "collected",
    ("b", "bad.jsonl"): "failed",
    ("b", "lines.jsonl"): "collected",
}


@pytest.fixture(scope="module")
def inputs(spark):
    sessions = spark.createDataFrame(
        [(d, f, c) for (d, f), c in FILES.items()],
        "source_dir string, filename string, content string",
    )
    reject = spark.createDataFrame([("listed.json",), ("gone.json",)], "filename string")
    prev = spark.createDataFrame(
        [
            ("a", "same.json", sha(FILES["a", "same.json"]), "r1"),
            ("a", "edited.json", sha("before"), "r1"),
            # Same name and content in another directory must not count.
            ("z", "plain.json", sha(FILES["a", "plain.json"]), "r1"),
        ],
        "source_dir string, filename string, source_hash string, rules_hash string",
    )
    return sessions, {"reject": reject, "prev": prev, "deny": ["^private", "forbidden"]}


def outcomes(df):
    return {(r["source_dir"], r["filename"]): r["outcome"] for r in df.collect()}


@pytest.mark.parametrize("small", [None, True, False])
def test_outcomes(spark, inputs, small):
    sessions, options = inputs
    done = col.collect(sessions, small=small, **options)
    assert outcomes(done) == EXPECTED
    summary = col.collect_summary(done).first().asDict()
    assert summary == {
        "collected": 5,
        "unchanged": 1,
        "rejected": 2,
        "on_reject_list": 2,
        "failed": 1,
        "total": 11,
    }
    for r in done.collect():
        assert (r["redacted"] is None) == (r["outcome"] != "collected")
        assert (r["error"] is None) == (r["outcome"] != "failed")


def test_long_lists_with_checkpoint(spark, inputs, tmp_path):
    """The same through a stored decision table."""
    sessions, options = inputs
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert outcomes(col.collect(sessions, small=False, **options)) == EXPECTED
    assert list(tmp_path.rglob("part-*"))


def test_force_and_rules(spark, inputs):
    sessions, options = inputs
    forced = outcomes(col.collect(sessions, force=True, **options))
    assert forced["a", "same.json"] == "collected"
    old = outcomes(col.collect(sessions, rules_hash="r1", **options))
    new = outcomes(col.collect(sessions, rules_hash="r2", **options))
    assert old["a", "same.json"] == "unchanged"
    assert new["a", "same.json"] == "collected"


def test_rules_fingerprint(spark):
    def fingerprint(lines, **options):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "line string, line_no int")
        return hashing.rules_fingerprint(parse_secrets(df), **options)

    base = fingerprint(["first-secret", "second-secret"])
    assert fingerprint(["second-secret", "first-secret"]) == base
    assert fingerprint(["first-secret"]) != base
    assert fingerprint(["first-secret", "second-secret"], deny=["x"]) != base
    assert hashing.rules_fingerprint() != base


def test_hashes_and_report(spark, inputs):
    sessions, options = inputs
    done = col.collect(sessions, **options)
    row = done.where("filename = 'key.json'").first()
    text = '{"t":"[REDACTED:AWS_ACCESS_KEY]","u":["[REDACTED:AWS_ACCESS_KEY]"]}'
    source = sha(FILES["a", "key.json"])
    assert row["redacted"] == text
    assert row["redacted_hash"] == sha(text)
    assert row["size_bytes"] == len(text)
    assert row["redaction_key"] == sha(f"v1:{source}:2")
    report = col.redaction_report(done).where("filename = 'key.json'").first()
    assert [r["path"] for r in report["redactions"]] == ["$.t", "$.u[0]"]
    assert report["redactions"][0]["redactions"][0]["detector"] == "AWS_ACCESS_KEY"
    assert col.manifest_rows(done, "r1").count() == 5


def test_report_head_is_short(spark):
    tree = [KEY] * 25
    df = spark.createDataFrame([("d", "f.json", json.dumps(tree))], "source_dir string, filename string, content string")
    report = col.redaction_report(col.collect(df)).first()
    assert (len(report["redactions"]), len(report["redaction_details"])) == (20, 25)


def test_upsert(spark):
    schema = "source_dir string, filename string, source_hash string, created_at timestamp"
    import datetime as dt

    day = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    old = spark.createDataFrame([("d", "a", "1", day[2]), ("d", "b", "2", day[0])], schema)
    new = spark.createDataFrame(
        [("d", "a", "3", day[1]), ("d", "c", "4", day[0]), ("d", "c", "5", day[1])], schema
    )
    rows = manifest.upsert_manifest(old, new).orderBy("filename").collect()
    # The new row wins even when it is older.
    assert [(r["filename"], r["source_hash"]) for r in rows] == [("a", "3"), ("b", "2"), ("c", "5")]
    latest = manifest.session_metadata(old.union(new), "a").first()
    assert latest["source_hash"] == "1"


def test_reject_list_edits(spark):
    reject = spark.createDataFrame([("a.json",), ("b.json",)], "filename string")
    names = spark.createDataFrame([("/x/y/b.json",), ("c.json",), ("z/c.json",)], "filename string")
    added = sorted(r[0] for r in manifest.add_rejected(reject, names).collect())
    left = sorted(r[0] for r in manifest.remove_rejected(reject, names).collect())
    assert added == ["a.json", "b.json", "c.json"]
    assert left == ["a.json"]


def test_one_name_in_very_many_directories(spark):
    """A name that a third of all sessions share, with a reject list taken as long."""
    from tracesieve.operators.joins import salted_join

    sessions = spark.range(3000).select(
        F.concat(F.lit("dir"), "id").alias("source_dir"),
        F.when(F.col("id") % 3 == 0, "session.json")
        .otherwise(F.concat(F.lit("s"), "id", F.lit(".json")))
        .alias("filename"),
    )
    reject = spark.createDataFrame([("session.json",), ("s1.json",)], "filename string")
    kept = salted_join(sessions, reject, ["filename"], ["source_dir"], "left_anti")
    assert kept.count() == 3000 - 1000 - 1
    assert rules.drop_rejected(sessions, reject).count() == 1999
    flagged = rules.mark_rejected(sessions, reject, small=False)
    assert flagged.count() == 3000
    assert flagged.where("rejected").count() == 1001


def test_grep(spark, inputs):
    sessions, options = inputs
    case = rules.grep_sessions(sessions, options["reject"], "forb.*topic")
    any_case = rules.grep_sessions(sessions, options["reject"], "forb.*topic", ignore_case=True)
    assert [r["filename"] for r in case.collect()] == ["topic.json"]
    assert rules.grep_count(any_case).first()[0] == 2
    assert rules.grep_sessions(sessions, options["reject"], "listed").count() == 0
