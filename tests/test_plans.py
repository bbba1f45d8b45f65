"""The physical plans are part of what is promised."""

import re

from pyspark.sql import functions as F

from tracesieve.operators import findings as fnd
from tracesieve.operators import json_redaction as jr
from tracesieve.operators import literals as lit
from tracesieve.operators import manifest, rules
from tracesieve.operators import redaction as red
from tracesieve.operators import trajectories as tr
from tracesieve.plans import collect as col
from tracesieve.plans import scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sessions(spark, tmp_path):
    path = str(tmp_path / "sessions")
    spark.range(20).select(
        F.lit("d").alias("source_dir"),
        F.concat(F.lit("f"), "id").alias("filename"),
        F.lit('{"t":"text"}').alias("content"),
        F.lit("unused").alias("other"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_redaction_does_not_shuffle(spark, tmp_path):
    df = sessions(spark, tmp_path)
    for done in (
        red.redact_patterns(df, "content"),
        red.pattern_matches(df, "content", ["filename"]),
        jr.redact_object(df),
        jr.json_leaves(df, "content", ["filename"]),
        jr.extract_images(df),
        fnd.residual_scan(df.withColumnRenamed("content", "text"), "filename"),
        tr.steps(tr.parse_trajectory(df, "content"), ["filename"]),
        col.collect(df, deny=["x"], small=True),
    ):
        assert "Exchange" not in plan(done)


def test_scans_read_what_they_need(spark, tmp_path):
    df = sessions(spark, tmp_path)
    text = plan(red.pattern_matches(df, "content", ["filename"]))
    assert "ReadSchema: struct<filename:string,content:string>" in text
    text = plan(manifest.load_session(df, "f3"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(filename,f3\)", text)
    names = plan(rules.list_sessions(df))
    assert "content" not in names


def test_a_filter_on_the_result_does_not_repeat_the_work(spark, tmp_path):
    df = red.redact_patterns(sessions(spark, tmp_path), "content")
    once = plan(df.where("size(findings) > 0")).count("regexp_replace(lambda s17")
    assert once <= plan(df).count("regexp_replace(lambda s17")


def test_long_manifests_do_not_meet_content(spark, tmp_path):
    """With lists too long to broadcast, only names and hashes are shuffled."""
    df = sessions(spark, tmp_path)
    prev = df.select("source_dir", "filename", F.sha2("content", 256).alias("source_hash"))
    narrow = rules.mark_unchanged(
        df.select("source_dir", "filename", F.sha2("content", 256).alias("source_hash")), prev, small=False
    )
    for line in plan(narrow).splitlines():
        if "Exchange" in line:
            assert "content" not in line


def test_secrets_stay_out_of_plans(spark, tmp_path):
    df = sessions(spark, tmp_path)
    (tmp_path / "env").write_text("TOKEN=very-secret-value\n")
    from tracesieve.sources.lists import read_numbered_lines

    secrets = lit.parse_secrets(read_numbered_lines(spark, str(tmp_path / "env")))
    for bounds in ({}, {"inline": 0}, {"inline": 0, "shared": 0}):
        done = lit.redact_literals(df, secrets, "content", **bounds)
        done.count()
        text = done._jdf.queryExecution().toString()
        assert "very-secret-value" not in text
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    found = spark.range(100).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.lit("d").alias("detector"),
        F.lit("unverified").alias("status"),
        F.col("id").alias("line"), F.lit("h").alias("raw_sha256"), F.lit("m").alias("masked"),
    )
    text = plan(fnd.finding_examples(found))
    before = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before
    assert "partial_count" in plan(fnd.summarize_findings(found))


def test_text_is_not_shuffled_for_many_new_sessions(spark, tmp_path):
    """300,000 new sessions beside 300,000 known ones: names meet, content does not."""
    path = str(tmp_path / "many")
    spark.range(600_000).select(
        F.lit("d").alias("source_dir"), F.concat(F.lit("f"), "id").alias("filename"), F.concat(F.lit('{"t":"'), "id", F.lit('"}')).alias("content")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    known = df.where("cast(substr(filename, 2) as int) % 2 = 0")
    prev = known.select("source_dir", "filename", F.sha2("content", 256).alias("source_hash"))
    done = col.collect(df, prev=prev)
    text = plan(done)
    assert "content" in text and "_segment" in text
    for line in text.splitlines():
        if "Exchange" in line or "SortMergeJoin" in line:
            assert "content" not in line and "compact" not in line
    counts = {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
    assert counts == {"unchanged": 300_000, "collected": 300_000}
    new = done.where("outcome = 'collected'")
    assert new.where("cast(substr(filename, 2) as int) % 2 = 0").count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(40_000).select(F.xxhash64("id").cast("string").alias("k"), "id", F.lit("wide").alias("w"))
    inside, outside = keys.where("id % 3 = 0"), keys.where("id % 3 <> 0")
    from tracesieve.operators import membership

    for small in (0, 10, 100_000):
        kept = membership.keep_known(keys, inside.select("k"), outside.select("k"), ["k"], max_rows=small)
        assert sorted(r["id"] for r in kept.collect()) == list(range(0, 40_000, 3))
        assert kept.columns == keys.columns


def test_old_manifest_is_read_as_it_is(spark, tmp_path):
    """An upsert sorts and shuffles the new rows; the old table meets their names."""
    columns = "source_dir string, filename string, source_hash string, created_at timestamp"
    old = spark.range(1000).selectExpr("'d' source_dir", "concat('f', id) filename", "'h' source_hash", "timestamp'2024-01-01' created_at")
    old.write.parquet(str(tmp_path / "old"))
    new = spark.createDataFrame([("d", "f1", "n", None), ("d", "x", "n", None)], columns)
    text = plan(manifest.upsert_manifest(spark.read.parquet(str(tmp_path / "old")), new))
    before = text[: text.index("Scan parquet")] if "Scan parquet" in text else text[: text.index("FileScan")]
    assert "LeftAnti" in before and "SortAggregate" not in before and "Exchange hashpartitioning" not in before


def test_scan_reports_read_lines_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    lines = spark.range(50).select(F.format_string('{"DetectorName":"d%d","SourceMetadata":{"Data":{"Filesystem":{"file":"f%d"}}}}', F.col("id") % 5, F.col("id") % 3).alias("value"))
    files = spark.createDataFrame([("f0", "x"), ("f1", "y"), ("f9", "z")], "file string, content string")
    result = scan.scan_lines(files, lines)
    text = plan(result.reports)
    assert "from_json" not in text and text.count("Exchange hashpartitioning") <= 4
    assert [r["findings"] for r in result.reports.orderBy("file").collect()] == [5, 5, 0]


def test_sides_measured_as_large_are_not_broadcast(spark, tmp_path):
    """The planner's estimates would have both of them broadcast."""
    spark.range(300_000).selectExpr("concat('/r/', id) AS file", "'x' AS content").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    found = spark.range(5).selectExpr(
        "concat('/r/', id * 100000) AS file", "'d' AS detector", "'unverified' AS status", "id AS line", "'h' AS raw_sha256", "'m' AS masked"
    )
    known = fnd.attach_source(found, files)
    assert "BroadcastHashJoin" not in plan(known)
    assert sorted(r["line"] for r in known.collect()) == [0, 1, 2]
    reports = fnd.scan_reports(files, found)
    assert "BroadcastHashJoin" not in plan(reports)
    assert reports.where("findings = 1 and examples[0] = 'd:m'").count() == 3
