import json
import os

import pytest
from pyspark.sql import functions as F

from tracesieve.functions.patterns import compile_patterns, matches_any
from tracesieve.operators import manifest
from tracesieve.operators import publishing as pub
from tracesieve.plans import collect as col
from tracesieve.plans import collect_files as files
from tracesieve.sources import lists, sinks
from tracesieve.sources import sessions as src
from tracesieve.streaming.collect_stream import stream_collect, streamed_manifest, streamed_sessions

KEY = "glpat-" + "x" * 20


@pytest.fixture()
def folder(tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "a.json").write_text(json.dumps({"t": KEY}))
    (one / "b.jsonl").write_text('{"t":"é"}\n{"t":"x"}\n')
    (one / ".hidden.json").write_text("{}")
    (one / "notes.txt").write_text("no session")
    (two / "a.json").write_text('{"t":"other"}')
    (two / "raw.json").write_bytes(b'{"t":"\xff"}')
    return tmp_path


def test_read_sessions(spark, folder):
    text = f" {folder}/one:{folder}/two : {folder}/three"
    source = src.read_session_dirs(spark, text)
    rows = {(r["source_dir"], r["filename"]): r for r in source.sessions.collect()}
    assert source.missing == [f"{folder}/three"]
    assert set(rows) == {
        (f"{folder}/one", "a.json"),
        (f"{folder}/one", "b.jsonl"),
        (f"{folder}/two", "a.json"),
        (f"{folder}/two", "raw.json"),
    }
    lines = rows[f"{folder}/one", "b.jsonl"]
    assert lines["content"] == '{"t":"é"}\n{"t":"x"}\n'
    assert lines["size"] == len(lines["content"].encode())
    assert rows[f"{folder}/two", "raw.json"]["content"] == '{"t":"�"}'
    counts = {os.path.basename(r[0]): r[1] for r in src.count_by_dir(source.sessions).collect()}
    assert counts == {"one": 2, "two": 2}
    named = src.read_sessions(spark, f"{folder}/one", deny_names=["^b"])
    assert [r["filename"] for r in named.collect()] == ["a.json"]
    nothing = src.read_session_dirs(spark, f"{folder}/three")
    assert nothing.sessions.count() == 0


def test_sessions_too_large_to_read(spark, folder):
    """They are counted and fail; they never pass through unredacted."""
    rows = src.read_sessions(spark, f"{folder}/one", max_bytes=30)
    sizes = {r["filename"]: (r["size"] > 30, r["content"] is None) for r in rows.collect()}
    assert sizes == {"a.json": (True, True), "b.jsonl": (False, False)}
    done = {r["filename"]: (r["outcome"], r["redacted"]) for r in col.collect(rows).collect()}
    assert done["a.json"] == ("failed", None)
    assert done["b.jsonl"][0] == "collected"


def test_colon_paths(monkeypatch):
    monkeypatch.setenv("HOME", "/home/u")
    assert src.colon_paths("~/s: /x ::") == ["/home/u/s", "/x"]


def test_line_sets(spark, tmp_path):
    (tmp_path / "list").write_text(" b.json \n\n\t\na.json\r\nb.json\n")
    names = lists.read_line_set(spark, str(tmp_path / "list"))
    assert sorted(r[0] for r in names.collect()) == ["a.json", "b.json"]
    lists.write_line_set(names, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts) == "a.json\nb.json\n"


def test_patterns(spark):
    compiled = compile_patterns(spark, [" a+ ", "", "(", r"(x)\1", "(?i)QQ"])
    assert compiled.valid == ["a+", r"(x)\1", "(?i)QQ"] and compiled.dropped == ["("]
    df = spark.createDataFrame([("caat",), ("xx",), ("xy",), ("qq",), ("A",)], "t string")
    got = [r[0] for r in df.select(matches_any(F.col("t"), compiled.valid)).collect()]
    assert got == [True, True, False, True, False]
    assert not df.select(matches_any(F.col("t"), [])).first()[0]


def test_manifest(spark, tmp_path):
    good = json.dumps({"source_dir": "d", "filename": "a", "size_bytes": 3})
    (tmp_path / "m").write_text(f"{good}\n\n{{torn\n")
    loose = lists.read_manifest(spark, str(tmp_path / "m"))
    strict = lists.read_manifest(spark, str(tmp_path / "m"), strict=True)
    assert (loose.rows.count(), loose.malformed) == (1, 1)
    assert strict.rows.count() == 0
    assert loose.rows.first()["size_bytes"] == 3


def test_image_assets(spark, tmp_path):
    for name in ("a.PNG", "b.svg", "c.txt", "d.png.bak"):
        (tmp_path / name).write_text("x")
    rows = lists.read_image_assets(spark, str(tmp_path)).collect()
    assert sorted(r["filename"] for r in rows) == ["a.PNG", "b.svg"]


def test_round_trip_and_publish(spark, folder):
    source = src.read_session_dirs(spark, f"{folder}/one:{folder}/two")
    done = sinks.save_collected(col.collect(source.sessions), f"{folder}/collected")
    sinks.write_redacted(done, f"{folder}/redacted")
    redacted = spark.read.parquet(f"{folder}/redacted")
    assert redacted.count() == 4
    assert redacted.where(F.col("content").contains(KEY)).count() == 0
    reject = spark.createDataFrame([("raw.json",)], "filename string")
    log, data = f"{folder}/log", f"{folder}/data"
    dry = sinks.publish_dataset(redacted, reject, log, data, dry_run=True)
    assert dry.where("status = 'pending'").count() == 3 and not os.path.exists(data)
    sinks.publish_dataset(redacted, reject, log, data)
    assert spark.read.parquet(data).count() == 3
    sinks.publish_dataset(redacted, reject.limit(0), log, data)
    assert spark.read.parquet(data).count() == 4
    logged = sinks.read_publish_log(spark, log)
    assert logged.count() == 4
    assert logged.where("size_bytes = 0").count() == 0
    stats = pub.workspace_stats(redacted.select("source_dir", "filename", "size_bytes"), reject, logged)
    row = stats.first()
    assert (row["total"], row["uploaded"], row["pending"], row["rejected"]) == (4, 4, 0, 1)


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps({"t": KEY}))
    (inbox / "bad.json").write_text("{")
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name in ("b.json", "c.json"):
        stream_collect(spark, str(inbox), target, state).awaitTermination()
        (inbox / name).write_text(json.dumps({"t": name}))
    stream_collect(spark, str(inbox), target, state).awaitTermination()
    rows = {r["filename"]: r["outcome"] for r in streamed_sessions(spark, target).collect()}
    assert rows == {"a.json": "collected", "bad.json": "failed", "b.json": "collected", "c.json": "collected"}
    rows = streamed_manifest(spark, target)
    assert sorted(r["filename"] for r in rows.collect()) == ["a.json", "b.json", "c.json"]
    assert "created_at" in rows.columns


def test_only_the_newest_copy_is_published(spark, tmp_path):
    folder = str(tmp_path)
    columns = "source_dir string, filename string, content string, redacted_hash string, size_bytes long, created_at timestamp"
    old, new = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    copies = spark.createDataFrame(
        [("d", "a", "pw hunter22", "h1", 11, None), ("d", "b", "fine", "h3", 4, None), ("d", "c", "late", "h4", 4, None), ("d", "e", "bad", "h5", 3, None)], columns
    ).withColumn("created_at", F.lit(old).cast("timestamp"))
    again = spark.createDataFrame([("d", "a", "pw [REDACTED]", "h2", 13, None)], columns)
    redacted = copies.unionByName(again.withColumn("created_at", F.lit(new).cast("timestamp")))
    keys = lambda *names: spark.createDataFrame([("d", n) for n in names] or [], "source_dir string, filename string")
    reject = spark.createDataFrame([], "filename string")
    for _ in range(2):
        sinks.publish_dataset(redacted, reject, f"{folder}/log", f"{folder}/data", denied=keys("c"), blocked=keys("e"))
    published = spark.read.parquet(f"{folder}/data")
    assert sorted((r.filename, r.content) for r in published.collect()) == [("a", "pw [REDACTED]"), ("b", "fine")]
    assert spark.read.parquet(f"{folder}/log").count() == 2


def test_a_fault_is_not_an_empty_log(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    from tracesieve.sources.lists import path_exists

    def refused(*_, **__):
        raise AnalysisException(errorClass="UNSUPPORTED_OPERATION", messageParameters={"operation": "read"})

    monkeypatch.setattr(type(spark.read), "load", refused)
    with pytest.raises(AnalysisException):
        path_exists(spark, "/nowhere")


def long_file(path, n, bad=()):
    """JSON lines, some blank, one with Windows line ends; returns the values of the lines."""
    values = [{"i": i, "t": f"line {i} {KEY if i % 7 == 0 else 'é'}"} for i in range(n)]
    with open(path, "w", newline="") as out:
        for i, value in enumerate(values):
            out.write("{" if i in bad else json.dumps(value, ensure_ascii=False))
            out.write("\r\n" if i % 50 == 3 else "\n\n \n" if i % 50 == 4 else "\n")
    return values


def test_long_lines_are_numbered(spark, tmp_path):
    """Ranges of a file count their lines on their own, whatever their number."""
    long_file(tmp_path / "a b+c%20.jsonl", 3000)
    long_file(tmp_path / "short.jsonl", 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    hashes = set()
    for size in (2_000, 30_000, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = src.read_long_lines(spark, str(tmp_path), long_bytes=1000)
            rows = sorted((r.line_no, json.loads(r.line)["i"], r.source_dir, r.filename) for r in lines.collect())
            hashes.add(files.lines_hash(lines).first()["source_hash"])
            assert size > 30_000 or lines.rdd.getNumPartitions() > 3
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert rows == [(i, i, str(tmp_path), "a b+c%20.jsonl") for i in range(3000)]
    assert len(hashes) == 1, "the hash must not depend on the splits"


def test_long_and_short_sessions_have_one_outcome(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    values = long_file(inbox / "good.jsonl", 200)
    long_file(inbox / "bad.jsonl", 200, bad=[150])
    long_file(inbox / "denied.jsonl", 200)
    long_file(inbox / "listed.jsonl", 200)
    (inbox / "no.json").write_text("{")
    (inbox / "deep.json").write_text("[" * 100_000)
    (inbox / "blank.jsonl").write_text("\n" * 500)
    with open(inbox / "denied.jsonl", "a") as out:
        out.write('{"t": "internal only"}\n')
    reject = spark.createDataFrame([("listed.jsonl",)], "filename string")
    runs = {}
    for name, size in (("rows", 1 << 20), ("lines", 400)):
        target = str(tmp_path / name)
        rows = files.collect_files(spark, str(inbox), target, deny=["internal only"], reject=reject, long_bytes=size)
        runs[name] = {r["filename"]: r for r in rows.collect()}
    outcomes = {k: r["outcome"] for k, r in runs["rows"].items() if k != "blank.jsonl"}
    assert outcomes == {k: r["outcome"] for k, r in runs["lines"].items() if k != "blank.jsonl"}
    assert outcomes == {
        "good.jsonl": "collected", "bad.jsonl": "failed", "denied.jsonl": "rejected", "listed.jsonl": "on_reject_list",
        "no.json": "failed", "deep.json": "failed",
    }
    assert {r["error"] for r in runs["rows"].values()} == {None, "neither JSON nor JSON lines", "JSON nested too deep"}
    for column in ("redactions_count", "match_count", "size_bytes"):
        assert runs["rows"]["good.jsonl"][column] == runs["lines"]["good.jsonl"][column]
    whole = files.redacted_rows(spark, str(tmp_path / "rows")).collect()
    parts = sorted(files.redacted_rows(spark, str(tmp_path / "lines")).where("filename = 'good.jsonl'").collect(), key=lambda r: r["part"])
    assert json.loads(next(r["content"] for r in whole if r["filename"] == "good.jsonl"))["lines"] == [json.loads(r["content"]) for r in parts]
    assert [json.loads(r["content"])["i"] for r in parts] == [v["i"] for v in values]
    assert not any(KEY in r["content"] for r in whole + parts)
    again = files.collect_files(
        spark, str(inbox), str(tmp_path / "again"), deny=["internal only"], reject=reject, long_bytes=400,
        prev=files.collected_manifest(spark, str(tmp_path / "lines")),
    )
    assert {r["outcome"] for r in again.collect() if r["filename"] == "good.jsonl"} == {"unchanged"}


def test_stream_takes_long_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    long_file(inbox / "a.jsonl", 100)
    target = str(tmp_path / "out")
    stream_collect(spark, str(inbox), target, str(tmp_path / "state"), long_bytes=400).awaitTermination()
    assert files.redacted_rows(spark, target).count() == 100
    assert streamed_manifest(spark, target).count() == 1


def test_changed_files_are_collected_again(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for name in "abc":
        (inbox / f"{name}.json").write_text(json.dumps({"t": name}))
    long_file(inbox / "l.jsonl", 60)
    collect = lambda: files.collect_changed(spark, str(inbox), target, files_per_batch=2, long_bytes=400)
    assert collect() == 4 and collect() == 0
    (inbox / "b.json").write_text(json.dumps({"t": "edited"}))
    (inbox / "d.json").write_text(json.dumps({"t": KEY}))
    long_file(inbox / "l.jsonl", 61)
    assert collect() == 3 and collect() == 0
    newest = sinks.newest_rows(files.redacted_rows(spark, target)).collect()
    texts = {r["filename"]: r["content"] for r in newest if r["part"] is None}
    assert {k: json.loads(v)["t"] for k, v in texts.items()} == {"a.json": "a", "b.json": "edited", "c.json": "c", "d.json": "[REDACTED:GITLAB_TOKEN]"}
    assert sum(r["filename"] == "l.jsonl" for r in newest) == 61
    assert files.collected_manifest(spark, target).count() == 5


def test_a_run_that_dies_publishes_nothing_twice(spark, tmp_path, monkeypatch):
    columns = "source_dir string, filename string, content string, size_bytes long"
    redacted = spark.createDataFrame([("d", name, "text", 4) for name in "abc"], columns)
    reject = spark.createDataFrame([], "filename string")
    log, data = str(tmp_path / "log"), str(tmp_path / "data")
    sinks.publish_dataset(redacted.where("filename = 'a'"), reject, log, data)
    whole = sinks.record_uploads

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks, "record_uploads", dies)
    with pytest.raises(RuntimeError):
        sinks.publish_dataset(redacted, reject, log, data)
    names = lambda df: sorted(r["filename"] for r in df.collect())
    assert names(sinks.read_dataset(spark, data, log)) == ["a"] == names(sinks.read_publish_log(spark, log))
    monkeypatch.setattr(sinks, "record_uploads", whole)
    sinks.publish_dataset(redacted, reject, log, data)
    assert names(sinks.read_dataset(spark, data, log)) == ["a", "b", "c"] == names(sinks.read_publish_log(spark, log))
    assert spark.read.parquet(data).count() == 3


def test_manifest_table_writes_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "manifest")
    columns = "source_dir string, filename string, source_hash string, created_at timestamp"
    rows = lambda names, h: spark.createDataFrame([("d", n, h, None) for n in names], columns)
    manifest.update_manifest(spark, path, rows([f"f{i}" for i in range(200)], "1"), buckets=16)
    stamp = lambda: {p: os.stat(f"{path}/{p}").st_mtime_ns for p in os.listdir(path) if p.startswith("bucket=")}
    before = stamp()
    manifest.update_manifest(spark, path, rows(["f7", "new"], "2").unionByName(rows(["new"], "1")), buckets=16)
    after = stamp()
    assert len(before) == 16 and 1 <= sum(before[p] != after[p] for p in before) <= 2
    found = {r["filename"]: r["source_hash"] for r in manifest.read_manifest_table(spark, path).collect()}
    assert len(found) == 201 and {k for k, h in found.items() if h == "2"} == {"f7", "new"}
    assert manifest.read_manifest_table(spark, path).count() == 201
