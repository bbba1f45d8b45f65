import json

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tracesieve.functions import json_tree as jt
from tracesieve.operators import json_redaction as jr
from tracesieve.operators.literals import parse_secrets
from tracesieve.sources.sessions import parse_session

KEY = "sk-" + "x" * 20

PARSES = [
    ("", True),
    ("\n \n", True),
    ('{"a":1}', True),
    ('{\n "a": 1\n}', True),
    ('{"a":1}\n{"b":2}', True),
    ('{"a":1}\r\n\r\n{"b":2}\r\n', True),
    ('"text"', True),
    ("3", True),
    ('{"a":1}\n{oops', False),
    ('{"a":1} trailing', False),
    ("1],[2", False),
    ('1,"b":2', False),
    ('{"a":NaN}', False),
    ("plain words", False),
]


@pytest.mark.parametrize("text, ok", PARSES)
def test_strict_parse(text, ok):
    try:
        jt.parse_session_text(text)
        got = True
    except ValueError:
        got = False
    assert got == ok


def test_both_parsers_agree(spark):
    df = spark.createDataFrame([(t,) for t, _ in PARSES], "content string")
    native = {r["content"]: r["ok"] for r in parse_session(df).collect()}
    python = {
        r["content"]: r["ok"]
        for r in df.select("content", jt.parsed(F.col("content"))["ok"].alias("ok")).collect()
    }
    # NaN is the one text the VARIANT parser takes and the reference refuses.
    assert {t: ok for t, ok in PARSES} == python
    assert {k: v for k, v in native.items() if "NaN" not in k} == {
        k: v for k, v in python.items() if "NaN" not in k
    }


def test_numbers_and_escapes():
    tree = jt.strict_loads('{"a":1.0,"b":0.5,"c":1e400,"d":12345678901234567890,"e":"\\ud83d"}')
    assert jt.compact(tree) == '{"a":1,"b":0.5,"c":null,"d":12345678901234567890,"e":"\\ud83d"}'


def test_paths():
    tree = {"a": {"b c": ["x", {"_k1": "y"}]}, 'q"': "z", "1a": "w"}
    assert [p for p, *_ in jt.walk_strings(tree)] == [
        '$.a["b c"][0]',
        '$.a["b c"][1]._k1',
        '$["q\\""]',
        '$["1a"]',
    ]
    assert [p for p, *_ in jt.walk_strings("root")] == ["$"]


def run(spark, contents, **options):
    rows = [("d", f"f{i}.json", c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "source_dir string, filename string, content string")
    return jr.redact_object(df, **options).orderBy("filename").collect()


def test_redact_object_keeps_shape(spark):
    tree = {KEY: KEY, "n": 5, "b": True, "z": None, "list": [KEY + " " + KEY, {"x": "clean"}]}
    [row] = run(spark, [json.dumps(tree)])
    done = json.loads(row["redacted"])
    assert list(done) == list(tree)
    assert done[KEY] == "[REDACTED:OPENAI_KEY]"
    assert (done["n"], done["b"], done["z"]) == (5, True, None)
    assert done["list"] == ["[REDACTED:OPENAI_KEY] [REDACTED:OPENAI_KEY]", {"x": "clean"}]
    assert (row["redactions_count"], row["match_count"]) == (2, 3)
    assert [c["path"] for c in row["changed"]] == [f'$["{KEY}"]', "$.list[0]"]


def test_escapes_end_matches_where_they_should(spark):
    """In the JSON text the quote is escaped; in the value it ends the URL."""
    [row] = run(spark, [json.dumps({"t": 'see postgres://user@host12345" and more'})])
    assert json.loads(row["redacted"])["t"] == 'see [REDACTED:DATABASE_URL]" and more'
    [row] = run(spark, ['{"t":"\\u0041KIA' + "B" * 16 + '"}'])
    assert json.loads(row["redacted"])["t"] == "[REDACTED:AWS_ACCESS_KEY]"


def test_failed_sessions_have_no_text(spark):
    rows = run(spark, ['{"a":"' + KEY + '"} x', "[" * 100_000])
    assert [r["redacted"] for r in rows] == [None, None]


@pytest.mark.parametrize("bounds", [{}, {"inline": 0}, {"inline": 0, "shared": 0}])
def test_secrets_in_leaves(spark, bounds):
    lines = spark.createDataFrame([('say "hi"\there', 0), ("other-secret", 1)], "line string, line_no int")
    contents = [json.dumps({"a": 'x say "hi"\there y', "b": ["other-", "secret"]}), '{"c":"none"}']
    rows = run(spark, contents, secrets=parse_secrets(lines), **bounds)
    first = json.loads(rows[0]["redacted"])
    assert first["a"].startswith("x [REDACTED:") and first["b"] == ["other-", "secret"]
    assert rows[1]["redacted"] == '{"c":"none"}'


@pytest.mark.parametrize("length, gone", [(256, False), (257, True)])
def test_image_threshold(spark, length, gone):
    uri = ("data:image/png;base64," + "A" * 300)[:length]
    blob = {"mimeType": "image/png", "data": "z" * length}
    text = {"mimeType": "text/plain", "data": "z" * length}
    [row] = run(spark, [json.dumps([uri, blob, text])], images=True)
    mark = "[IMAGE_REMOVED]"
    assert json.loads(row["redacted"]) == [
        mark if gone else uri,
        {"mimeType": "image/png", "data": mark if gone else "z" * length},
        text,
    ]
    assert row["images_stripped"] == (2 if gone else 0)
    [kept] = run(spark, [json.dumps([uri])])
    assert kept["images_stripped"] == 0


def test_extract_images(spark):
    import base64

    good = base64.b64encode(bytes(range(90))).decode()
    content = f"data:image/png;base64,{good} data:image/jpeg;base64,{'A' * 99} data:image/gif;base64,{'A' * 101} data:image/svg+xml;base64,{good}"
    df = spark.createDataFrame([("my.file.json", content)], "filename string, content string")
    rows = jr.extract_images(df).orderBy("image_index").collect()
    assert [r["image_name"] for r in rows] == ["my_file_img0.png", "my_file_img1.gif"]
    assert bytes(rows[0]["image"]) == bytes(range(90))
    assert len(rows[1]["image"]) == 75


def test_numbers_of_any_length():
    digits = "9" * 6000
    assert jt.compact(jt.strict_loads(f'{{"a":{digits},"b":-{digits},"c":12345678901234567890}}')) == (
        '{"a":null,"b":null,"c":12345678901234567890}'
    )


def test_python_works_on_a_few_megabytes_at_a_time(spark, monkeypatch):
    """Results of a batch of long sessions leave piece by piece; rows keep their places."""
    from tracesieve.functions import slices

    column = pa.array(["a" * 10, None, "b" * 3, "c" * 8, None, "", "d" * 30, "e"])
    assert slices.cut(column, 10) == [(0, 1), (1, 3), (4, 3), (7, 1)]
    assert slices.cut(column.slice(2, 2), 3) == [(0, 1), (1, 1)]
    assert slices.cut(pa.array([], pa.string())) == []
    seen = []
    monkeypatch.setattr(slices.F, "arrow_udf", lambda function, returns: function)
    work = slices.sliced(lambda texts: seen.append(len(texts)) or texts, "string")
    batch = pa.array([None if i % 7 == 0 else str(i) * (1 << 18) for i in range(100)])
    done = [piece for piece in work(iter([batch]))]
    assert pa.concat_arrays(done).equals(batch)
    assert len(seen) > 5 and max(pc.sum(pc.binary_length(p)).as_py() for p in done) < slices.SLICE_BYTES + (1 << 20)


def test_a_batch_is_let_go_before_the_next_one(monkeypatch):
    """While Spark's next batch is read the last one is no longer held, nor is more than a piece's result."""
    from tracesieve.functions import slices

    monkeypatch.setattr(slices.F, "arrow_udf", lambda function, returns: function)
    kept, made = [], []

    def batches(columns):
        for _ in range(4):
            before = pa.total_allocated_bytes()
            made.append(pa.array(["x" * 1000] * 3000))
            yield made.pop() if columns == 1 else (made[0], made.pop())
            kept.append(pa.total_allocated_bytes() - before)

    sizes = lambda texts, *others: pc.binary_length(texts)
    for work, columns in ((slices.sliced, 1), (slices.sliced_pairs, 2)):
        pieces = [len(piece) for piece in work(sizes, "int")(batches(columns))]
        assert sum(pieces) == 4 * 3000 and max(pieces) < 1100
    assert max(kept) < 1 << 20


def test_pieces_of_a_batch_with_missing_texts():
    """Redaction of a piece is that of its rows, wherever in the batch it stands."""
    from tracesieve.operators import automaton

    rows, machine = [None, "ac", "g", "", "xgcx", None, None, "c"] * 9, automaton.Automaton([b"gc", b"c", b"g"])
    for first in range(20):
        piece, alone = pa.array(rows).slice(first, 30), pa.array(rows[first : first + 30])
        for work in (lambda t: automaton.redact(t, machine, ["1", "2", "3"]), lambda t: automaton.present(t, machine, ["gc", "c", "g"], ["1", "2", "3"])):
            assert work(piece).to_pylist() == work(alone).to_pylist()


def test_spark_hands_over_few_megabytes_at_a_time(spark):
    """Batches are of the size that Python works on, whatever the session says; a smaller size stays."""
    from tracesieve.functions import slices

    was = spark.conf.get(slices.BATCH_BYTES)
    whole = lambda texts: pa.array([texts.buffers()[2].size] * len(texts))
    rows = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 200000) as t")
    try:
        spark.conf.set(slices.BATCH_BYTES, "64m")
        sizes = rows.select(slices.sliced(whole, "long")("t").alias("n")).collect()
        assert len(sizes) == 60 and max(r.n for r in sizes) <= 4 * slices.SLICE_BYTES
        assert spark.conf.get(slices.BATCH_BYTES) == str(slices.SLICE_BYTES)
        spark.conf.set(slices.BATCH_BYTES, "300k")
        slices.small_batches()
        assert spark.conf.get(slices.BATCH_BYTES) == "300k"
    finally:
        spark.conf.set(slices.BATCH_BYTES, was)
