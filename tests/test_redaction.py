import random
import time

import pytest
from pyspark.sql import functions as F

from tracesieve.functions.detectors import DETECTORS, any_may_match
from tracesieve.functions.text import count_occurrences, mask_secret, placeholder
from tracesieve.operators import automaton
from tracesieve.operators import literals as lit
from tracesieve.operators import redaction as red

A20, A36 = "a" * 20, "a" * 36

# One text per detector that only it, or an earlier one named here, may claim.
SAMPLES = [
    (0, "sk-proj-" + A20),
    (1, "sk-" + A20),
    (2, "pk-" + A20),
    (3, "ant-" + A20),
    (4, "AKIA" + "A1" * 8),
    (5, "ghs_" + A36),
    (6, "xoxb-1234567890-1234567890-abc"),
    (7, "AIza" + "b" * 35),
    (8, "ya29.x"),
    (9, "eyJa.eyJb.c"),
    (10, "npm_" + A36),
    (11, "glpat-" + A20),
    (12, "dckr_pat_" + A20),
    (5, "gho_" + A36),
    (14, "a" * 32 + "." + "b" * 16 + "." + "c" * 20),
    (15, "postgresql://user@host1234"),
    (16, "mongodb://user@host1234"),
    (17, "https://me:pw@host"),
]


def redact_all(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = red.redact_patterns(df).orderBy("id").collect()
    return [(r["redacted"], [(f["detector"], f["count"]) for f in r["findings"]]) for r in rows]


def test_each_detector(spark):
    texts = [f"see {s} here" for _, s in SAMPLES]
    for (index, _), (text, found) in zip(SAMPLES, redact_all(spark, texts)):
        d = DETECTORS[index]
        assert found == [(d.kind, 1)]
        assert text == f"see {d.replacement} here"


def test_gates_never_hide_a_match(spark):
    texts = [s for _, s in SAMPLES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select(
        F.expr(any_may_match("t")).alias("any"),
        *[F.expr(f"NOT {d.may_match('t')} AND t RLIKE {red_sql(d.regex)}").alias(str(d.index)) for d in DETECTORS],
    ).collect()
    for r in row:
        assert r["any"]
        assert not any(r[str(d.index)] for d in DETECTORS)


def red_sql(text):
    from tracesieve.functions.text import sql_string

    return sql_string(text)


def test_counts_and_order(spark):
    npm = "npm_" + A36
    [(text, found)] = redact_all(spark, [f"{npm} {npm} sk-ant-{A20} AKIA{'B' * 16}"])
    assert found == [("OPENAI_KEY", 1), ("AWS_ACCESS_KEY", 1), ("NPM_TOKEN", 2)]
    assert text == "[REDACTED:NPM_TOKEN] [REDACTED:NPM_TOKEN] [REDACTED:OPENAI_KEY] [REDACTED:AWS_ACCESS_KEY]"


def test_short_match_inside_longer_one(spark):
    """The tail of the longer key must not stay readable."""
    [(text, found)] = redact_all(spark, [f"sk-{A20} sk-{A20}tail"])
    assert text == "[REDACTED:OPENAI_KEY] [REDACTED:OPENAI_KEY]"
    assert found == [("OPENAI_KEY", 1), ("OPENAI_KEY", 1)]


def test_no_word_boundary_is_kept(spark):
    results = redact_all(spark, ["risk-management-dashboard-view", "important-" + A20, "task-list"])
    assert [r[1] for r in results] == [[("OPENAI_KEY", 1)], [("ANTHROPIC_KEY", 1)], []]


def test_text_only_form_agrees_and_is_idempotent(spark):
    texts = [" ".join(s for _, s in SAMPLES), "clean", "", "a.b@c:d ://"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    once = df.select("id", red.redacted_text(F.col("text")).alias("text"))
    full = red.redact_patterns(df).select("id", F.col("redacted").alias("text"))
    again = once.select("id", red.redacted_text(F.col("text")).alias("text"))
    expected = sorted(map(tuple, full.collect()))
    assert sorted(map(tuple, once.collect())) == expected
    assert sorted(map(tuple, again.collect())) == expected
    assert expected[1][1] == "clean"


def test_text_of_nothing_but_secrets(spark):
    """Counting stays linear: many distinct matches in one text."""
    keys = [f"AKIA{i:016d}" for i in range(5000)]
    [(text, found)] = redact_all(spark, [" ".join(keys + keys[:10])])
    assert len(found) == 5000
    assert sum(n for _, n in found) == 5010
    assert "AKIA" not in text


def test_email_and_key_value(spark):
    df = spark.createDataFrame([('mail a.b@mail.example.com, token = "abcdefgh1" x',)], "t string")
    mail = df.select(red.redact_email(F.col("t"))).first()[0]
    pair = df.select(red.redact_key_value(F.col("t"))).first()[0]
    assert mail == 'mail [REDACTED:EMAIL], token = "abcdefgh1" x'
    assert pair == 'mail a.b@mail.example.com, token = "[REDACTED:KEY_VALUE]" x'


@pytest.mark.parametrize(
    "raw, masked",
    [
        ("short", "***"),
        ("abcdefgh", "***"),
        ("abcdefghi", "abcd***fghi"),
        ("abcdefghijkl", "abcd***ijkl"),
        ("npm_abcdefghijkl", "npm_abcd***ijkl"),
        ("npm_12345", "npm_1***2345"),
        ("", "[REDACTED]"),
        (None, "[REDACTED]"),
    ],
)
def test_mask(spark, raw, masked):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(mask_secret(F.col("raw"))).first()[0] == masked


def test_count_occurrences(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("xyx", "x")], "t string, n string")
    got = [r[0] for r in df.select(count_occurrences(F.col("t"), F.col("n"))).collect()]
    assert got == [2, 0, 2]


def secrets_of(spark, lines):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "line string, line_no int")
    return lit.parse_secrets(df)


def test_parse_secrets(spark):
    lines = [
        "export API_KEY=sk-abc123",
        'API_KEY="sk-abc123"',
        "plainvalue",
        "abc==",
        "abc",
        "X=ab",
        "",
        "  padded value  ",
        "RED",
        "REDACTED",
        "OPENAI_KEY",
    ]
    rows = {r["value"]: r["name"] for r in secrets_of(spark, lines).collect()}
    assert rows == {
        "sk-abc123": "export API_KEY=sk-abc123",
        "plainvalue": "plainvalue",
        "padded value": "padded value",
    }
    df = spark.createDataFrame([(v,) for v in lines], "line string")
    ignored = sorted(r[0] for r in lit.ignored_lines(df).collect())
    assert ignored == ["OPENAI_KEY", "RED", "REDACTED", "X=ab", "abc", "abc=="]
    salted = spark.range(1).select(placeholder(F.lit("v"), "salt").alias("p")).first()[0]
    assert salted != spark.range(1).select(placeholder(F.lit("v")).alias("p")).first()[0]


def brute(text, values):
    """Longest first, present in the original text, replaced one after the other."""
    import hashlib

    total = 0
    present = sorted((v for v in values if v in text), key=lambda v: (-len(v), v))
    for v in present:
        total += text.count(v)
        text = text.replace(v, f"[REDACTED:{hashlib.sha256(v.encode()).hexdigest()[:8]}]")
    return text, total


@pytest.mark.parametrize("bounds", [{}, {"inline": 0}, {"inline": 0, "shared": 0}])
def test_literals_against_brute_force(spark, bounds):
    """All three forms: nested secrets, non-ASCII, long ones, at the edges of texts."""
    rng = random.Random(7)
    alphabet = "abé漢 x"
    values = {"".join(rng.choice(alphabet) for _ in range(n)).strip() for n in range(3, 90) for _ in range(2)}
    values = sorted(v for v in values if len(v) > 3 and "=" not in v)
    values += [values[10][:5], "abab", "aéaé", "x" * 64, "x" * 65]
    texts = ["", "x" * 200, "abababab", values[-6]]
    for _ in range(60):
        parts = [rng.choice([*values, "abé", "漢 漢", "zz"]) for _ in range(rng.randrange(6))]
        texts.append(rng.choice(["", " ", "q"]).join(parts))
    secrets = secrets_of(spark, values)
    known = [r["value"] for r in secrets.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    done = lit.redact_literals(df, secrets, keys=["id"], **bounds).orderBy("id").collect()
    assert len(done) == len(texts)
    for row in done:
        text, total = brute(row["text"], known)
        assert row["redacted"] == text
        assert sum(f["count"] for f in row["findings"]) == total


def test_re_redact(spark):
    texts = [("d", "a", "one two three four five"), ("d", "b", "one"), ("e", "a", "nothing"), ("e", "b", None)]
    sessions = spark.createDataFrame(texts, "source_dir string, filename string, content string")
    raw = [("d", "a", w) for w in ("one", "two", "three", "four", "five", "three four", "absent")] + [("e", "b", "one")]
    found = spark.createDataFrame(raw, "source_dir string, filename string, raw string")
    result = {(r["source_dir"], r["filename"]): r for r in lit.re_redact(sessions, found).collect()}
    expected, total = brute(texts[0][2], [w for _, _, w in raw])
    assert result["d", "a"]["redacted"] == expected and result["d", "a"]["match_count"] == total
    assert result["d", "a"]["secrets_found"] == 4
    assert [result[k]["redacted"] for k in (("d", "b"), ("e", "a"), ("e", "b"))] == ["one", "nothing", None]


def test_re_redact_ten_thousand_values(spark):
    """One join, whatever the number of values a session has."""
    values = [f"value-{i:05d}-{i * 7919 % 10007}" for i in range(10_000)]
    text = " ".join(values[::3]) + " clean " + values[1]
    sessions = spark.createDataFrame([("d", "a", text), ("d", "b", "clean")], "source_dir string, filename string, content string")
    found = spark.createDataFrame([("d", "a", v) for v in values], "source_dir string, filename string, raw string")
    done = lit.re_redact(sessions, found)
    assert done._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    rows = {r["filename"]: r for r in done.collect()}
    assert rows["a"]["secrets_found"] == rows["a"]["match_count"] == len(values[::3]) + 1
    assert rows["b"]["redacted"] == "clean" and "value" not in rows["a"]["redacted"]


def by_place(text, values):
    """Longest first; what was replaced is cut out, so that nothing is found in a placeholder."""
    import hashlib

    pieces = [(text, False)]
    for v in sorted(values, key=lambda v: (-len(v), v)):
        new = f"[REDACTED:{hashlib.sha256(v.encode()).hexdigest()[:8]}]"
        cut = []
        for piece, done in pieces:
            parts = [piece] if done else piece.split(v)
            for i, part in enumerate(parts):
                cut += [(new, True)] * (i > 0) + [(part, done)]
        pieces = cut
    return "".join(p for p, _ in pieces)


@pytest.mark.parametrize("bounds", [{}, {"inline": 0}, {"inline": 0, "shared": 0}])
def test_placeholders_are_not_rewritten(spark, bounds):
    """Secrets that are part of another's placeholder, or end in its bracket, leave it alone."""
    hexes = ["f551", "8f55", "51e9", "b140"]
    values = ["longsecretvalue", *hexes, "e]x", "\\Ex", "a.b*c", "\\Qq", "[REDACTED"]
    secrets = spark.createDataFrame([(v, placeholder_of(v)) for v in values], "value string, replacement string")
    texts = [f"longsecretvalue {' '.join(hexes)} f551e9", "longsecretvaluex", "\\Ex a.b*c axbxc \\Qq \\E", "", "none", "longsecretvalue" * 3, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = lit.redact_literals(df, secrets, keys=["id"], **bounds).orderBy("id").collect()
    assert [r["redacted"] for r in done] == [t if t is None else by_place(t, values) for t in texts]
    assert done[0]["redacted"].startswith(placeholder_of("longsecretvalue"))
    assert sum(f["count"] for f in done[5]["findings"]) == 3


def placeholder_of(value):
    import hashlib

    return f"[REDACTED:{hashlib.sha256(value.encode()).hexdigest()[:8]}]"


def test_automaton_against_brute_force(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice(["ab", "abc", "abcdé", "aé日"])
        sizes = rng.choice([1, 3]), rng.choice([3, 5, 12, 40])
        values = {"".join(rng.choices(alphabet, k=rng.randint(*sizes))) for _ in range(rng.choice([1, 2, 5, 30, 200]))}
        values = sorted(values, key=lambda v: (-len(v), v))
        texts = [rng.choice([None, "", "".join(rng.choices(alphabet, k=300)), "".join(rng.choices([*values, *alphabet], k=30))]) for _ in range(20)]
        monkeypatch.setattr(automaton, "LANES", rng.choice([2, 7, 2048]))
        monkeypatch.setattr(automaton, "SLICE_BYTES", rng.choice([17, 64, 1 << 22]))
        machine = automaton.Automaton([v.encode() for v in values])
        column = pa.array(texts, pa.string()).slice(rng.randint(0, 3))
        texts = texts[len(texts) - len(column) :]
        done = automaton.redact(column, machine, [placeholder_of(v) for v in values]).to_pylist()
        there = automaton.present(column, machine, values, values).to_pylist()
        for text, row, found in zip(texts, done, there):
            assert row["text"] == (None if text is None else by_place(text, values))
            assert [f["value"] for f in found] == [v for v in values if text and v in text]
            assert (row["text"] or "").count("[") == sum(f["count"] for f in row["found"])


def test_automaton_reads_repeats_once():
    import time

    import pyarrow as pa

    values = ["a" * k for k in (2000, 1000, 500)]
    start = time.monotonic()
    done = automaton.redact(pa.array(["a" * 1_000_000 + "b"]), automaton.Automaton([v.encode() for v in values]), ["x", "y", "z"])
    assert done[0].as_py()["text"] == "x" * 500 + "b" and time.monotonic() - start < 30


@pytest.mark.parametrize("bounds", [{"inline": 0}, {"inline": 0, "shared": 0}])
def test_secrets_that_share_a_long_beginning(spark, bounds):
    head = "-----BEGIN KEY-----" * 5
    values = [f"{head}{i:04d}" for i in range(400)] + [head[:70]]
    texts = [f"x {values[7]} {values[300]} y", f"only {head[:80]}", "none", values[-1][:-1]]
    secrets = secrets_of(spark, values)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = lit.redact_literals(df, secrets, keys=["id"], **bounds).orderBy("id").collect()
    assert [r["redacted"] for r in done] == [brute(t, values)[0] for t in texts]


def _random_texts(pieces, n=4000):
    rng = random.Random(5)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_one_pass_patterns_equal_the_plain_ones(spark):
    """Against the fixed regexes, run by Spark on short random texts."""
    urls = ["http://", "https://", "http", "h", "x", "@", ":", " ", '"', "'", "u:p@h", "\n"]
    tokens = ["eyJ", "e", "yJ", ".", "eyJa", "-", "_", " ", ".eyJb", "A"]
    mails = ["a", "@", ".", "b1", "com", "-", "c", " ", "1", "x@y", ".c", "%", "é"]
    for pieces, index in ((urls, 17), (tokens, 9)):
        df = spark.createDataFrame([(t,) for t in _random_texts(pieces)], "t string")
        d = DETECTORS[index]
        plain = red_sql(d.regex)
        same = df.selectExpr(
            f"{d.replace_in('t')} = regexp_replace(t, {plain}, '{d.replacement}') AS same_text",
            f"{d.matches_in('t')} = regexp_extract_all(t, {plain}, 0) AS found",
            f"size({d.matches_in('t')}) AS n",
        )
        bad, hits = same.agg(F.count_if(F.expr("NOT (same_text AND found)")), F.sum("n")).first()
        assert bad == 0 and hits > 100
    df = spark.createDataFrame([(t,) for t in _random_texts(mails)], "t string")
    plain = F.regexp_replace("t", red.EMAIL, "[REDACTED:EMAIL]")
    differ = df.select("t", plain.alias("p"), red.redact_email(F.col("t")).alias("q"))
    assert differ.where("p != q").collect() == []
    assert differ.where("p != t").count() > 100


def test_patterns_do_not_stall_on_long_runs(spark):
    n = 1_000_000
    texts = [
        "x@" + "a." * (n // 2),
        "w" * n + "@x.org",
        "x@" + "a." * (n // 2) + "org",
        "https://a:" * (n // 10) + " @",
        "https://" + "a:@" * (n // 3),
        "eyJ" * (n // 3),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    start = time.monotonic()
    mails = df.select("i", red.redact_email(F.col("t")).alias("t")).orderBy("i").collect()
    rest = df.select("i", red.redacted_text(F.col("t")).alias("t")).orderBy("i").collect()
    assert time.monotonic() - start < 60
    assert [r["t"] for r in mails[:3]] == [texts[0], "[REDACTED:EMAIL]", "[REDACTED:EMAIL]"]
    assert [r["t"] for r in rest] == texts


@pytest.mark.parametrize(
    "prefix, least",
    [("sk-", 20), ("pk-", 20), ("ant-", 20), ("AKIA", 16), ("ghp_", 36), ("AIza", 35), ("npm_", 36), ("glpat-", 20), ("dckr_pat_", 20)],
)
def test_length_limits(spark, prefix, least):
    """One character less than a detector asks for is left alone."""
    texts = [f"x {prefix}{'A' * n} y" for n in (least - 1, least)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    done = [r["redacted"] for r in red.redact_patterns(df).orderBy("id").collect()]
    assert done[0] == texts[0] and done[1].startswith("x [REDACTED:") and prefix not in done[1]


def test_extra_rules(spark):
    text = "mail me@host.example or api_key: abcdefgh12, token=[REDACTED:X] password=short"
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(red.scan_text(F.col("text"), ["key_value", "email"]).alias("s")).first()["s"]
    assert found["text"] == "mail [REDACTED:EMAIL] or api_key: [REDACTED:KEY_VALUE], token=[REDACTED:X] password=short"
    assert [h["match"] for h in found["hits"]] == ["me@host.example", "abcdefgh12"]
    assert df.select(red.scan_text(F.col("text")).alias("s")).first()["s"]["text"] == text
    with pytest.raises(ValueError):
        red.scan_text(F.col("text"), ["phone"])
    from tracesieve.operators import hashing

    assert hashing.rules_fingerprint() != hashing.rules_fingerprint(extra_rules=["email"])
