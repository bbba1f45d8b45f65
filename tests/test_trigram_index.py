import re

import pytest
from pyspark.sql import functions as F

from tracesieve.operators import rules
from tracesieve.operators import trigram_index as tri


@pytest.mark.parametrize(
    "pattern, texts",
    [
        ("needle", [["needle"]]), ("a needle|other one", [["a needle"], ["other one"]]), ("pre(fix|cise)end", [["pre", "fix", "end"], ["pre", "cise", "end"]]),
        ("(abcd)+x*yz?w", [["abcd"]]), ("abc.*def", [["abc", "def"]]), ("ab", None), ("(abc)?", None), ("abc|x", None), ("[abc]def", [["def"]]),
        (r"\babc\d+", [["abc"]]), (r"tok\.en", [["tok.en"]]), (r"abc\1", None), (r"\Qabc\E", None), ("(", None), ("abc(?!def)", [["abc"]]),
        ("^start", [["start"]]), ("x{3,}abc", [["abc"]]), ("", None),
    ],
)
def test_required_texts(pattern, texts):
    found = tri.required_texts(pattern)
    assert found == (None if texts is None else [[t.encode() for t in own] for own in texts])


def test_letters_beyond_ascii_are_not_asked_for_without_case():
    assert tri.required_texts("abcÄdef") == [["abcÄdef".encode()]]
    assert tri.required_texts("(?i)abcÄdef") == [[b"abc", b"def"]] == tri.required_texts("abcÄdef", True)
    assert tri.required_texts("K\u212aelvin(?i:abcd)") == [["K\u212aelvin".encode(), b"abcd"]]


def test_required_texts_are_in_every_match():
    import random

    r = random.Random(4)
    atoms = ["abc", "de", "x", ".", "[ab]", "(?:fg|hij)", "(k|lm)", r"\w", "n+", "(?:op)?", "q{2}"]
    for _ in range(400):
        pattern = "|".join("".join(r.choices(atoms, k=r.randint(1, 5))) for _ in range(r.randint(1, 2)))
        texts = tri.required_texts(pattern)
        for _ in range(60):
            text = "".join(r.choices(["abc", "de", "x", "a", "fg", "hij", "k", "lm", "n", "op", "qq", "z"], k=12))
            found = re.search(pattern, text)
            if found and texts:
                assert any(all(t in found.group().encode() for t in own) for own in texts), (pattern, text, texts)


def test_only_candidate_files_are_opened(spark, tmp_path):
    store, index = str(tmp_path / "store"), str(tmp_path / "index")
    rows = spark.range(400).select(
        F.lit("d").alias("source_dir"), F.concat(F.lit("f"), "id").alias("filename"),
        F.concat(F.lit("common words Ünï "), F.when(F.col("id") == 77, "NeedleHere").otherwise(F.md5(F.col("id").cast("string")))).alias("content"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    rows.repartition(20).write.parquet(store)
    tri.build_index(spark, store, index)
    reject = spark.createDataFrame([("f5",)], "filename string")

    def both(patterns, ignore_case=False):
        found = tri.grep_store(spark, store, index, reject, patterns, ignore_case)
        scan = rules.grep_sessions(spark.read.parquet(store), reject, "|".join(f"(?:{p})" for p in patterns), ignore_case)
        names = sorted(r["filename"] for r in found.collect())
        assert names == sorted(r["filename"] for r in scan.collect())
        return names, len(tri.candidate_files(spark, store, index, patterns, ignore_case))

    assert both(["NeedleHere"]) == (["f77"], 1)
    assert both(["needlehere"], True) == (["f77"], 1)
    assert both(["needlehere"]) == ([], 1)  # the index does not tell cases apart
    assert both(["nowhere to be found"]) == ([], 0)
    assert both(["common wor.s"])[1] == 20
    assert both(["(?i)ÜNÏ", "NeedleHere"])[1] == 20
    assert both(["a"])[1] == 20
    # A copy without the needle, in a file that the index does not know, hides the old one.
    newer = rows.where("id = 77").withColumn("content", F.lit("clean")).withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    newer.write.mode("append").parquet(store)
    assert both(["NeedleHere"]) == ([], 2)
    tri.build_index(spark, store, index)
    assert both(["NeedleHere"]) == ([], 1)
    assert both(["clean"]) == (["f77"], 1)
