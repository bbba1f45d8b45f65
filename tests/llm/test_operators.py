"""Operators against brute force, on small fixtures with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import time
import zlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracesieve.llm import chat, components, decision_list, embeddings, fuzzy_lines, mixing, packing, secret_lexer, simhash, substring, text_stats, token_codec, tokens
from tracesieve.llm.queries import tokenizer
from tracesieve.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words string, fp string"


def vocabulary(seed=0, n=400):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(2, 9))) for _ in range(n)]


def texts(seed=1, n=120):
    r, words = random.Random(seed), vocabulary()
    out = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and out:
            out.append(r.choice(out))
        elif kind == 2 and out:
            own = r.choice(out).split(" ")
            own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
        else:
            lines = [" ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(r.randint(1, 6))]
            out.append("\n".join(lines))
    return out


@pytest.fixture(scope="module")
def rows():
    plain = [(k, t, f"s{k % 4}", "x", None) for k, t in enumerate(texts())]
    odd = [
        (None, "a null id has words too", None, "x", "y"), (None, None, None, None, None), (900, None, "s0", None, None),
        (901, "", "s1", None, None), (902, " \n\t ", "s1", None, None), (903, "word", "s2", None, None),
        (904, "two words", "", None, None), (905, "x " * 20000 + "end", "s3", None, None), (905, "x " * 20000 + "end", "s3", None, None),
        (906, "ÀÉ wide\x85space İ ſecret=abcdefgh12", "s3", None, None),
    ]
    return plain + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1300)] + [(5, 5), (None, 3)]
    found = components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert {x.node: x.component for x in found} == union(real, {n for p in real for n in p})
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    values = sorted({p for _, p in prints})
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3]
    group = union(near, values)
    first = {}
    for doc, p in prints:
        if doc is not None:
            first[group[p]] = min(first.get(group[p], doc), doc)
    expected = sorted(((d, f"{p:016x}", first.get(group[p])) for d, p in prints), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == expected
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs, block=2).collect()), key=str) == expected
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(first.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_per_group(none).count() == 0


def test_pigeonring_loses_no_pair():
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 4))}) for b in base for _ in range(12)})
    links = set()
    for i in range(4):
        for half in (0, 1):
            key = {v: (v >> 16 * i & 0xFFFF, (v >> 16 * ((i + 1) % 4) & 0xFFFF) >> 8 * half & 0xFF) for v in values}
            order = sorted(values, key=lambda v: key[v])
            run = np.cumsum([0] + [key[a] != key[b] for a, b in zip(order, order[1:])])
            u, v = simhash.link_runs(run, np.full(len(order), i), np.array(order, np.uint64))
            links |= set(zip(u.tolist(), v.tolist()))
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3]
    assert union(links, values) == union(near, values)


def test_embeddings(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 16))
    vectors = [*base, *(base[k % 7] * 3 + r.normal(size=16) * 0.12 * (k % 5) for k in range(120)), *base[:9]]
    data = [(k, [float(x) for x in v], "c") for k, v in enumerate(vectors)]
    data += [(500, None, "n"), (501, [0.0] * 16, "z"), (502, [float("nan")] * 16, "n"), (503, [None, *[1.0] * 15], "n"), (504, [1.0], "d"), (505, [1e300] * 16, "h"), (506, [2e300] * 16, "h"), (507, [], "e"), (None, [1.0] * 16, "x")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links string")
    good = [(i, np.array(v) / max(map(abs, v))) for i, v, _ in data if i is not None and v and None not in v and any(v) and np.isfinite(v).all()]
    near = [(i, j) for k, (i, a) in enumerate(good) for j, b in good[k + 1 :] if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95]
    group = union(near, [d[0] for d in data if d[0] is not None])
    degree = {i: sum(i in p for p in near) for i in group}
    for tile in (4096, 16):
        found = embeddings.near_vectors(table, tile=tile).collect()
        assert len(found) == len(data)
        assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in found if x.vec_id is not None} == {(i, degree[i], g, i == g) for i, g in group.items()}
    assert embeddings.near_vectors(table.where("false")).count() == 0


def test_mixing_targets_of_a_billion_words(spark):
    """Sums that fit 32 bits while three times them do not, and sums far above 64 bits times weights."""
    for scale in (100_000_000, 200_000_000, 10**16):
        sizes = [("a", 4 * scale), ("b", 4 * scale), ("c", 2 * scale), ("d", scale // 100)]
        found = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
        # The small one gets three times its size; the others share the rest by 1, 2 and 3.
        left = sum(n for _, n in sizes) - 3 * sizes[3][1]
        assert found == {"a": float(left) / 6, "b": 2.0 * left / 6, "c": 3.0 * left / 6, "d": 3.0 * sizes[3][1]}


def test_mixing(docs, rows, none):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        rest, open_ = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * rest > 3 * size[s] * open_}
        if not more:
            break
        capped |= more
    target = {s: 3 * size[s] if s in capped else weight[s] * rest / open_ for s in order}
    taken = dict.fromkeys(order, 0)
    largest = dict.fromkeys(order, 0)
    for x in found:
        assert x.target == pytest.approx(target[x.source]) and x.source_size == size[x.source]
        assert x.taken in (0, x.size, 2 * x.size, 3 * x.size)
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    again = {(x.doc_id, x.taken) for x in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(x.doc_id, x.taken) for x in found}
    repeated = mixing.repeat_by_mix(docs)
    assert repeated.columns == docs.columns
    assert repeated.where("doc_id < 900").count() == sum(x.copies for x in found if x.doc_id is not None and x.doc_id < 900)
    assert mixing.mix(none).count() == 0


def character_shingles(line):
    norm = re.sub(r"[\s\x00]+", " ", line.lower(), flags=re.A).strip(" ")
    return {norm[i : i + 5] for i in range(max(1, len(norm) - 4))}


def test_lines_against_brute_force(spark):
    r, words = random.Random(11), vocabulary(7, 900)
    lines = [" ".join(r.choices(words, k=r.randint(3, 50))) for _ in range(250)]
    for k in range(200):
        own = lines[k].split(" ")
        own[r.randrange(len(own))] = r.choice(words)
        lines.append(" ".join(own) if k % 3 else lines[k].upper() + "  ")
    table = spark.createDataFrame([(k // 3, "\n".join(lines[k : k + 3])) for k in range(0, len(lines), 3)], "doc_id long, text string")
    norm = sorted({x.strip().lower() for x in lines})
    sets = {x: character_shingles(x) for x in norm}
    near = [(a, b) for k, a in enumerate(norm) for b in norm[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = len(set(union(near, norm).values()))
    found = sum(len(x.text.split("\n")) for x in fuzzy_lines.dedup_lines(table).collect() if x.text)
    assert len(near) > 60 and expected <= found <= expected + 0.03 * len(near)


def test_lines_of_large_buckets_all_meet(spark, monkeypatch):
    """Every close pair that shares a band ends in one component, however large its bucket."""
    monkeypatch.setattr(fuzzy_lines, "SMALL", 3)
    monkeypatch.setattr(fuzzy_lines, "BLOCK", 16)
    r, words = random.Random(5), vocabulary(9, 400)
    lines = set()
    for _ in range(3):
        base = r.choices(words, k=80)
        for _ in range(90):
            own = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                own[r.randrange(80)] = r.choice(words)
            lines.add(" ".join(own))
    table = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    rows = fuzzy_lines._lines(table, "doc_id", "text")
    distinct = fuzzy_lines.signatures(fuzzy_lines._distinct_lines(rows)).select("h", "keys").checkpoint()
    keys = {x.h: x["keys"] for x in distinct.collect()}
    sets = {x.h: character_shingles(x.norm) for x in rows.collect()}
    share = [(a, b) for a in keys for b in keys if a < b and any(x == y for x, y in zip(keys[a], keys[b]))]
    close = [(a, b) for a, b in share if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {h: c for h, c in union(close, keys).items() if any(h in p for p in close)}
    assert len(share) > len(close) > 500
    assert {x.h: x.component for x in fuzzy_lines.line_components(rows, distinct).collect()} == expected


def test_shingle_sets_overlap_at_every_position(spark):
    """Sets against plain slices: short, long, space-free, wide characters, tabs and runs of blanks."""
    r = random.Random(3)
    lines = ["a", "abcd", "abcde", "abcdef", "x" * 400, "a\tb  c\x0bd \t e", " İSTANBUL\u2028é ", "東京都は日本の首都", "😀x" * 70]
    lines += ["".join(r.choices("abcdé 😀", k=n)) for n in (63, 64, 65, 67, 68, 69, 72, 128, 132, 133, 500)]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    norm = fuzzy_lines.normalised(F.col("line"))
    found = table.select("line", norm.alias("norm"), fuzzy_lines.shingle_set(norm).alias("s")).collect()
    every = sorted({s for x in lines for s in character_shingles(x)})
    hashed = spark.createDataFrame([(s,) for s in every], "s string").select("s", F.xxhash64("s").alias("h"))
    hashes = {x.s: x.h for x in hashed.collect()}
    for x in found:
        assert len(x.s) == len(set(x.s)) and set(x.s) == {hashes[s] for s in character_shingles(x.line)}, x.line


def test_lines_edited_by_a_character_or_word(spark):
    """Lines with one character or word replaced, space-free and tab-separated ones, by brute force."""
    r, words = random.Random(17), vocabulary(13, 900)
    lines = []
    for k in range(240):
        gap = ("", " ", "\t", "  ")[k % 4]
        line = gap.join(r.choices(words, k=r.randint(8, 60)))
        at = r.randrange(1, len(line) - 1)
        edits = [line[:at] + "#" + line[at + 1 :], line.replace(gap, " \t") if gap else line.upper()]
        own = line.split(gap) if gap else [line]
        own[r.randrange(len(own))] = r.choice(words)
        lines += [line, *edits, *([gap.join(own)] if gap else [])]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = {k: character_shingles(x) for k, x in enumerate(lines)}
    near = [(a, b) for a in sets for b in range(a + 1, len(lines)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = union(near, sets)
    kept = {x.doc_id for x in fuzzy_lines.dedup_lines(table).collect() if x.text}
    wrong = [k for k, c in first.items() if (k == c) != (k in kept)]
    assert len(near) > 400 and {k for k, c in first.items() if k == c} <= kept and len(wrong) <= 0.01 * len(near)


def test_close_lines_of_large_buckets_all_meet(spark, monkeypatch):
    """As above, by overlapping character shingles."""
    monkeypatch.setattr(fuzzy_lines, "SMALL", 3)
    monkeypatch.setattr(fuzzy_lines, "BLOCK", 16)
    r, words = random.Random(5), vocabulary(9, 400)
    base, lines = r.choices(words, k=60), set()
    for _ in range(70):
        own = list(base)
        for _ in range(r.choice([1, 2, 2])):
            own[r.randrange(60)] = "".join(r.choices("0123456789", k=12))
        lines.add(" ".join(own))
    table = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string")
    rows = fuzzy_lines._lines(table, "doc_id", "text")
    distinct = fuzzy_lines.signatures(fuzzy_lines._distinct_lines(rows)).select("h", "keys").checkpoint()
    keys = {x.h: x["keys"] for x in distinct.collect()}
    sets = {x.h: character_shingles(x.norm) for x in rows.collect()}
    share = [(a, b) for a in keys for b in keys if a < b and any(x == y for x, y in zip(keys[a], keys[b]))]
    close = [(a, b) for a, b in share if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {h: c for h, c in union(close, keys).items() if any(h in p for p in close)}
    assert len(share) > len(close) > 20
    assert {x.h: x.component for x in fuzzy_lines.line_components(rows, distinct).collect()} == expected


def test_signatures_have_the_size_and_the_bands_of_the_set(spark):
    """Bands by plain slices of the sorted circle, short sets included; pairs of unlike size or counts meet no text."""
    r = random.Random(29)
    lines = ["".join(r.choices("abcdefgh 😀é", k=n)).strip() or "x" for n in (1, 4, 5, 6, 7, 8, 9, 40, 300)]
    table = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "h long, at long, norm string")
    sets = table.select("h", fuzzy_lines.shingle_set(F.col("norm")).alias("s"))
    wanted, hashes = {}, {x.h: x.s for x in sets.collect()}
    for x in sets.collect():
        s = sorted(x.s)
        below = [sum(v < c for v in s) for c in fuzzy_lines.CUTS]
        wanted[x.h] = len(s), [[s[(b + k) % len(s)] for k in range(fuzzy_lines.ROWS)] for b in below]
    flat = [(h, b, *v) for h, (_, bands) in wanted.items() for b, v in enumerate(bands)]
    hashed = spark.createDataFrame(flat, "h long, b int, s0 long, s1 long, s2 long, s3 long")
    keys = {(x.h, x.b): x.k for x in hashed.select("h", "b", F.xxhash64("b", "s0", "s1", "s2", "s3").alias("k")).collect()}
    found = fuzzy_lines.signatures(table)
    for x in found.collect():
        assert x.n == wanted[x.h][0] and x["keys"] == [keys[x.h, b] for b in range(fuzzy_lines.BANDS)]
        parts = [sum(c <= v < c + (1 << 59) for v in hashes[x.h]) for c in fuzzy_lines.PART_CUTS]
        assert list(x.counts) == parts
    many = [0] * 32
    sketches = [(1, 80, many), (2, 100, many), (3, 79, many), (4, 80, [17, *many[1:]]), (5, 80, [18, *many[1:]])]
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3), (1, 4), (1, 5)], "u long, v long")
    sketches = spark.createDataFrame(sketches, "h long, n int, counts array<tinyint>")
    assert sorted(map(tuple, fuzzy_lines._possible_pairs(pairs, sketches).collect())) == [(1, 2), (1, 3), (1, 4)]


def test_sketches_leave_unlike_lines_of_a_bucket_without_texts(spark, monkeypatch):
    """Bits against plain parity; of a bucket of long unlike lines only close ones, put in one component each, are hit."""
    monkeypatch.setattr(fuzzy_lines, "BLOCK", 4)
    r = random.Random(41)
    lines = ["".join(r.choices("abcdefgh 😀é", k=n)).strip() or "x" for n in (1, 4, 5, 9, 40)]
    lines += [" ".join(r.choices(vocabulary(43, 900), k=r.randint(120, 130))) for _ in range(60)]
    lines += [lines[7][:300] + "#" + lines[7][300:], lines[9].replace(" ", "  ", 1) + " end"]
    table = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "h long, at long, norm string")
    sets = {x.h: set(x.s) for x in table.select("h", fuzzy_lines.shingle_set(F.col("norm")).alias("s")).collect()}
    found = fuzzy_lines.signatures(table).checkpoint()
    for x in found.collect():
        words = [0] * fuzzy_lines.WORDS
        for v in sets[x.h]:
            words[(v + (1 << 63)) * fuzzy_lines.WORDS >> 64] ^= 1 << (v & 63)
        assert [v & (1 << 64) - 1 for v in x.bits] == words
    close = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(7, 65), (9, 66)} <= close
    left, right = (found.select(*(F.col(c).alias(f"{c}_{x}") for c in ("h", "n", "counts", "bits"))) for x in "uv")
    met = left.join(right, F.col("h_u") < F.col("h_v"))
    of = lambda name: (F.col(f"{name}_u"), F.col(f"{name}_v"))
    let = {tuple(x) for x in met.where(fuzzy_lines.alike_by_bits(*of("n"), *of("bits"))).select("h_u", "h_v").collect()}
    counted = met.where(fuzzy_lines.possible(*of("n"), *of("counts"))).count()
    assert close <= let and len(let) < 10 < 100 < counted
    bucket = found.selectExpr("1L key", "h", "h part", "n", "bits", "17 blocks")
    assert {x.h for x in fuzzy_lines._hits(bucket).collect()} == {h for p in let for h in p}
    long = [" ".join(r.choices(vocabulary(47, 3000), k=r.randint(330, 340))) for _ in range(8)]
    long = spark.createDataFrame([(k, k, x) for k, x in enumerate([*long, long[3] + " end"])], "h long, at long, norm string")
    coarse = fuzzy_lines.signatures(long).selectExpr("1L key", "h", "h part", "n", "bits", "3 blocks").checkpoint()
    fine = coarse.drop("bits").join(fuzzy_lines.fine_sketches(long), "h")
    assert fuzzy_lines._hits(coarse).count() == 9
    assert {x.h for x in fuzzy_lines._hits(fine, fuzzy_lines.FINE_WORDS).collect()} == {3, 8}
    one = bucket.withColumn("part", F.lit(1))
    assert fuzzy_lines._hits(one).count() == 0


def test_lines_odd_cases(spark, docs, rows, none):
    table = spark.createDataFrame(
        [(1, "Same Line \n\nother", "k"), (2, "same line\nnew", "k"), (2, "same line\nnew", "k"), (3, None, "k"), (4, "", "k"), (5, " \n", "k"), (None, "same line", "k"), (6, "東京都は日本の首都\nother", "k")],
        "doc_id long, text string, kept string",
    )
    found = fuzzy_lines.dedup_lines(table)
    assert found.columns == table.columns
    assert sorted((tuple(r)[:2] for r in found.collect()), key=str) == sorted(
        [(1, "\nother"), (2, "new"), (2, "new"), (3, None), (4, ""), (5, " \n"), (None, "same line"), (6, "東京都は日本の首都")], key=str
    )
    assert fuzzy_lines.dedup_lines(docs).count() == len(rows) and fuzzy_lines.dedup_lines(none).count() == 0


def test_statistics():
    for text in [*texts(2, 40), "", " ", "a b c d e " * 9, "é# $\n\né# $\nx", "x " * 3000]:
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(words) < 400 else None
        own = dict(zip(text_stats.NAMES, text_stats.statistics(text.encode())))
        assert own["n_words"] == len(words) and own["word_chars"] == sum(map(len, words))
        assert own["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert own["n_dup_lines"] == len(lines) - len(set(lines))
        assert own["n_repeat_words"] == (len(hit) if hit is not None else len(words))


def test_decision_list(spark, docs, rows, none):
    r = np.random.default_rng(2)
    columns = {"a": r.random(3000), "b": r.random(3000)}
    bad = (columns["a"] > 0.8) & (columns["b"] < 0.3) | (columns["a"] < 0.05)
    rules = decision_list.learn(columns, bad)
    fresh = {"a": r.random(2000), "b": r.random(2000)}
    truth = (fresh["a"] > 0.8) & (fresh["b"] < 0.3) | (fresh["a"] < 0.05)
    judged = np.any([decision_list.covers(rule, fresh, 2000) for rule in rules], axis=0)
    assert (judged == truth).mean() > 0.98 and rules == decision_list.learn(columns, bad)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(fresh["a"][:300], fresh["b"][:300])], "a double, b double")
    numbers = [x[0] for x in frame.select(decision_list.expression(rules)).collect()]
    assert [n > 0 for n in numbers] == judged[:300].tolist()
    assert decision_list.learn(columns, np.zeros(3000, bool)) == []
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    found = decision_list.judge(docs, decision_list.fit(docs, labels)).collect()
    assert len(found) == len(rows) and all(not x.kept for x in found if x.n_words < 10)
    kept = decision_list.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.kept for x in found)
    assert decision_list.keep_good(none, labels).count() == 0


def test_quality_verdicts_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{n}.parquet") for n in ("documents", "labels"))
    rules = decision_list.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = decision_list.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert rules and good > 0.97 and bad < 0.5


def test_substrings(docs, rows, none):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = {}
    for own in words:
        for i in range(len(own) - 34):
            key = tuple(own[i : i + 35])
            seen[key] = seen.get(key, 0) + 1
    expected = []
    for row, own in zip(rows, words):
        gone = {i + j for i in range(len(own) - 34) if seen[tuple(own[i : i + 35])] > 1 for j in range(35)}
        expected.append((row[0], len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    for bits in (None, 3):
        found = substring.remove_repeated(docs, bits=max(bits, 16) if bits else None).collect()
        assert sorted((tuple(x) for x in found), key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 1000 and substring.remove_repeated(none).count() == 0


def slow_repair_cost(roles, state=chat.START):
    if not roles:
        return chat.ENDS[state][0]
    return min(cost + slow_repair_cost(roles[1:], t) for (s, t), (cost, _, _) in chat.STEPS[roles[0]].items() if s == state)


def test_chat_costs_and_legality():
    r = random.Random(4)
    for _ in range(60):
        roles = [r.randrange(4) for _ in range(r.randint(1, 6))]
        steps, cost = chat.repair(roles)
        assert cost == slow_repair_cost(tuple(roles))
        out = [chat.rendered(*s, "t", k == len(steps) - 1) for k, s in enumerate(steps)]
        names = [chat.NAMES.index(x) for x in re.findall(r"<\|(system|user|assistant)\|>", "".join(out))]
        assert all(b in chat.LEGAL[a] for a, b in zip([chat.START, *names], names)) and names[-1] == chat.ASSISTANT
        assert "".join(out).count("<|end|>") == len(names)


def test_chat_tables(spark):
    r = random.Random(6)
    data = [(c, t, r.choice(["user", "assistant", "system", "Human", None, "tool"]), f"c{c}t{t}") for c in range(30) for t in range(r.randint(1, 9))]
    data += [(99, t, r.choice(["user", "assistant"]), f"long{t}") for t in range(800)] + [(None, None, None, None), (31, 1, "user", "tie"), (31, 1, "user", "tie")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(7)
    found = chat.format_chats(table).collect()
    assert len(found) == len(data)
    for conv in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == conv), key=lambda d: d[1] or 0)
        steps, _ = chat.repair([chat.role_number(d[2]) for d in own])
        text = "".join(chat.rendered(*s, d[3] or "", k == len(own) - 1) for k, (s, d) in enumerate(zip(steps, own)))
        assert "".join(x.rendered for x in sorted((x for x in found if x.conv_id == conv), key=lambda x: x.turn or 0)) == text
    assert chat.format_chats(table.where("false")).count() == 0


def test_codec_round_trip():
    r = np.random.default_rng(1)
    for ids in ([], [0], [1] * 500, list(r.integers(0, 50000, 4000)), list(r.integers(0, 3, 700)), [2**59, 5, 2**31, 2**30, 7]):
        words = token_codec.pack_words(np.array(ids, np.uint64))
        assert token_codec.unpack_words(words, len(ids)).tolist() == [int(x) for x in ids]
    assert len(token_codec.pack_words(np.ones(600, np.uint64))) == 10
    with pytest.raises(ValueError):
        token_codec.pack_words(np.array([2**60], np.uint64))


def plain_ids(name, text, end):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer(name))
    return [*own.encode(text or "", add_special_tokens=False).ids, end]


ODD = ["don't  stop\n\n x", "a\t b\n\tc", "!!,.. ?x", "l'été, déjà.vu", "éa x́.", "a\x1cb !\x1c!", "\xa0 x  y\x85z", "<|endoftext|> <|startoftext|>", "  lead trail  ", "ΑΣ. İI i̇", "日本語 テキスト。", "word,word|x;y'z 12,345 a1b2"]


@pytest.mark.parametrize("name,byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_ids_equal_the_tokenizers(name, byte_level, rows):
    some = [*ODD, *(r[1] or "" for r in rows[:60]), "".join(ODD), " \n".join(ODD)]
    for text, ids in zip(some, encoder(tokenizer(name), byte_level).encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text, 0)[:-1], text


def test_token_blocks(docs, rows, none):
    blocks = token_codec.encode_table(docs, tokenizer("word_bpe_49k.json"))
    found = sorted((tuple(x) for x in token_codec.token_digests(blocks).collect()), key=lambda x: x[1])
    start = 0
    assert [x[0] for x in found if x[0] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    own = {(r[0], zlib.crc32(np.array(i, "<u4").tobytes()), len(i)) for r in rows for i in [plain_ids("word_bpe_49k.json", r[1], 1)]}
    for doc, at, n, crc in found:
        assert at == start and (doc, crc, n) in own
        start += n
    assert len(found) == len(rows) == token_codec.read_tokens(blocks).count()
    assert token_codec.token_digests(token_codec.encode_table(none, tokenizer("word_bpe_49k.json"))).count() == 0


def test_packing(docs, rows, none):
    found = packing.pack(docs, tokenizer("byte_bpe_50k.json"), shard=64).collect()
    ids = [(r[0], plain_ids("byte_bpe_50k.json", r[1], 2)) for r in rows]
    assert sum(x.length for x in found) == sum(len(i) for _, i in ids)
    parts = {(d, x.piece, x.start, x.length, zlib.crc32(np.array(i[x.start : x.start + x.length], "<u4").tobytes())) for x in found for d, i in ids if d == x.doc_id}
    assert all((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) in parts for x in found)
    assert all(x.length == 1024 for x in found if x.piece > 0)
    by = {}
    for x in found:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 1024
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_memory_of_chunks_has_two_generations(monkeypatch):
    """Whatever is forgotten in between, ids are the library's; what comes again stays."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "GROUP", 7)
    own = tokens.Encoder(tokenizer("word_bpe_49k.json"), tokens.WORD_LEVEL)
    words = vocabulary(4, 300)
    for k in range(60):
        some = [" ".join(words[k * 5 : k * 5 + 9]) + " always here", f"<|endoftext|> {words[k]}"]
        for text, ids in zip(some, own.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == library_ids("word_bpe_49k.json", text)
        assert len(own.known) <= 60 and len(own.older) <= 60 and "always" in own.known


def test_rows_of_one_id_are_spread_over_ranges(spark):
    table = spark.range(3000, numPartitions=6).selectExpr("cast(7 as long) doc_id", "cast(id as string) text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = token_codec.encode_table(table, tokenizer("word_bpe_49k.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = token_codec.token_digests(blocks).collect()
    assert blocks.select("part").distinct().count() > 2 and len(found) == 3000
    assert sorted(x.start for x in found)[-1] + max(found, key=lambda x: x.start).n_tokens == sum(x.n_tokens for x in found)


def test_rows_that_repeat_are_dealt_to_many_shards(spark):
    table = spark.range(600).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    found = packing.pack(table, tokenizer("byte_bpe_50k.json"), shard=64).collect()
    shards = [x.sequence_id >> 32 for x in found]
    assert len(found) == 600 and max(map(shards.count, set(shards))) < 150


SPECIAL = ["end <|endoftext|> start", "<|startoftext|>a<|endoftext|>", "x|<|endoftext|>|y", "a  <|endoftext|>\n\n b", "it<|endoftext|>'s", "<|ENDOFTEXT|> <|endoftext |>", "é.<|endoftext|>. \x85<|endoftext|>"]


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_special_tokens_in_texts_are_the_librarys(name, byte_level):
    r = random.Random(21)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "a", "Été", ".", "!", "|", "'s", "<", "12", "\x1c", "\xa0"]
    some = [*SPECIAL, *("".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(300))]
    for text, ids in zip(some, encoder(tokenizer(name), byte_level).encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(name, text), text


def test_tables_hold_the_librarys_ids(spark):
    table = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    blocks = token_codec.encode_table(table, tokenizer("word_bpe_49k.json"))
    found = {x[0]: tuple(x)[2:] for x in token_codec.token_digests(blocks).collect()}
    word = {k: np.array([*library_ids("word_bpe_49k.json", t), 1], "<u4") for k, t in enumerate(SPECIAL)}
    assert found == {k: (len(i), zlib.crc32(i.tobytes())) for k, i in word.items()}
    packed = {x.doc_id: (x.length, x.ids_crc32) for x in packing.pack(table, tokenizer("byte_bpe_50k.json")).collect()}
    byte = {k: np.array([*library_ids("byte_bpe_50k.json", t), 2], "<u4") for k, t in enumerate(SPECIAL)}
    assert packed == {k: (len(i), zlib.crc32(i.tobytes())) for k, i in byte.items()}


def test_local_search_only_helps():
    r = np.random.default_rng(0)
    for n in (1, 2, 50, 600):
        sizes = r.integers(1, 700, n)
        start, best = packing.best_fit_decreasing(sizes, 1024), packing.pack_sizes(sizes)
        assert sorted(i for b in best for i in b) == list(range(n)) and all(sizes[b].sum() <= 1024 for b in best)
        assert -(-sizes.sum() // 1024) <= len(best) <= len(start)


PLAIN_SECRET = "Zx9-Qp2_Lm7Ty"
IN_SYNTAX = [
    ('db_password: str = "{}"', True), ('const apiSecretKey: string = "{}";', True), ('token =\n    "{}"', True), ('password = ("{}")', True),
    ('password = """{}"""', True), ('password = os.getenv("PW", "{}")', True), ('password = os.getenv("{}")', False),
    ('password = os.environ["{}"]', False), ('secret = Secret("{}")', True), ("password: >\n  {}\nother: 1", True),
    ("a:\n  password: |-\n    {}\n  b: 2", True), ("<password>{}</password>", True), ('<add key="DbPassword" value="{}"/>', True),
    ('let token: &str = "{}";', True), ('val password: String = "{}"', True), ('var secret string = "{}"', True), ('char password[] = "{}";', True),
    ("url = http://h/?token={}&x=1", True), ("password={}", True), ('"password": "{}",', True), ("config = {{'api_key': '{}'}}", True),
    ("export SECRET_KEY={}", True), ('def f(password: str = "{}", n: int = 3):', True), ('self.api_token: Optional[str] = "{}"', True),
    ('x = a + \\\n  b\npassword = \\\n "{}"', True), ('name = "{}"', False), ('KEY = "{}"\nclient_secret = wrap(KEY)', True), ("password = decrypt(load())", None),
]


@pytest.mark.parametrize("form, there", IN_SYNTAX)
def test_secrets_in_syntax(form, there):
    text = form.format(PLAIN_SECRET)
    assert [text[a:b] for a, b in secret_lexer.lexed(text)] == ([PLAIN_SECRET] if there else [])


def test_adjacent_literals_are_one_secret():
    for text in ('password = "Zx9-Qp2_" "Lm7Ty"', 'password = (\n  "Zx9-Qp2_"\n  "Lm7Ty"\n)'):
        (span,) = secret_lexer.lexed(text)
        assert text[slice(*span)].startswith("Zx9-Qp2_") and text[slice(*span)].endswith("Lm7Ty")


@pytest.mark.parametrize("run", ["ab:", "k=v&"])
def test_long_runs_without_names_cost_nothing(run):
    start = time.monotonic()
    assert secret_lexer.secret_spans(run * (1_000_000 // len(run))) == []
    assert time.monotonic() - start < 1


@pytest.mark.parametrize(
    "run",
    ["token:", "token=", 'password="', "a = a + a\n", 'a="{a}{a}"\n', "x=(", "='", "a: |\n ", 'token = f("x", ', "password=abc:def ", "\'\'\'='", "q=`", "a: b ", "x: a[", "<a>"],
)
def test_secret_scan_is_linear(run):
    """Twice the text takes about twice the time: no run is read again from each of its operators."""
    took = []
    for size in (60_000, 240_000):
        text = "token " + run * (size // len(run))
        start = time.monotonic()
        secret_lexer.secret_spans(text)
        took.append(time.monotonic() - start)
    assert took[1] < 8 * took[0] + 1


def test_secrets(docs, rows, none):
    lower = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    cases = ['token=token="12345678"', "Secret: abcdefgh x", "ſecret=abcdefgh12", "AKIAAKIA1234567890", "AKIA12", "f" * 40 + "g" + "a" * 31, ""]
    for text in [*cases, *(r[1] or "" for r in rows)]:
        base = [("assign", *m.span()) for m in lower.finditer(text) if len(m.group(2)) >= 8]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
        assert [s for s in secret_lexer.secret_spans(text) if s[0] != "lexed"] == sorted(base, key=lambda s: (s[1], secret_lexer.KINDS.index(s[0])))
    for text, secret in {
        'BASE = "aZ9xQ2mK7"\ndbPassword = BASE + "tail!8"': 'aZ9xQ2mK7"\ndbPassword = BASE + "tail!8',
        "raw = 'Xy7-Qp2_Zz9'\nclient_secret: raw": "Xy7-Qp2_Zz9",
        'private_key => "q1W2e3R4t5Y6"': "q1W2e3R4t5Y6",
    }.items():
        assert [text[a:b] for a, b in secret_lexer.lexed(text)] == [secret]
    for text in ('password_length = "12345678ab"', 'password = "changeme"', 'token = "${TOKEN}"', "note: the token was lost yesterday"):
        assert secret_lexer.lexed(text) == []
    assert secret_lexer.scan_secrets(docs).count() == len(rows) and secret_lexer.scan_secrets(none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_words_met_before_are_not_cut_into_chunks_again():
    """Words of letters, with marks and symbols, in any case: ids are the library's, and known words stay known."""
    r = random.Random(5)
    words = ["".join(r.choices("abcXYZéÀßÿñªº×÷µ", k=r.randint(1, 6))) for _ in range(400)]
    ends = ["", "", ",", ".", "...", "!?", "$$$", "%.", "&*", "<", "'s", "1", "-b", "<|endoftext|>", "#<|endoftext|>"]
    some = ["".join(f"{r.choice(words)}{r.choice(ends)}{r.choice([' ', '  ', chr(10), chr(0xA0)])}" for _ in range(30)) for _ in range(60)]
    some += ["<|ENDOFTEXT|> A", "İI ŉ Σας ΑΣ ŀ", "x\x1cy Z", "", " "]
    own = tokens.WordEncoder(tokenizer("word_bpe_49k.json"))
    for text, ids in zip(some, own.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids("word_bpe_49k.json", text), text
    again = [" ".join(reversed(t.split())) for t in some]
    own.parts = None
    for text, ids in zip(again, own.encode(again)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids("word_bpe_49k.json", text), text
