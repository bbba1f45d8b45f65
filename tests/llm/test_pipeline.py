import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
import __spark_entry__ as driver
from test_operators import WORD, character_shingles, library_ids, slow_fingerprint, union, vocabulary
from tracesieve.llm import decision_list, queries


def test_stages_keep_columns_and_pack_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3]
    packed = corpus_pipeline.pack_sequences(spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_registered(spark, sf_dir):
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    for name in ("op1_simhash", "op4_line_dedup", "op5_quality_rules", "op9_secret_scan"):
        assert queries.QUERIES[name](spark, sf_dir).count() == queries.table(spark, sf_dir, "documents").count()


def labelled_documents():
    """Documents with nulls, repeats, near copies, junk and a column named like one of the stages' own."""
    r, words = random.Random(29), vocabulary(31, 1200)
    rows = []
    for k in range(90):
        lines = [" ".join(r.choices(words, k=r.randint(12, 40))) for _ in range(r.randint(1, 5))]
        if k % 6 == 1 and rows:
            lines.insert(0, rows[r.randrange(len(rows))][1].split("\n")[0])  # a line of another document
        if k % 6 == 2:
            lines = [lines[0], lines[0].upper() + "  "] + lines[1:]  # its own line again
        text = "\n".join(lines)
        if k % 10 == 3:
            text = " ".join(r.choices(words[:3], k=60))  # repeats its windows
        if k % 10 == 4:
            text = "short text"
        rows.append((k, text, "en", f"s{k % 3}" if k % 7 else None, len(text), "x"))
    for k in (5, 15, 26):  # near copies: a word of a long text is another
        own = rows[k][1].split(" ")
        own[len(own) // 2] = "changed"
        rows.append((100 + k, " ".join(own), "en", "s1", 1, "x"))
    rows += [rows[8], (200, None, None, None, None, None), (201, "", "en", "s0", 0, "x"), (202, " \n ", "en", "s0", 3, "x"), (None, rows[9][1], "en", "s2", 5, "x")]
    return rows


def slow_base_failed(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(5)}
    return len(words) < 10 or 100 * len(covered) > 20 * len(words)


def slow_lines(docs):
    """Texts of (doc_id, text) without the lines that are like an earlier one; equal documents are one."""
    order = sorted({(d is not None, d or 0, t) for d, t in docs if t is not None})
    place = [(key, i, line) for key in order for i, line in enumerate(key[2].split("\n")) if line.strip()]
    sets = [character_shingles(line) for _, _, line in place]
    near = [(a, b) for a in range(len(place)) for b in range(a + 1, len(place)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = union(near, range(len(place)))
    gone = {(place[k][0], place[k][1]) for k in group if group[k] != k}
    return {k: "\n".join(x for i, x in enumerate(k[2].split("\n")) if (k, i) not in gone) for k in order}


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    rows = labelled_documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k % 10 not in (3, 4)), 0) for k in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    paths = {}

    def named(session, name):
        paths[name] = str(tmp_path / f"stage-{name}")
        return paths[name]

    monkeypatch.setattr(corpus_pipeline, "new_table_path", named)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stage = {name: [tuple(x) for x in spark.read.parquet(path).collect()] for name, path in paths.items()}
    assert list(stage) == [name for name, _ in corpus_pipeline.STAGES]
    for name, path in list(paths.items())[:-1]:
        assert spark.read.parquet(path).columns == schema.replace(",", "").split(" ")[::2]

    # Learned rules are taken as given: what they reject beyond the base rules, by number.
    docs = queries.table(spark, str(tmp_path), "documents")
    rules = decision_list.fit(docs, queries.table(spark, str(tmp_path), "labels"))
    learned = {(x.doc_id, x.n_words) for x in decision_list.judge(docs, rules).where("rule > 0").collect()}
    good = [x for x in rows if not slow_base_failed(x[1]) and (x[0], len(WORD.findall(x[1] or ""))) not in learned]
    assert sorted(stage["quality_rules"], key=str) == sorted(good, key=str) and 40 < len(good) < len(rows)

    left = slow_lines([(x[0], x[1]) for x in good])
    texts = [left[x[0] is not None, x[0] or 0, x[1]] for x in good]
    shorter = [(x[0], t, *x[2:4], len(t), x[5]) for x, t in zip(good, texts)]
    assert sorted(stage["line_dedup"], key=str) == sorted(shorter, key=str)
    assert sum(x != y for x, y in zip(good, shorter)) > 10

    prints = [slow_fingerprint(x[1]) for x in shorter]
    values = sorted(set(prints))
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3]
    group = union(near, values)
    order = sorted(range(len(shorter)), key=lambda k: (shorter[k][0] is None, shorter[k][0] or 0))
    first = {}
    for k in order:
        first.setdefault(group[prints[k]], shorter[k])
    assert sorted(stage["simhash_dedup"], key=str) == sorted(first.values(), key=str) and len(first) < len(shorter)

    kept = stage["simhash_dedup"]
    copies = Counter(stage["mix_sources"])
    taken, size = Counter(), Counter()
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    for x in kept:
        size[x[3]] += len(WORD.findall(x[1]))
        taken[x[3]] += copies[x] * len(WORD.findall(x[1]))
    largest = max(len(WORD.findall(x[1])) for x in kept)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        rest, open_ = sum(size.values()) - sum(3 * size[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in weight if s not in capped and weight[s] * rest > 3 * size[s] * open_}
        if not more:
            break
        capped |= more
    for s in weight:
        target = 3 * size[s] if s in capped else weight[s] * rest / open_
        assert abs(taken[s] - target) <= 2 * largest

    ids = Counter((x[0], zlib.crc32(np.array([*library_ids("byte_bpe_50k.json", x[1]), 2], "<u4").tobytes())) for x in stage["mix_sources"])
    whole = Counter((x.doc_id, x.ids_crc32) for x in packed if x.piece == 0 and x.length < 1024)
    assert whole == ids, "every document of the mix is packed as often as it was taken"
    fill = Counter()
    for x in packed:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 1024
