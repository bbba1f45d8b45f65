"""Page text, Merkle manifest and prefix trie against plain Python."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesieve.llm import merkle, page_text, prefix_trie, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Page text


def lead(html):
    return "\n\n".join(t for t in page_text.read_page(html)[0] if t is not None)


PAGES = [
    ("<article><h1>T &amp; t</h1><p>one<br>two &nbsp; <b>three</b></p><p>four</article>", "T & t\n\none two three\n\nfour"),
    ("<nav><li>menu</nav><article><p><b>a.<br><p>b</article><footer>f</footer>", "a.\n\nb"),
    ("<p>no article", "no article"),
    ("plain &lt;text&gt; 1 < 2 & 3", "plain <text> 1 < 2 & 3"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut &amp", "cut &"),
    ("<article><p>cut</p><p", "cut"),
    ("<article>a<!-- <p>no</p> -->b<!-- open <p>x", "ab"),
    ("<article>a<script>var t='</p>';</script>b<style>p{}</style> c</article>", "ab c"),
    ("<article><p>x</p><script>open ended <p>y</p>", "x"),
    ("<main><h1>t</h1><p>a</p><aside>no</aside></main><p>out</p>", "t\n\na"),
    ("<main><article><p>a</p></article><section>teaser</section></main>", "a"),
    ("<article><p>teaser</p></article><main><p>real</p></main>", "real"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>a</p></article>", "Title\n\na"),
    ('<div class="cookie-notice">c</div><div class="page no-sidebar"><p>a</p></div>', "a"),
    ('<div id="sidebarLeft">s</div><div class="social-layout"><article><p>a</p></article></div>', "a"),
    ('<article><p>a</p><section id="comments"><article><p>reader</p></article></section></article>', "a"),
    ('<article><p>a</p></article><div class="comments"><article class="comment">r</article></div>', "a"),
    ('<div><form><main><p>a<input value="b"></p></main></form><form>f <button>go</button></form></div>', "a"),
    ('<article><p hidden>h</p><p style="display: none">n</p><p>a <span class="share">s</span>b</p></article>', "a b"),
    ("<title>no</title><p>a</p>", "a"),
    ("<html><head><title>no</title><meta charset=x><p>a", "a"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><th>3</table>", "a\n\nb\n\nc\n\n1 2\n\n3"),
    ("<dl><dt>a<dd>b<dt>c</dl><pre> x\n y </pre>", "a\n\nb\n\nc\n\nx y"),
    ('<p title="a>b">c</p><p title=\'d>e\'>f</p></nothing></p>g', "c\n\nf\n\ng"),
    ("<p>&#x41;&#66;&quot;&eacute;&copy &hellip;</p>", 'AB"é© …'),
    ("<![CDATA[x]]><?php y ?></ >z", "z"),
    ("", ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_page_blocks(html, text):
    assert lead(html) == text


@pytest.mark.parametrize(
    "html",
    ["<a " * 100000, "<!--" * 100000, '<a b="' * 100000, "<div>" * 100000 + "</section>" * 100000, "<li>" * 50000 + "x",
     "<p>x" * 50000, "<" * 200000, "&" * 200000, "<b class=ad>" * 50000, "<table><tr><td>" * 30000, "<script>" * 50000],
)
def test_pages_of_any_shape_end(html):
    start = time.monotonic()
    page_text.read_page(html)
    assert time.monotonic() - start < 10


def slow_pages(rows, min_pages, copy_share):
    """Template removal by comparing all pages of a host with each other, subtree by subtree."""
    read = [(page_text.Page(h or ""), page_text.site(u)) for _, u, h in rows]
    main = []
    for page, _ in read:
        n = len(page.blocks)
        main.append((page_text.covers(page.scope(), n) & ~page_text.covers(page.labelled, n)).tolist())

    def companion(k, first, last):
        page = read[k][0]
        return max((len(t), t) for i, t in enumerate([*page.blocks, ""]) if i == len(page.blocks) or (main[k][i] and not first <= i < last))[1] \
            if any(main[k][i] and not first <= i < last for i in range(len(page.blocks))) else None

    met = {}
    for k, (page, host) in enumerate(read):
        for first, last, code, countable in page.subtrees:
            if host and countable and companion(k, first, last):
                met.setdefault((host, code), set()).add(companion(k, first, last))
    out = []
    for k, (page, host) in enumerate(read):
        gone = set()
        for first, last, code, countable in page.subtrees:
            if host and countable and companion(k, first, last) and len(met[host, code]) >= min_pages:
                gone |= set(range(first, last))
        all_main = [t for t, m in zip(page.blocks, main[k]) if m]
        left = [t for i, t in enumerate(page.blocks) if main[k][i] and i not in gone]
        if sum(map(len, left)) < (1 - copy_share) * sum(map(len, all_main)):
            left = all_main
        out.append((rows[k][0], rows[k][1], "\n\n".join(left)))
    return out


@pytest.fixture(scope="module")
def sites():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(words, k=n))
    rows, copy = [], f"<article><h1>{say(4)}</h1><div><p>{say(60)}</p><p>{say(20)}</p></div></article>"
    for host in range(4):
        box, foot, licence, block = say(6), say(5), say(12), say(9)
        for k in range(14):
            url = f"http://h{host}.example.org:80/{k}"
            text = "".join(f"<p>{say(30)}</p>" for _ in range(3)) + f"<p>{licence}</p>"
            if k % 3:
                html = f"<nav><ul><li>{say(1)}</li><li>home</li></ul></nav><article><h1>{say(3)}</h1>{text}<div><b>{box}</b></div></article>"
            else:
                html = f"<div><div>{block}</div></div><div>{text}</div><div>{foot}</div>"
            rows.append((len(rows), url, f"<html><body>{html}<footer>{foot}</footer></body></html>"))
            rows.append((len(rows), url, f"<body>{copy}<div>{say(5)}</div></body>"))
    rows += [(900, None, "<div>x</div><p>y z</p>")] * 6 + [(901, "no url", None), (None, "http://h0.example.org", "")]
    return rows


def test_templates_go(spark, sites):
    table = spark.createDataFrame([(*x, "extra", 1) for x in sites], "page_id long, url string, html string, text string, n_chars int")
    found = [tuple(x) for x in page_text.extract_pages(table.repartition(5)).select("page_id", "url", "text", "n_chars").collect()]
    expected = [(*x, len(x[2])) for x in slow_pages(sites, page_text.MIN_PAGES, page_text.COPY_SHARE)]
    key = lambda x: (str(x[0]), x[2])
    assert sorted(found, key=key) == sorted(expected, key=key)
    texts = {x[0]: x[2] for x in found}
    for k, (page_id, _, html) in enumerate(sites[:112]):
        blocks = texts[page_id].split("\n\n")
        if k % 2:
            assert len(blocks) == 3, "copies of one article stay whole"
        elif "<nav>" in html:
            assert len(blocks) == 5, "the repeated box goes, the licence line stays"
        else:
            assert len(blocks) == 3, "no article: what the site repeats goes"


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extract_pages(none).count() == 0


# Merkle manifest


def slow_tree(leaves):
    """(root, path of each leaf as a list of (left, right))"""
    paths, level, owner = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(owner):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        owner = [at // 8 for at in owner]
    return level[0], paths


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("n", [0, 1, 8, 9, 700])
def test_manifest(spark, n):
    r = random.Random(n)
    rows = [
        (r.choice([None, *range(400)]), r.choice([None, "", "en", "dé", "en2", "z"]), r.choice([None, "", "Some Text", f"t{k}", "ÀB"]))
        for k in range(n)
    ]
    rows += rows[: n // 4]  # equal rows are leaves of their own
    table = spark.createDataFrame([(*x, "x", "y") for x in rows], "doc_id long, lang string, text string, leaf string, g string")
    claimed = [F.col("doc_id"), F.lower("text")]
    found = merkle.manifest(table.repartition(3), "doc_id", "lang", ["doc_id", "text"], claimed)
    got = sorted(
        (str(x.id), x.leaf, x.subroot, x.root, x.proof, x.fold, x.own)
        for x in found.select(
            "*", merkle.path_digest(F.col("path")).alias("proof"), merkle.folded(F.col("claimed"), F.col("path")).alias("fold"),
            merkle.folded(F.col("leaf"), F.col("path")).alias("own"),
        ).collect()
    )
    groups = {}
    for doc_id, lang, text in rows:
        leaf = sha(encoded(doc_id) + encoded(text))
        lower = sha(encoded(doc_id) + encoded(text and text.lower()))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, lower, doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [slow_tree([x[2] for x in sorted(groups[g])]) for g in order]
    root, above = slow_tree([t[0] for t in trees]) if trees else (None, [])
    expected = []
    for g, (subroot, paths), top in zip(order, trees, above):
        for (_, _, leaf, lower, doc_id), path in zip(sorted(groups[g]), paths):
            fold, own = lower, leaf
            for a, b in path + top:
                fold, own = sha(a + fold + b), sha(a + own + b)
            assert own == root
            expected.append((str(doc_id), leaf, subroot, root, sha("".join(a + b for a, b in path + top)), fold, own))
    assert got == sorted(expected)


def test_ranks_of_one_large_group(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 7).alias("v"), F.col("id"))
    found = merkle.ranked(rows.repartition(6), ["v"], "test-ranks").collect()
    assert sorted(x.lo for x in found) == list(range(5000)) and {x.n for x in found} == {5000}
    assert [x.v for x in sorted(found, key=lambda x: x.lo)] == sorted(x.v for x in found)


# Prefix trie


def slow_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def slow_trie(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for prefix in members:
        for d in range(len(prefix) + 1):
            below.setdefault(prefix[:d], []).append(prefix)
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in members.items()}
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(children[q] == 0 for q in below[p]),
            sum(own[q] for q in below[p]), sha(",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))),
        )
        for p, m in members.items()
    )


def conversations(seed, n):
    r, rows = random.Random(seed), []
    pool = [(role, f"text {k} é") for k, role in enumerate(["user", "assistant", None, "", "system"])]
    common = [("user", "hello"), ("assistant", "hi there")]
    for c in range(n):
        kind = r.random()
        turns = common[: r.randint(0, 2)] + [r.choice(pool) for _ in range(r.randint(0, 5))]
        if kind < 0.3:
            turns = common + [pool[0]] * 4
        elif kind < 0.35:
            turns = common * 10 + [(None, None)] * r.randint(0, 40)
        conv = c * 3 if kind < 0.6 else c * 3 + 100 * r.randint(0, 3)
        rows += [(conv, None if r.random() < 0.05 else t, role, text) for t, (role, text) in enumerate(turns)]
    return rows + [(None, 1, "user", "of nobody")]


@pytest.mark.parametrize("group_turns, n", [(prefix_trie.GROUP_TURNS, 150), (40, 150), (3, 80), (40, 0)])
def test_trie(spark, monkeypatch, group_turns, n):
    monkeypatch.setattr(prefix_trie, "GROUP_TURNS", group_turns)
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 4 * group_turns)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations(n + group_turns, n)
    table = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, d string, n int")
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    found = prefix_trie.prefix_trie(prefix_trie.turn_sequences(table.repartition(4), conv - conv % 100, h))
    rank = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x) for x in found.collect()), key=rank) == sorted(slow_trie(slow_rebuilt(rows)), key=rank)


def test_turns_as_they_are(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = prefix_trie.prefix_trie(prefix_trie.turn_sequences(table)).collect()
    assert sorted((x.conv_id, x.depth, x.n_convs, x.saved_tokens) for x in found) == [(1, 0, 2, 1), (1, 1, 2, 1), (1, 2, 1, 0)]


def test_double_array():
    r = random.Random(8)
    for n_turns in (1, 3, 50, 5000):
        own = [np.array([r.randint(1, n_turns) for _ in range(r.randint(0, 12))]) for _ in range(300)]
        base, check = prefix_trie.pack(own, n_turns)
        nodes = {(): 0}
        for turns in own:
            state, path = 0, ()
            for code in turns.tolist():
                slot = base[state] + code
                assert check[slot] == state
                state, path = slot, (*path, code)
                assert nodes.setdefault(path, state) == state
        assert len(set(nodes.values())) == len(nodes) == (check >= 0).sum()


def test_crc_in_sql():
    import duckdb

    for text in ("0", "7", "-12", "123456789"):
        assert duckdb.sql(f"SELECT {queries.crc32_sql(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())
    assert re.fullmatch(r"[0-9a-f]{32}", prefix_trie.ROOT)
