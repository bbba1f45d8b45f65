"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesieve.llm import chat, decision_list, embeddings, fuzzy_lines, merkle, mixing, packing, page_text, prefix_trie, secret_lexer, simhash, substring, token_codec
from tracesieve.llm.common import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary; the files belong to the machine, not to this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint")
    sized = docs.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).cast("bigint"))
    kept = F.size(F.split("text", "\n", -1)).cast("bigint")
    return fuzzy_lines.dedup_lines(sized).select(
        "doc_id",
        "n_lines",
        F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(kept).cast("bigint").alias("n_kept_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_codec.encode_table(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return token_codec.token_digests(blocks)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_lexer.scan_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"] != "lexed")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    found = merkle.manifest(docs, "doc_id", "lang", columns, [*[F.col(c) for c in columns[:-1]], text])
    root = merkle.folded(F.col("claimed"), F.col("path"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        merkle.path_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")
    sequences = prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"), conv - conv % 100, h)
    return prefix_trie.prefix_trie(sequences)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_embedding_dedup, op3_mix_sources, op4_line_dedup, op5_quality_rules,
        op6_substring_dedup, op7_chat_format, op8_token_blocks, op9_secret_scan, op10_pack,
        op11_page_text, op12_merkle_manifest, op13_prefix_trie,
    )
}


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB SQL, bit by bit."""
    bit = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"lambda crc, b: list_reduce(range(8), {bit}, xor(crc, b))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, {byte}, 4294967295::BIGINT), 4294967295)"


_LEVELS = 8  # enough for 8^8 leaves in a group


def merkle_steps(prefix: str, levels: int) -> str:
    """CTEs ``{prefix}1`` and so on: nodes (g, i, digest) of the next level, passed on once a group has
    one; and the siblings of each node of a level, (g, i, l, r), in ``{prefix}s0`` and so on."""
    out = []
    for k in range(levels):
        out.append(f"""
        {prefix}n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM {prefix}{k}),
        {prefix}{k + 1} AS (
            SELECT g, i // 8 AS i, CASE WHEN any_value(many) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
            FROM {prefix}n{k} GROUP BY g, i // 8
        ),
        {prefix}s{k} AS (
            SELECT a.g, a.i,
                coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM {prefix}n{k} a JOIN {prefix}n{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.many > 1 GROUP BY a.g, a.i
        )""")
    return ",".join(out)


_VECTORS = """
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
"""

def _merkle_oracle() -> str:
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(enc, ("doc_id", "source", "lang", "n_chars")), enc(text)]) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    walk, at = [], "rows0"
    # Each step folds the claimed leaf over its siblings and collects them, first in its group's tree.
    for tree, key, node, levels in (("t", "g", "i", _LEVELS), ("u", "''", "u", 3)):
        for k in range(levels):
            walk.append(f"""
        {at}{tree}{k} AS (
            SELECT w.* REPLACE (
                CASE WHEN s.l IS NULL THEN fold ELSE sha256(s.l || fold || s.r) END AS fold,
                proof || coalesce(s.l || s.r, '') AS proof)
            FROM {at} w LEFT JOIN {tree}s{k} s ON s.g = w.{key} AND s.i = w.{node} // {8**k}
        )""".replace("w.''", "''"))
            at = f"{at}{tree}{k}"
    return f"""
        WITH leaves AS (
            SELECT doc_id, lang, coalesce('+' || lang, '') AS g, {leaf("text")} AS leaf,
                CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
                    THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf("text")} END AS claimed
            FROM documents
        ),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
        t0 AS (SELECT g, i, leaf AS digest FROM placed),
        {merkle_steps("t", _LEVELS)},
        heads AS (SELECT g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS u FROM t{_LEVELS}),
        u0 AS (SELECT '' AS g, u AS i, digest FROM heads),
        {merkle_steps("u", 3)},
        rows0 AS (
            SELECT p.doc_id, p.g, p.i, h.u, p.leaf, h.digest AS subroot, (SELECT digest FROM u3) AS root, p.claimed AS fold, '' AS proof
            FROM placed p JOIN heads h ON h.name = p.g
        ),
        {",".join(walk)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM {at}
    """


ORACLES: dict[str, str] = {
    "op12_merkle_manifest": _merkle_oracle(),
    "op13_prefix_trie": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ),
        own AS (
            SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h,
                list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS ts
            FROM turns GROUP BY conv_id
        ),
        rebuilt AS (
            SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
        ),
        starts AS (SELECT conv_id, len(ts) AS length, ts, unnest(range(len(ts) + 1)) AS d FROM rebuilt),
        nodes AS (
            SELECT ts[1:d] AS prefix, d, min(conv_id) AS conv_id, count(*) AS n,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '') AS ends
            FROM starts GROUP BY ts[1:d], d
        ),
        edges AS (
            SELECT c.prefix, c.d, p.conv_id AS parent, p.prefix AS parent_prefix
            FROM nodes c JOIN nodes p ON c.d = p.d + 1 AND c.prefix[1:p.d] = p.prefix
        ),
        children AS (SELECT parent_prefix AS prefix, count(*) AS n_children FROM edges GROUP BY parent_prefix),
        full_nodes AS (
            SELECT n.*, e.parent, coalesce(c.n_children, 0) AS n_children,
                (n.n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE length(n.prefix[n.d].text) END AS saved
            FROM nodes n LEFT JOIN edges e ON e.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix
        ),
        trees AS (
            SELECT a.prefix, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
            FROM nodes a JOIN full_nodes b ON b.d >= a.d AND b.prefix[1:a.d] = a.prefix GROUP BY a.prefix
        )
        SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, t.n_leaves, t.saved_tokens,
            sha256(f.ends) AS ends_sha256
        FROM full_nodes f JOIN trees t ON t.prefix = f.prefix
    """,
    "op2_embedding_dedup": f"""
        WITH RECURSIVE good AS ({_VECTORS}),
        link AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ),
        reach(node, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.node, l.v FROM reach r JOIN link l ON l.u = r.other
        ),
        least_id AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        degree AS (SELECT u, count(*) AS n FROM link GROUP BY u)
        SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN least_id c ON c.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
    """,
    "op3_mix_sources": rf"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS h
            FROM documents
        ),
        totals AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sized GROUP BY source
        ),
        -- Sources by cap for each unit of weight. The first so many are held at three times their size.
        ordered AS (
            SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS r FROM totals
        ),
        levels AS (
            SELECT r, source_size, weight,
                (SELECT sum(source_size) FROM totals)
                    - coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
                sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
            FROM ordered
        ),
        first_open AS (
            SELECT rem, open_weight, r FROM levels
            WHERE NOT (weight * rem > 3 * source_size * open_weight) ORDER BY r LIMIT 1
        ),
        targets AS (
            SELECT o.source, o.source_size,
                CASE WHEN f.r IS NULL OR o.r < f.r THEN (3 * o.source_size)::DOUBLE
                     ELSE (o.weight * f.rem)::DOUBLE / f.open_weight::DOUBLE END AS target
            FROM ordered o LEFT JOIN first_open f ON true
        ),
        budgets AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets
        ),
        groups AS (
            SELECT s.source, s.h, sum(s.size) AS size FROM sized s GROUP BY s.source, s.h
        ),
        along AS (
            SELECT g.source, g.h, b.target - b.whole * b.source_size AS rest,
                sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto,
                sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) - g.size AS before
            FROM groups g JOIN budgets b ON g.source IS NOT DISTINCT FROM b.source
        ),
        chosen AS (
            SELECT source, h FROM along WHERE upto <= rest OR (before <= rest AND upto - rest < rest - before)
        )
        SELECT s.doc_id, s.size, b.source_size, b.target,
            least(b.whole + CASE WHEN c.h IS NULL THEN 0 ELSE 1 END, 3) * s.size AS taken
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
        LEFT JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h
    """,
    "op6_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        windows AS (
            SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
        ),
        repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
        covered AS (
            SELECT doc_id, list(DISTINCT i) AS gone
            FROM (SELECT doc_id, unnest(range(p, p + 35)) AS i FROM repeated) GROUP BY doc_id
        ),
        kept AS (
            SELECT d.doc_id, d.w, coalesce(len(c.gone), 0) AS n_removed,
                CASE WHEN c.gone IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(c.gone, i)) END AS stay
            FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(stay, ' '), '')) AS kept_sha256
        FROM kept
    """,
}
