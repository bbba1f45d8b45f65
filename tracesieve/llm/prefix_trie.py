"""The prefix trie of conversations, built from double arrays.

A conversation is a sequence of turns; a turn is known by a digest of its role and text. Equal
sequences are counted first and go on as one. Sequences are then dealt to shards by a prefix: the
shortest one whose sequences fit a task (``GROUP_TURNS``), so a first turn that a third of all
conversations share is split at the second, and so on down to the whole sequence.

In a shard, turns become dense ids and the trie is packed into two arrays: the child of node ``s`` by
turn ``c`` is slot ``BASE[s] + c`` if ``CHECK`` of that slot is ``s``. Sequences then walk the arrays
and leave their counts. From the shard's prefix on, nodes belong to one shard and are finished there.
The nodes above are shared: shards send them with what hangs below, and they are merged by a key of
their path. Sums over the shared nodes' subtrees take a doubling of parent pointers, as many rounds
as the shared depth has binary digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tracesieve.llm.common import written
from tracesieve.operators.joins import sized_join

#: Turns of the distinct sequences that share a prefix, at most; longer prefixes are tried beyond it.
GROUP_TURNS = 4096
#: Turns in a shard, about.
SHARD_TURNS = 16384
#: Prefix lengths tried.
DEPTHS = [1, 2, 3, 4, 5, 6, 7, 8] + [int(8 * 1.5**k) for k in range(1, 38)]
#: Ids in a piece of a long list of members.
PIECE = 8192

TURNS = "array<struct<d:string,n:int>>"
ROOT = hashlib.md5(b"").hexdigest()

_NODES = pa.schema(
    [("upper", pa.bool_()), ("key", pa.string()), ("parent_key", pa.string())]
    + [
        (name, pa.int64())
        for name in "depth conv_id parent_conv_id n_convs n_children n_leaves saved n_chars end_conv end_n".split()
    ]
)


def turn_sequences(
    conversations: DataFrame, base: Column | None = None, taken: Column | None = None, keep: int = 5
) -> DataFrame:
    """(conv_id, turns): the digests and lengths of each conversation's turns, in order.

    Null turns come first, turns of equal number go by their digest; a null role or text is empty;
    rows without a conv_id belong to no conversation. With ``base`` and ``taken`` (columns over
    ``conv_id``) a conversation begins with the first ``taken`` (at most ``keep``) turns of
    conversation ``base`` in place of as many of its own. A conversation is one row of about 40 bytes
    a turn; no texts are gathered."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            conversations["turn"].alias("turn"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("d"),
            F.length(text).alias("n"),
        ).alias("t"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n")))
    if base is None:
        return rows.groupBy("conv_id").agg(ordered.alias("turns"))
    # Conversations of one base lie together, so that neither the grouping nor the join moves them again.
    dealt = rows.withColumn("base", base).repartition("base")
    own = dealt.groupBy("base", "conv_id").agg(ordered.alias("turns"))
    leads = own.where("conv_id = base").select("base", F.slice("turns", 1, keep).alias("lead"))
    both = own.join(leads, "base", "left").withColumn("h", taken)
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.array().cast(TURNS))
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(F.array().cast(TURNS))
    return both.select("conv_id", F.concat(lead, rest).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the ``turns`` of (conv_id, turns), the empty one included:

    conv_id (the smallest that starts with it) and depth name it; parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens (over its subtree), ends_sha256 (of the ids that end there).
    conv_id must be unique and not null. A conversation without turns ends at the root; no
    conversations, no nodes."""
    turns = written(
        sequences.select("conv_id", "turns", F.md5(_joined(F.col("turns")).cast("binary")).alias("seq")), "sequences"
    )
    distinct = written(
        turns.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")),
        "distinct-sequences",
    )
    nodes = written(_shards(distinct), "trie-nodes")
    upper = _merge_upper(nodes.where("upper"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "end_conv", "end_n"]
    owned = nodes.where("not upper")
    tops = owned.where("parent_key is not null").unionByName(upper.where("depth > 0"), allowMissingColumns=True)
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    tops = sized_join(tops, parents, ["parent_key"], "left", spread=["conv_id"]).withColumn("parent_conv_id", F.col("_parent"))
    root = upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    every = owned.where("parent_key is null").select(*columns)
    every = every.unionByName(tops.select(*columns)).unionByName(root.select(*columns))
    return _with_members(every, turns, distinct).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["d"]), "")


def _shards(distinct: DataFrame) -> DataFrame:
    """Nodes of the double arrays of all shards."""
    weight = (F.size("turns") + 1).cast("long")
    depths = F.filter(F.array(*[F.lit(d) for d in DEPTHS]), lambda d: d <= F.size("turns"))
    at = lambda d: F.md5(_joined(F.slice("turns", F.lit(1), d)).cast("binary"))
    # The last prefix to try is the whole sequence with its end, which no other sequence shares.
    whole = F.struct((F.size("turns") + 1).alias("p"), F.concat(F.lit("end"), F.col("seq")).alias("prefix"))
    tried = F.concat(F.transform(depths, lambda d: F.struct(d.alias("p"), at(d).alias("prefix"))), F.array(whole))
    prefixes = distinct.select("conv_id", weight.alias("w"), F.explode(tried).alias("t")).select("conv_id", "w", "t.*")
    prefixes = written(prefixes, "prefixes")
    heavy = prefixes.groupBy("prefix").agg(F.sum("w").alias("w")).where((F.col("w") > GROUP_TURNS) & ~F.col("prefix").startswith("end"))
    light = sized_join(prefixes, written(heavy.select("prefix"), "heavy-prefixes"), ["prefix"], "left_anti", spread=["conv_id"])
    cut = light.groupBy("conv_id").agg(F.min("p").alias("p"))
    total = distinct.agg(F.sum(weight)).first()[0] or 0
    shards = -(-total // SHARD_TURNS) or 1
    placed = distinct.join(cut, "conv_id")
    prefix = F.when(F.col("p") <= F.size("turns"), at(F.col("p"))).otherwise(F.concat(F.lit("end"), F.col("seq")))
    dealt = placed.select(
        F.pmod(F.xxhash64(prefix), F.lit(shards)).alias("shard"), "conv_id", "n", F.col("p").cast("long").alias("p"),
        F.transform("turns", lambda t: t["d"]).alias("digests"), F.transform("turns", lambda t: t["n"]).alias("sizes"),
    )
    return dealt.groupBy("shard").applyInArrow(shard_nodes, from_arrow_schema(_NODES))


def pack(sequences: list[np.ndarray], n_turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE, CHECK) of the trie of ``sequences`` over turn ids 1 to ``n_turns``. Node 0 is the root;
    CHECK of a free slot is -1. BASE may be negative, slots never are."""
    base, check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
    check[0] = 0
    low, high, depth = 1, 1, 0  # all slots below ``low`` are taken, none from ``high`` on
    lengths = np.array([len(s) for s in sequences], np.int64)
    states, going = np.zeros(len(sequences), np.int64), np.flatnonzero(lengths > 0)

    def room(size: int) -> None:
        nonlocal base, check
        if size > len(check):
            more = max(size, 2 * len(check)) - len(check)
            base, check = np.concatenate((base, np.zeros(more, np.int64))), np.concatenate((check, np.full(more, -1, np.int64)))

    while len(going):
        codes = np.array([sequences[k][depth] for k in going], np.int64)
        pairs, back = np.unique(states[going] * (n_turns + 1) + codes, return_inverse=True)
        parents, codes = pairs // (n_turns + 1), pairs % (n_turns + 1)
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        counts = np.diff(np.concatenate((first, [len(parents)])))
        slots = np.zeros(len(pairs), np.int64)
        for at, count in zip(first[counts > 1].tolist(), counts[counts > 1].tolist()):
            own = codes[at : at + count]
            spread = own - own[0]
            free = low + np.flatnonzero(check[low : low + 4096] < 0)[:64]
            fits = np.flatnonzero((check[(free[:, None] + spread) % len(check)] < 0).all(axis=1) & (free + spread[-1] < len(check)))
            if len(fits):
                start = int(free[fits[0]])
            else:
                start = high
                room(start + int(spread[-1]) + 1)
            high = max(high, start + int(spread[-1]) + 1)
            slots[at : at + count] = start + spread
            check[start + spread] = parents[at]
            base[parents[at]] = start - own[0]
        single = first[counts == 1]
        if len(single):
            free = low + np.flatnonzero(check[low:] < 0)[: len(single)]
            if len(free) < len(single):
                room(len(check) + len(single))
                free = low + np.flatnonzero(check[low:] < 0)[: len(single)]
            slots[single] = free
            check[free] = parents[single]
            base[parents[single]] = free - codes[single]
            high = max(high, int(free[-1]) + 1)
            low = int(free[-1]) + 1 if (check[low : free[-1]] >= 0).all() else low
        states[going] = slots[back]
        depth += 1
        going = going[lengths[going] > depth]
    return base, check


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one shard's sequences: those from the prefix depth ``p`` on whole, those above with
    what this shard hangs below them."""
    digests = table["digests"].combine_chunks()
    offsets = digests.offsets.to_numpy() - digests.offsets[0].as_py()
    words = digests.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    names = words.dictionary.to_pylist()
    chars = np.zeros(len(names) + 1, np.int64)
    chars[codes] = table["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sequences = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    conv, count, cut = (table[c].to_numpy() for c in ("conv_id", "n", "p"))
    base, check = pack(sequences, len(names))

    size = len(check)
    n_convs, first, depths, turn = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    end_conv, end_n, upper = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    lengths = np.diff(offsets)
    states, going, depth = np.zeros(len(sequences), np.int64), np.arange(len(sequences)), 0
    upper[0] = True
    while len(going):
        np.add.at(n_convs, states[going], count[going])
        np.minimum.at(first, states[going], conv[going])
        ended = going[lengths[going] == depth]
        end_conv[states[ended]], end_n[states[ended]] = conv[ended], count[ended]
        going = going[lengths[going] > depth]
        step = codes[offsets[going] + depth]
        slots = base[states[going]] + step
        if (check[slots] != states[going]).any():
            raise ValueError("double array lost a sequence")
        depth += 1
        states[going], depths[slots], turn[slots] = slots, depth, step
        upper[slots] = cut[going] > depth
    nodes = np.flatnonzero(n_convs)
    nodes = nodes[np.argsort(depths[nodes], kind="stable")]
    parents = check[nodes]
    below = nodes[1:]  # all but the root, which comes first
    own = below[~upper[below]]
    children = np.bincount(check[own], minlength=size)
    leaves = (~upper & (children == 0)).astype(np.int64)
    saved = np.where(upper, 0, (n_convs - 1) * chars[turn])
    edges = np.searchsorted(depths[own], np.arange(depth + 2))
    for d in reversed(range(depth + 1)):
        level = own[edges[d] : edges[d + 1]]
        np.add.at(leaves, check[level], leaves[level])
        np.add.at(saved, check[level], saved[level])
    keys = {0: ROOT}
    for node in nodes[upper[nodes]].tolist()[1:]:
        keys[node] = hashlib.md5((keys[int(check[node])] + names[turn[node] - 1]).encode()).hexdigest()
    shared, under = upper[nodes], upper[parents]
    under[0] = False  # the root has no parent
    ends = end_n[nodes] > 0
    columns = [
        pa.array(shared),
        pa.array([keys.get(k) for k in nodes.tolist()], pa.string()),
        pa.array([keys[p] if u else None for p, u in zip(parents.tolist(), under.tolist())], pa.string()),
        pa.array(depths[nodes]),
        pa.array(first[nodes]),
        pa.array(first[parents], mask=under | shared),
        *(pa.array(x[nodes]) for x in (n_convs, children, leaves, saved, chars[turn])),
        pa.array(end_conv[nodes], mask=~ends),
        pa.array(end_n[nodes]),
    ]
    return pa.Table.from_arrays(columns, schema=_NODES)


def _merge_upper(nodes: DataFrame) -> DataFrame:
    """Shared nodes of all shards with whole counts. They are merged by key, and subtree sums go up by
    pointers that double: after k rounds a node has all within 2^k levels below it."""
    merged = nodes.groupBy("key", "parent_key", "depth", "n_chars").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("end_conv").alias("end_conv"), F.max("end_n").alias("end_n"),
    )
    merged = written(merged, "upper-nodes")
    shared = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_shared"))
    nodes = sized_join(merged, shared, ["key"], "left", spread=["key"])
    nodes = nodes.withColumn("n_children", F.col("n_children") + F.coalesce("_shared", F.lit(0))).drop("_shared")
    nodes = nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("n_chars"))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("_up", F.col("parent_key"))
    deepest = merged.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        nodes = written(nodes, "upper-round")
        sums = nodes.where("_up is not null").groupBy(F.col("_up").alias("key")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved").alias("_s"))
        nodes = sized_join(nodes, sums, ["key"], "left", spread=["key"])
        nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("_l", F.lit(0))).drop("_l")
        nodes = nodes.withColumn("saved", F.col("saved") + F.coalesce("_s", F.lit(0))).drop("_s")
        further = nodes.select(F.col("key").alias("_up"), F.col("_up").alias("_next"))
        nodes = sized_join(nodes, further, ["_up"], "left", spread=["key"]).withColumn("_up", F.col("_next")).drop("_next")
    return written(nodes.drop("_up"), "upper-whole")


def _with_members(nodes: DataFrame, turns: DataFrame, distinct: DataFrame) -> DataFrame:
    """Add ``ends_sha256``. Most nodes end no conversation or one; ids of equal conversations are sorted
    over all tasks and hashed piece by piece."""
    alone = F.when(F.col("end_n") == 0, F.lit("")).otherwise(F.col("end_conv").cast("string"))
    plain = nodes.where("end_n <= 1").withColumn("ends_sha256", F.sha2(alone.cast("binary"), 256))
    repeated = distinct.where("n > 1").select("seq", F.col("conv_id").alias("end_conv"))
    members = sized_join(turns.select("seq", "conv_id"), repeated, ["seq"], "inner", spread=["conv_id"])
    ordered = members.select("end_conv", "conv_id").repartitionByRange("end_conv", "conv_id").sortWithinPartitions("end_conv", "conv_id")
    pieces = ordered.mapInArrow(_pieces, "end_conv long, first long, ids string")
    hashed = pieces.repartition("end_conv").sortWithinPartitions("end_conv", "first").mapInArrow(_hashes, "end_conv long, ends_sha256 string")
    return plain.unionByName(sized_join(nodes.where("end_n > 1"), written(hashed, "members"), ["end_conv"], "inner", spread=["conv_id"]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one conversation class, comma-joined, at most ``PIECE`` in a row."""
    for batch in batches:
        owners, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1]))).tolist() if len(owners) else []
        cuts = sorted({s for a, b in zip(starts, [*starts[1:], len(owners)]) for s in range(a, b, PIECE)})
        joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(owners)])]
        columns = [pa.array(owners[cuts], pa.int64()), pa.array(ids[cuts], pa.int64()), pa.array(joined, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["end_conv", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each class, read as a stream."""
    owner, state = None, None

    def out(owners: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(digests, pa.string())], ["end_conv", "ends_sha256"])

    for batch in batches:
        owners, digests = [], []
        for who, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if who == owner:
                state.update(b",")
            else:
                if state:
                    owners.append(owner)
                    digests.append(state.hexdigest())
                owner, state = who, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield out(owners, digests)
    if state:
        yield out([owner], [state.hexdigest()])
