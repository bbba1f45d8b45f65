"""A Merkle manifest of a dataset: a tree for each group, and one over the groups' roots.

Every node carries the interval ``[lo, hi)`` of leaf ranks that it covers. All nodes of a level lie
in buckets of ``FAN ** level`` ranks, so a node meets its ancestor by an equality of buckets, and the
ancestor is the one whose interval contains its own. Siblings are what is left of the parent's
interval once the node's own is taken out, so the path of a node needs no pointers.

Ranks come from one range-partitioned sort: no group, however large, is sorted or collected in one
task. A row of the tree holds the ``FAN`` children of one parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import written
from tracesieve.operators.joins import fits_broadcast, sized_join

#: Fixed value of the contract: children of a node.
FAN = 8
#: Rows that are alike in every sort key are dealt to so many ranges.
SALTS = 1 << 16
STEP = "struct<left:string,right:string>"


def encoded(value: Column) -> Column:
    """``-`` for null, else length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    return digest(*[encoded(v) for v in values])


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to over the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def path_digest(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def group_key(group: Column) -> Column:
    """A string that is never null and sorts as the groups do, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string")))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``lo``, the rank of each row in its group ``g`` by ``order`` (nulls first), and ``n``, the
    rows of its group.

    A range-partitioned sort numbers the rows of each range; the number of rows of a group in the
    ranges before is a sum over one row per range and group. Rows equal in all keys are interchangeable
    and are spread over ranges by a salt."""
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    sorted_rows = salted.repartitionByRange("g", *order, "_salt").sortWithinPartitions("g", *order)
    placed = written(sorted_rows.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = written(placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), f"{name}-ranges")
    # At most one row for each range and group; a group has as many as it has ranges.
    before = counts.alias("a").join(counts.groupBy("g").agg(F.sum("_rows").alias("n")), "g")
    upto = F.expr("sum(_rows) over (partition by g order by _part) - _rows")
    shifts = before.select("g", "_part", "_first", "n", upto.alias("_before"))
    joined = sized_join(placed, shifts, ["g", "_part"], "inner", spread=["_at"])
    return joined.withColumn("lo", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


@dataclass(frozen=True)
class Tree:
    """``runs[k]``: one row for each parent at level ``k + 1``, with its children at level ``k``.
    ``leaves`` has the leaves of groups with a single one, which have no parent."""

    leaves: DataFrame
    runs: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, n, digest): the root of each group."""
        found = self.leaves.where("n = 1").select("g", "n", "digest")
        for run in self.runs:
            found = found.unionByName(run.where("hi - lo = n").select("g", "n", "digest"))
        return found


def build(leaves: DataFrame, name: str, carried: list[str] = ()) -> Tree:
    """``leaves``: g, lo, n, digest and ``carried`` columns, which the lowest runs keep."""
    widest = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.withColumn("hi", F.col("lo") + 1)
    runs, span = [], 1
    while span < widest:
        columns = ["lo", "hi", "digest", *(carried if span == 1 else ())]
        open_nodes = nodes.where("hi - lo < n")  # its group has further nodes at this level
        parents = open_nodes.groupBy("g", F.expr(f"lo div {span * FAN}").alias("bucket")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(*columns))).alias("members")
        )
        whole = F.array_join(F.transform("members", lambda m: m["digest"]), "")
        run = parents.select(
            "g", "bucket", "n", "members",
            F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), digest(whole).alias("digest"),
        )
        runs.append(written(run, f"{name}-level"))
        nodes = runs[-1].select("g", "n", "lo", "hi", "digest")
        span *= FAN
    return Tree(leaves, runs)


def attach_paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """Leaves with ``path``, from their siblings up to those of ``tops`` (g, path and further columns,
    which every leaf gets)."""
    kept = [c for c in tops.columns if c not in ("g", "path")]
    small = fits_broadcast(tops)
    above = None
    for level in reversed(range(len(tree.runs))):
        span = FAN ** (level + 1)
        own = tree.runs[level].select("g", "n", "bucket", "lo", "hi", "members")
        # Groups whose root is a parent of this level start here with the path of their root.
        heads = own.where("hi - lo = n").select("g", "lo", "hi", F.expr(f"lo div {span}").alias("bucket"))
        starts = sized_join(heads, tops, ["g"], "inner", ["lo"], small)
        parents = starts if above is None else starts.unionByName(above.withColumn("bucket", F.expr(f"lo div {span}")).select(*starts.columns))
        parents = parents.select("g", "bucket", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "path", *kept)
        inside = own.join(parents, ["g", "bucket"]).where("_lo <= lo and hi <= _hi")
        members = inside.select("g", "n", "members", "path", *kept, F.explode("members").alias("m"))
        rest = lambda keep: F.array_join(F.transform(F.filter("members", keep), lambda s: s["digest"]), "")
        step = F.struct(
            rest(lambda s: s["hi"] <= F.col("m.lo")).alias("left"), rest(lambda s: s["lo"] >= F.col("m.hi")).alias("right")
        )
        above = members.select("g", "n", "m.*", F.concat(F.array(step.cast(STEP)), "path").alias("path"), *kept)
    single = sized_join(tree.leaves.where("n = 1").withColumn("hi", F.col("lo") + 1), tops, ["g"], "inner", ["g"], small)
    return single if above is None else single.unionByName(above.select(*single.columns))


def manifest(
    docs: DataFrame, id_col: str, group_col: str, columns: list[str], claimed: list[Column] | None = None
) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path) of every row: its digest over ``columns``, the roots of
    its group and of the dataset, and its siblings up to the latter.

    ``claimed`` are the values of ``columns`` as someone else holds them; their digest can be
    ``folded`` along the path. Leaves ascend by id, null first; rows of equal id by their digest, so
    equal rows are leaves of their own. A null group is a group, null values are told apart from empty
    ones. An empty table has no rows. Further columns are not read."""
    own = leaf_digest(*[docs[c] for c in columns])
    leaves = written(
        docs.select(
            docs[id_col].alias("id"), group_key(docs[group_col]).alias("g"), own.alias("digest"),
            (leaf_digest(*claimed) if claimed else F.lit(None).cast("string")).alias("claimed"),
        ),
        "leaves",
    )
    tree = build(ranked(leaves, ["id", "digest"], "ranked-leaves"), "merkle", ["id", "claimed"])
    heads = written(tree.tops(), "subroots")
    groups = heads.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    upper = build(ranked(groups, ["name"], "ranked-subroots"), "merkle-top", ["name"])
    root = upper.tops().select("g", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    tops = attach_paths(upper, root).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    found = attach_paths(tree, written(tops, "subroot-paths"))
    return found.select("id", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")
