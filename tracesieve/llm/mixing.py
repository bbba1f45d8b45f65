"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and by the top bits of a hash of the id. Along those buckets the sums
show where a source's budget ends: all buckets before are taken whole, and only the bucket on the
boundary is split again by the next bits. A threshold per source then filters the documents; they
are never sorted. Thresholds are nested: a smaller budget takes a subset of a larger one's
documents, and reruns agree, as the hash depends on the id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.llm.common import WORD, free_name, stored
from tracesieve.operators.joins import fits_broadcast

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Tasks that a source is dealt to where sources are too many to broadcast.
SALTS = 16
LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = LEVEL_BITS * LEVELS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(key: Column) -> Column:
    """36 bits of the id's MD5, as a number; a null id hashes like the text 'null'."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """A weight for each source by its rank, null last. Ranks are counted per range of names and
    shifted by the ranges before, so no task sees all names."""
    missing = F.col("source").isNull()
    ranged = stored(
        sources.repartitionByRange(missing, "source").withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("part").orderBy(missing, "source")
    rank = F.row_number().over(within) - 1 + F.col("shift")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    return ranged.join(F.broadcast(shifts), "part").select("source", "source_size", weight.alias("weight"))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    Targets share the total by weight. A source whose share exceeds ``max_repeats`` times its size
    gets that and no more; the rest is shared again among the others until none is above. Each
    round needs three sums; they reach the driver as one row."""
    ranked = stored(_ranked(sizes))
    cap = max_repeats * F.col("source_size")
    # Python's numbers come as 32 bits where they fit, and products with them would overflow.
    wide = "decimal(38,0)"
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, weights, capped = total, None, -1
    while True:
        # Capped: its share of what is left is above its cap. The level only rises, so does the set.
        full = F.lit(False)
        if weights is not None:
            full = F.col("weight") * F.lit(left).cast(wide) > cap * F.lit(weights).cast(wide)
        spent, open_weights, n = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(full.cast("int")), F.lit(0)),
        ).first()
        if n == capped:
            break
        capped, left, weights = n, total - spent, open_weights
        if not weights:
            return ranked.withColumn("target", cap.cast("double"))
    share = (F.col("weight") * F.lit(left).cast(wide)).cast("double") / F.lit(float(weights))
    return ranked.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash below it come nearest to the source's ``rest``.

    Documents of equal hash are taken together or not at all; at the finest level the group on the
    boundary is taken if that comes nearer to the budget."""
    found = budgets.select("source", F.col("rest"), F.lit(0).cast("bigint").alias("prefix"))
    along = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        rows = sized.select("source", "size", F.shiftright("hash", shift).alias("bucket"))
        if level:
            edge = found.select(
                "source", F.shiftleft("prefix", LEVEL_BITS).alias("from"), (F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("to")
            )
            same = rows["source"].eqNullSafe(edge["source"])
            inside = (F.col("bucket") >= F.col("from")) & (F.col("bucket") < F.col("to"))
            if fits_broadcast(edge):
                edge = F.broadcast(edge)
            else:
                # One row a source, and very many sources: a hot one is dealt to several tasks.
                rows = rows.withColumn("salt", F.pmod(F.col("bucket"), F.lit(SALTS)))
                edge = edge.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                same = rows["source"].eqNullSafe(edge["source"]) & (F.col("salt") == F.col("of_salt"))
            rows = rows.join(edge, same & inside).select(rows["source"], "size", "bucket")
        histogram = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        summed = histogram.select("source", "bucket", "size", F.sum("size").over(along).alias("upto"))
        budget = found.select(F.col("source").alias("of"), "rest", "prefix")
        joined = summed.join(budget, summed["source"].eqNullSafe(F.col("of")))
        within = F.col("upto") <= F.col("rest")
        step = joined.groupBy("source").agg(
            F.first("rest").alias("rest"),
            F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0)).alias("spent"),
            F.min(F.when(~within, F.col("bucket"))).alias("edge"),
            F.min(F.when(~within, F.col("upto"))).alias("over"),
            F.max("bucket").alias("last"),
        )
        if level < LEVELS - 1:
            # Without an edge everything fits: go on past the last bucket.
            found = stored(
                step.select(
                    "source",
                    (F.col("rest") - F.col("spent")).alias("rest"),
                    F.coalesce("edge", F.col("last") + 1).alias("prefix"),
                )
            )
        else:
            nearer = F.col("over") - F.col("rest") < F.col("rest") - F.col("spent")
            return step.select(
                "source",
                F.when(F.col("edge").isNull(), F.col("last") + 1)
                .when(nearer, F.col("edge") + 1)
                .otherwise(F.col("edge"))
                .alias("threshold"),
            )
    raise AssertionError


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    Every document is taken floor(target / source_size) times, and those below the source's hash
    threshold once more, never more than ``max_repeats`` times. Null texts have size 0, null
    sources are one source (the last), rows that share an id go together; a source without words
    has target 0. No rows give no rows."""
    sized = stored(
        docs.select(
            docs[id_col].alias("doc_id"),
            docs[source_col].alias("source"),
            word_count(docs[text_col].cast("string")).alias("size"),
            id_hash(docs[id_col]).alias("hash"),
        )
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = stored(
        source_targets(totals, max_repeats)
        .withColumn("whole", F.least(whole, F.lit(max_repeats)).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    limits = thresholds(sized, budgets).withColumnRenamed("source", "of")
    plan = stored(
        budgets.join(limits, budgets["source"].eqNullSafe(F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "whole", "threshold"
        )
    )
    more = (F.col("hash") < F.coalesce("threshold", F.lit(0))).cast("bigint")
    copies = F.least(F.col("whole") + more, F.lit(max_repeats))
    return sized.join(plan, sized["source"].eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, or up to three times.

    All columns stay; copies are equal rows. The decision joins on the id alone, which decides it."""
    taken = mix(docs, id_col, text_col, source_col)
    id_key, source_key, n, turn = (free_name(docs, x) for x in ("id_key", "source_key", "copies", "turn"))
    chosen = (
        taken.where(F.col("copies") > 0)
        .groupBy(F.xxhash64("doc_id").alias(id_key), F.xxhash64("source", "doc_id").alias(source_key))
        .agg(F.max("copies").alias(n))
    )
    keyed = docs.withColumns({id_key: F.xxhash64(id_col), source_key: F.xxhash64(source_col, id_col)})
    return (
        keyed.join(chosen, [id_key, source_key])
        .withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
        .drop(id_key, source_key, n, turn)
    )
