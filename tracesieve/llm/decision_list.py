"""Quality rules as a learned decision list.

Sequential covering: while bad examples are left, a conjunction of thresholds is grown on two
thirds of them by information gain, pruned on the other third, and kept if it is right often enough
there; what it covers is set aside and the next rule is learned. The result is an ordered list of
conjunctions, emitted as one Spark conditional expression that any statistics can be judged by.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id; this is
its only bound. It is applied to every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.text_stats import BASE, statistics_column

FIT_ROWS = 20_000
MAX_RULES = 16
MAX_TERMS = 4
# A rule must be right on so large a share of the examples held out from growing it, and cover so
# many bad ones: rejecting a good document costs more than keeping a bad one.
PRECISION = 0.97
LEAST_COVERED = 5
CUTS = 64

# Fixed values of the contract.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What thresholds are put on, over the columns of ``text_statistics``."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_word_share": _ratio("n_repeat_words", "n_words"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "ends_per_word": _ratio("n_ends", "n_words"),
        "distinct_word_share": _ratio("n_distinct_words", "n_words"),
        "short_word_share": _ratio("n_short_words", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def expression(self, prefix: str) -> Column:
        value = F.col(prefix + self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Term, ...]


def covers(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(and_, (t.holds(columns) for t in rule), np.ones(n, bool))


def _candidates(values: np.ndarray) -> np.ndarray:
    """Thresholds between neighbouring values, at most ``CUTS`` evenly by rank."""
    distinct = np.unique(values)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= CUTS:
        return middle
    return middle[np.linspace(0, len(middle) - 1, CUTS).astype(int)]


def _grow(columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the term with the largest information gain until no good example is covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        base = np.log2(p / (p + n))
        best, best_gain = None, 1e-9
        for name in sorted(columns):
            values = columns[name][inside]
            is_bad = bad[inside]
            for cut in _candidates(values[is_bad]) if is_bad.sum() > 1 else []:
                over = values > cut
                for above, mask in ((True, over), (False, ~over)):
                    p2, n2 = (mask & is_bad).sum(), (mask & ~is_bad).sum()
                    if p2 == 0:
                        continue
                    gain = p2 * (np.log2(p2 / (p2 + n2)) - base)
                    if gain > best_gain:
                        best, best_gain = Term(name, above, float(cut)), gain
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(columns)
    return rule


def _prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on examples it was not grown on."""

    def worth(candidate: Rule) -> float:
        inside = covers(candidate, columns, len(bad))
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n * PRECISION / (1 - PRECISION)) / max(1, bad.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(columns: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules that recognise bad examples. Ties go to the first name and the lowest
    threshold, so equal input gives equal rules. Without bad or without good examples: no rules."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    if bad.all() or not bad.any():
        return rules
    while len(rules) < MAX_RULES and bad[left].sum() >= LEAST_COVERED:
        held_out = np.zeros(len(left), bool)
        for group in (bad[left], ~bad[left]):
            held_out[np.flatnonzero(group)[2::3]] = True
        grow_at, prune_at = left[~held_out], left[held_out]
        take = lambda at: {k: v[at] for k, v in columns.items()}
        if not bad[grow_at].any():
            break
        rule = _grow(take(grow_at), bad[grow_at])
        if not rule:
            break
        rule = _prune(rule, take(prune_at), bad[prune_at])
        inside = covers(rule, take(left), len(left))
        tested = covers(rule, take(prune_at), len(prune_at))
        hit, missed = (tested & bad[prune_at]).sum(), (tested & ~bad[prune_at]).sum()
        right = (inside & bad[left]).sum()
        if right < LEAST_COVERED or hit < PRECISION * (hit + missed) or right < PRECISION * inside.sum():
            break
        rules.append(rule)
        left = left[~inside]
    return rules


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, from 1, or 0: an ordered conditional expression over
    the columns named by ``features``, with ``prefix`` before their names."""
    result = None
    for number, rule in enumerate(rules, 1):
        condition = reduce(and_, (t.expression(prefix) for t in rule))
        result = F.when(condition, number) if result is None else result.when(condition, number)
    return F.lit(0) if result is None else result.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> list[Rule]:
    """Rules learned from up to ``rows`` labelled documents (quality 0: bad, 1: good; null: unused).

    An id that is labelled twice counts as bad if any label says so; of rows that repeat a labelled id,
    one is used. Only numbers of the chosen rows reach the driver: eleven a row, ``rows`` rows."""
    label = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .select(F.col("doc_id").alias("labelled"), "quality")
    )
    chosen = label.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    fitting = docs.join(F.broadcast(chosen), docs[id_col] == F.col("labelled")).select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), "quality"
    )
    measured = fitting.select("doc_id", "quality", statistics_column(F.col("text")).alias("stats"))
    names = features()
    measured = measured.select("doc_id", "quality", "stats.*")
    measured = measured.select("doc_id", "quality", *[c.alias(n) for n, c in names.items()])
    # However often an id repeats, one row of it leaves the task.
    found = measured.groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("least")).select("doc_id", "quality", "least.*").toPandas()
    found = found.sort_values(["doc_id", *names]).reset_index(drop=True)
    columns = {n: found[n].to_numpy(np.float64) for n in names}
    # A fixed shuffle, so that neither part of the examples follows the order of ids.
    order = np.random.default_rng(0).permutation(len(found))
    return learn({n: v[order] for n, v in columns.items()}, (found["quality"].to_numpy() == 0)[order])


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base statistics, base_failed, rule, kept), one row per row of ``docs``.

    rule is the number of the first rule that holds, 0 for none; kept means that neither the base
    rules nor a learned one reject the text. Null and empty texts have no words and fail. Extra
    columns are not looked at."""
    measured = docs.select(docs[id_col].alias("doc_id"), statistics_column(docs[text_col]).alias("stats"))
    judged = measured.select("doc_id", "stats.*").withColumn("base_failed", base_failed())
    judged = judged.withColumns({f"feature_{name}": column for name, column in features().items()})
    return judged.withColumn("rule", expression(rules, "feature_")).select(
        "doc_id", *BASE, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules learned from ``labels`` reject; all columns stay.

    Statistics are made where the row is: nothing is shuffled. Extra columns may have any name."""
    rules = fit(docs, labels, id_col, text_col)
    carried = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    measured = docs.select(carried, statistics_column(docs[text_col]).alias("stats")).select("row", "stats.*")
    named = measured.withColumns({f"feature_{name}": column for name, column in features().items()})
    return named.where(~base_failed() & (expression(rules, "feature_") == 0)).select("row.*")
