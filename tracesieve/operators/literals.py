"""Literal secrets: parsing, counting and exact replacement.

Secrets are replaced where they stand in the given text, the longest first, each from left to right.
What was replaced is done with: no secret is looked for in a placeholder.

Secrets always travel as DataFrame rows. As ``lit()`` constants they would show up in
``explain`` output, the event log and the UI.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesieve.functions.detectors import DETECTORS
from tracesieve.functions.slices import sliced, sliced_pairs
from tracesieve.functions.text import let, once, placeholder, trimmed
from tracesieve.operators import automaton
from tracesieve.operators.automaton import Automaton
from tracesieve.operators.joins import cut_lineage, fits_broadcast, measure
from tracesieve.operators.literal_search import literal_candidates
from tracesieve.operators.redaction import findings_from_hits, scan_text

# The functions below travel to the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRESENT_TYPE = "array<struct<value:string,replacement:string>>"
REDACTED_TYPE = "struct<text:string,found:array<struct<replacement:string,count:bigint>>>"
LITERAL_FINDING = "array<struct<replacement:string,count:bigint>>"

# Up to this many secrets every text is tried against each of them in the JVM.
INLINE_SECRETS = 16
# Up to this many, and this many bytes, the secrets are sent to the executors.
# An automaton takes about 25 bytes for each byte of the secrets.
SHARED_SECRETS = 200_000
SHARED_BYTES = 8 * 1024 * 1024

# Fixed value: the form of an assignment.
_ASSIGNMENT = r"""(?:export\s+)?\w+=["']?(.+?)["']?\s*$"""


def secret_value(line: Column) -> Column:
    """The secret in ``[export ]KEY=["']VALUE["']`` or in a plain line; null when unusable."""
    assigned = F.regexp_extract(line, _ASSIGNMENT, 1)
    return F.when(F.length(assigned) > 2, assigned).when(
        ~line.contains("=") & (F.length(line) > 3), line
    )


def parse_secrets(
    lines: DataFrame, line: str = "line", order: str = "line_no", salt: str = ""
) -> DataFrame:
    """Secrets of env-file or plain lines: ``name, value, replacement``, one row per value.

    The first line with a value names it. Values that are part of a placeholder or of a
    detector name are refused (:func:`ignored_lines` lists them): replacing them would
    rewrite placeholders themselves.
    """
    found = _usable(lines, line).where("usable")
    first = found.groupBy("value").agg(F.min_by("_line", F.col(order)).alias("_line"))
    return first.select(
        F.left("_line", F.lit(50)).alias("name"),
        "value",
        placeholder(F.col("value"), salt).alias("replacement"),
    )


def ignored_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Non-blank lines that yield no secret; the reference drops them without a word."""
    return _usable(lines, line).where("not usable").select(*lines.columns)


def _usable(lines: DataFrame, line: str) -> DataFrame:
    df = lines.withColumn("_line", trimmed(F.col(line))).where("_line <> ''")
    df = df.withColumn("value", secret_value(F.col("_line")))
    return df.withColumn(
        "usable", F.col("value").isNotNull() & ~inside_placeholder(F.col("value"))
    )


def inside_placeholder(value: Column) -> Column:
    """True for values such as ``RED`` that occur in the placeholders themselves."""
    words = " ".join(dict.fromkeys(d.replacement for d in DETECTORS))
    return F.lit(words).contains(value)


def secrets_count(secrets: DataFrame) -> DataFrame:
    return secrets.agg(F.countDistinct("value").alias("secrets_count"))


def longest_first(secrets: Column) -> Column:
    """Array of secrets, longest value first, so that no secret is broken by a part of it."""
    keyed = F.transform(
        secrets,
        lambda s: F.struct(
            (-F.length(s["value"])).alias("n"),
            s["value"].alias("value"),
            s["replacement"].alias("replacement"),
        ),
    )
    return F.transform(
        F.sort_array(keyed),
        lambda s: F.struct(s["value"].alias("value"), s["replacement"].alias("replacement")),
    )


def as_array(secrets: DataFrame) -> Column:
    """All secrets as one scalar array. Only for secrets whose number was checked."""
    one = secrets.agg(
        longest_first(F.collect_list(F.struct("value", "replacement"))).alias("secrets")
    )
    return one.scalar()


def present(text: Column, secrets: Column) -> Column:
    """The secrets of an array that occur in ``text``, in the same order."""
    return F.filter(secrets, lambda s: text.contains(s["value"]))


def replace_literals(text: Column, secrets: Column) -> Column:
    """``struct<text, found>``: the secrets of an array replaced by place, in array order. For few secrets,
    all of which should occur: each cuts what is left of the text into pieces."""
    piece = "struct<raw:string,secret:int>"
    numbered = F.transform(secrets, lambda s, k: F.struct(s["value"].alias("value"), k.alias("k")))

    def cut(piece_: Column, s: Column) -> Column:
        quoted = F.concat(F.lit(r"\Q"), F.replace(s["value"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        gaps = F.split(piece_["raw"], quoted, -1)
        mark = F.struct(F.lit("").alias("raw"), s["k"].alias("secret")).cast(piece)
        raws = F.transform(gaps, lambda g: F.array(mark, F.struct(g.alias("raw"), F.lit(-1).alias("secret")).cast(piece)))
        whole = let(raws, lambda r: F.flatten(r))
        return F.slice(whole, F.lit(2), F.size(whole))

    def step(pieces: Column, s: Column) -> Column:
        hit = lambda p: (p["secret"] < 0) & p["raw"].contains(s["value"])
        cut_all = F.flatten(F.transform(pieces, lambda p: F.when(hit(p), cut(p, s)).otherwise(F.array(p))))
        return F.when(F.exists(pieces, hit), cut_all).otherwise(pieces)

    def result(pieces: Column) -> Column:
        shown = F.transform(
            pieces, lambda p: F.when(p["secret"] < 0, p["raw"]).otherwise(F.element_at(secrets, F.greatest(p["secret"], F.lit(0)) + 1)["replacement"])
        )
        counts = F.transform(
            secrets,
            lambda s, k: F.struct(
                s["replacement"].alias("replacement"), F.size(F.filter(pieces, lambda p: p["secret"] == k)).cast("bigint").alias("count")
            ),
        )
        return F.struct(F.array_join(shown, "").alias("text"), F.filter(counts, lambda c: c["count"] > 0).alias("found"))

    nothing = F.struct(text.alias("text"), F.array().cast(LITERAL_FINDING).alias("found"))
    start = F.array(F.struct(text.alias("raw"), F.lit(-1).alias("secret")).cast(piece))
    done = let(F.aggregate(numbered, start, step), result)
    return F.when((F.size(secrets) > 0) & text.isNotNull(), done).otherwise(nothing)


def shared_automaton(secrets: DataFrame):
    """The secrets, longest first, and their automaton on all executors. They must have been measured."""
    rows = [(r["value"], r["replacement"]) for r in secrets.select("value", "replacement").collect()]
    rows.sort(key=lambda r: (-len(r[0]), r[0]))
    values, replacements = [v for v, _ in rows], [r for _, r in rows]
    arrays = vars(Automaton([v.encode("utf-8") for v in values]))
    return secrets.sparkSession.sparkContext.broadcast((arrays, values, replacements))


def automaton_of(arrays: dict) -> Automaton:
    own = Automaton.__new__(Automaton)
    own.__dict__.update(arrays)
    return own


def literal_findings(found: Column) -> Column:
    return F.transform(
        found,
        lambda f: F.struct(
            F.lit("literal-secret").alias("detector"),
            F.lit("critical").alias("severity"),
            f["replacement"].alias("replacement"),
            f["count"].alias("count"),
        ),
    )


def _form(secrets: DataFrame, inline: int, shared: int) -> str:
    """How many secrets there are decides how they are looked for; the result is the same."""
    rows, size = measure(secrets.select("value"))
    if size > SHARED_BYTES or rows > max(inline, shared):
        return "joined"
    return "inline" if rows <= inline else "shared"


def attach_present(
    df: DataFrame,
    text: str,
    secrets: DataFrame,
    keys: Sequence[str],
    out: str = "_present",
    inline: int = INLINE_SECRETS,
    shared: int = SHARED_SECRETS,
) -> DataFrame:
    """Add the array of secrets that occur in each text, longest first.

    By the measured number of secrets: a few ride along as one scalar array; more are sent
    to the executors as an automaton; any number beyond that is joined by hash, for which
    ``keys`` must identify the rows of ``df``. The result is the same.
    """
    secrets = secrets.select("value", "replacement")
    form = _form(secrets, inline, shared)
    if form == "inline":
        held = df.withColumn("_all", as_array(secrets))
        return held.withColumn(out, present(F.col(text), F.col("_all"))).drop("_all")
    if form == "shared":
        held = shared_automaton(secrets)

        def search(texts: pa.Array) -> pa.Array:
            arrays, values, replacements = held.value
            return automaton.present(texts, automaton_of(arrays), values, replacements)

        return df.withColumn(out, sliced(search, PRESENT_TYPE)(F.col(text)))
    candidates = literal_candidates(df, text, secrets, list(keys), "_candidates")
    if fits_broadcast(candidates):
        candidates = F.broadcast(candidates)
    joined = df.join(candidates, list(keys), "left")
    ordered = longest_first(F.coalesce(F.col("_candidates"), F.array().cast(PRESENT_TYPE)))
    return joined.withColumn(out, present(F.col(text), ordered)).drop("_candidates")


def redact_literals(
    df: DataFrame,
    secrets: DataFrame,
    text: str = "text",
    out: str = "redacted",
    findings: str = "findings",
    keys: Sequence[str] = ("source_dir", "filename"),
    **bounds: int,
) -> DataFrame:
    """Replace literal secrets in ``text``; findings are ``literal-secret``, critical, longest first.

    Up to the shared bound a text is read once, by the automaton. ``bounds`` are those of
    :func:`attach_present`.
    """
    kept = [c for c in df.columns if c not in (out, findings)]
    secrets = secrets.select("value", "replacement")
    inline, shared = bounds.get("inline", INLINE_SECRETS), bounds.get("shared", SHARED_SECRETS)
    if _form(secrets, inline, shared) == "shared":
        held = shared_automaton(secrets)

        def replace(texts: pa.Array) -> pa.Array:
            arrays, _, replacements = held.value
            return automaton.redact(texts, automaton_of(arrays), replacements)

        done = sliced(replace, REDACTED_TYPE)(F.col(text))
        found = df
    else:
        found = attach_present(df, text, secrets, keys, **bounds)
        done = replace_literals(F.col(text), F.col("_present"))
    return found.select(*kept, once(done).alias("_f")).select(
        *kept, F.col("_f.text").alias(out), literal_findings(F.col("_f.found")).alias(findings)
    )


def redact_text(
    df: DataFrame,
    secrets: DataFrame,
    text: str = "text",
    out: str = "redacted",
    findings: str = "findings",
    keys: Sequence[str] = ("source_dir", "filename"),
    **bounds: int,
) -> DataFrame:
    """Literal secrets first, then the detectors on what is left."""
    kept = [c for c in df.columns if c not in (out, findings)]
    lit = redact_literals(df, secrets, text, "_lit", "_lit_findings", keys, **bounds)
    done = lit.select("*", once(scan_text(F.col("_lit"))).alias("_scan"))
    both = F.concat(F.col("_lit_findings"), findings_from_hits(F.col("_scan.hits")))
    return done.select(*kept, F.col("_scan.text").alias(out), both.alias(findings))


def redact_own(texts: pa.Array, secrets: pa.Array) -> pa.Array:
    """``struct<text, found>`` of each text with its own array of secrets."""
    rows = []
    for text, own in zip(texts.to_pylist(), secrets.to_pylist()):
        own = sorted(own or [], key=lambda s: (-len(s["value"]), s["value"]))
        if text is None or not own:
            rows.append({"text": text, "found": []})
        else:
            machine = automaton.Automaton([s["value"].encode("utf-8") for s in own])
            done = automaton.redact(pa.array([text], pa.string()), machine, [s["replacement"] for s in own])
            rows.append(done[0].as_py())
    return pa.array(rows, automaton.REDACTED)


def re_redact(
    sessions: DataFrame,
    raw_findings: DataFrame,
    text: str = "content",
    keys: Sequence[str] = ("source_dir", "filename"),
    salt: str = "",
) -> DataFrame:
    """Redact, in each session, the raw secrets a scanner reported for that session.

    ``raw_findings`` has the session keys and ``raw``. Each session needs only its own
    secrets, so this is one equi-join, however many a session has; it gets them as an array and
    replaces them in one reading. Raw values stay inside the job; the result holds the text and
    counts.
    """
    keys = list(keys)
    secrets = (
        raw_findings.where("length(raw) > 2")
        .where(~inside_placeholder(F.col("raw")))
        .select(*keys, F.col("raw").alias("value"))
        .distinct()
    )
    entry = F.struct("value", placeholder(F.col("value"), salt).alias("replacement"))
    arrays = cut_lineage(secrets.groupBy(*keys).agg(F.collect_list(entry).alias("_secrets")))
    if fits_broadcast(arrays):
        arrays = F.broadcast(arrays)
    replace = sliced_pairs(redact_own, REDACTED_TYPE)
    done = sessions.join(arrays, keys, "left").select(*sessions.columns, once(replace(F.col(text), F.col("_secrets"))).alias("_f"))
    return done.select(
        *sessions.columns,
        F.col("_f.text").alias("redacted"),
        F.size("_f.found").cast("bigint").alias("secrets_found"),
        F.aggregate("_f.found", F.lit(0).cast("bigint"), lambda a, f: a + f["count"]).alias("match_count"),
    )
