"""Findings of a secret scanner: parsing, masking, deduplication and per-file summaries.

One file may hold a large share of all findings. Nothing here gathers the findings of a file
in one row or one task: summaries combine before they shuffle, top-k windows cut their input
before they shuffle, and joins by file go by measured size or are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.functions.detectors import any_may_match, detector_info
from tracesieve.functions.text import (
    basename,
    mask_secret,
    normalize_path,
    once,
    trimmed,
    unicode_order,
)
from tracesieve.operators.joins import shuffled, sized_join
from tracesieve.operators.manifest import add_rejected
from tracesieve.operators.redaction import scan_text

# Fixed values.
BLOCKING_REASON = "trufflehog-findings"
TOP_DETECTORS = 8
EXAMPLES = 5

_LAST_LINE = 2**63 - 1


def strict_json(text: Column) -> Column:
    """``VARIANT`` of a text that is exactly one JSON value, else null.

    ``try_parse_json`` alone returns the first value and ignores what follows. Text that
    closes the brackets of one wrapper early cannot fit the other.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"z":0}')))
    alone = in_object.isNotNull() & F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(in_array, "$[0]", "variant"))


def _typed(doc: Column, path: str, kind: str, to: str) -> Column:
    """Field of exactly that JSON type; others count as absent instead of being converted."""
    field = F.try_variant_get(doc, path, "variant")
    is_kind = F.schema_of_variant(field).rlike(f"^({kind})")
    return F.when(is_kind, F.try_variant_get(doc, path, to))


_FIELDS = """DetectorName VARIANT, DecoderName VARIANT, Verified VARIANT, Raw VARIANT,
    ExtraData STRUCT<verification_error: VARIANT, verificationError: VARIANT, error: VARIANT>,
    SourceMetadata STRUCT<Data: STRUCT<Filesystem: STRUCT<file: VARIANT, line: VARIANT>>>"""
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _finding_fields(line: Column) -> Column:
    """The fields of a line that is exactly one JSON object, else null. Of a key that repeats, the last
    value counts.

    Text that closes the brackets of one wrapper early cannot fit the other.
    """
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"ARRAY<STRUCT<{_FIELDS}>>", _STRICT)
    closed = F.from_json(F.concat(F.lit('{"v":'), line, F.lit(',"z":0}')), "z INT", _STRICT)["z"] == 0
    return F.when(closed & (F.size(listed) == 1), listed[0])


def parse_findings(lines: DataFrame, line: str = "value") -> DataFrame:
    """Scanner output lines to findings.

    Lines that do not start with ``{``, are not JSON, or lack a string ``DetectorName`` are
    skipped. Adds ``raw`` so that :func:`~tracesieve.operators.literals.re_redact` can use
    it; drop it before writing.
    """
    docs = lines.select(trimmed(F.col(line)).alias("_line")).where(F.col("_line").startswith("{"))
    doc = docs.select(once(_finding_fields(F.col("_line"))).alias("_doc"))
    d, place = F.col("_doc"), F.col("_doc.SourceMetadata.Data.Filesystem")
    text = "STRING"
    fields = doc.select(
        _typed(d["DetectorName"], "$", text, "string").alias("detector"),
        _typed(d["DecoderName"], "$", text, "string").alias("decoder"),
        _typed(d["Verified"], "$", "BOOLEAN", "boolean").alias("verified"),
        _typed(d["Raw"], "$", text, "string").alias("raw"),
        *[
            _typed(d["ExtraData"][name], "$", text, "string").alias(f"_{name}")
            for name in ("verification_error", "verificationError", "error")
        ],
        _typed(place["file"], "$", text, "string").alias("file"),
        _typed(place["line"], "$", "BIGINT|DECIMAL|DOUBLE|FLOAT", "bigint").alias("line"),
    ).where("detector is not null")
    return with_derived(fields)


def with_derived(fields: DataFrame) -> DataFrame:
    """Status, hash and mask from the raw fields of a finding."""
    errors = [F.col(c) for c in ("_verification_error", "_verificationError", "_error")]
    return fields.select(
        "detector",
        "decoder",
        finding_status(F.col("verified"), *errors).alias("status"),
        "line",
        raw_sha256(F.col("raw")).alias("raw_sha256"),
        mask_secret(F.col("raw")).alias("masked"),
        F.coalesce("file", F.lit("")).alias("file"),
        F.nullif("raw", F.lit("")).alias("raw"),
    )


def finding_status(verified: Column, *errors: Column) -> Column:
    """``verified``; else ``unknown`` when the first non-empty error is not blank; else
    ``unverified``. A blank first error hides the later ones."""
    error = F.coalesce(*[F.nullif(e, F.lit("")) for e in errors])
    return (
        F.when(verified, "verified").when(error.rlike(r"\S"), "unknown").otherwise("unverified")
    )


def raw_sha256(raw: Column) -> Column:
    return F.sha2(F.nullif(raw, F.lit("")), 256)


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One row per (file, detector, decoder, status, line, hash).

    The mask follows from the raw value behind the hash, so grouping by all columns changes
    nothing and keeps the aggregation on keys alone; copies combine before the shuffle.
    A missing decoder and an empty one are the same, and so are spellings of one path.
    """
    return findings.select(
        normalize_path(F.col("file")).alias("file"),
        "detector",
        F.coalesce("decoder", F.lit("")).alias("decoder"),
        "status",
        F.coalesce("line", F.lit(-1)).cast("bigint").alias("line"),
        F.coalesce("raw_sha256", F.lit("")).alias("raw_sha256"),
        "masked",
    ).distinct().select(
        "file",
        "detector",
        F.nullif("decoder", F.lit("")).alias("decoder"),
        "status",
        F.nullif("line", F.lit(-1).cast("bigint")).alias("line"),
        F.nullif("raw_sha256", F.lit("")).alias("raw_sha256"),
        "masked",
    )


def attach_source(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings whose path is one of the scanned files (column ``file``), whatever the
    spelling of the path."""
    at = findings.withColumn("file", normalize_path(F.col("file")))
    known = files.select(normalize_path(F.col("file")).alias("file")).distinct()
    kept = sized_join(at, known, ["file"], "left_semi", spread=["detector", "line", "raw_sha256"])
    return kept.select(*findings.columns)


def order_findings(findings: DataFrame) -> DataFrame:
    """By file, line (missing last), then detector in language order.

    A global sort splits a file with very many findings over several tasks.
    """
    return findings.orderBy(
        "file",
        F.coalesce("line", F.lit(_LAST_LINE)),
        unicode_order(F.col("detector")),
        *[c for c in ("status", "decoder", "raw_sha256") if c in findings.columns],
    )


def summarize_findings(findings: DataFrame) -> DataFrame:
    status = F.col("status")
    return findings.groupBy("file").agg(
        F.count("*").alias("findings"),
        F.count_if(status == "verified").alias("verified"),
        F.count_if(status == "unverified").alias("unverified"),
        F.count_if(status == "unknown").alias("unknown"),
    )


def top_detectors(findings: DataFrame, limit: int = TOP_DETECTORS) -> DataFrame:
    """Per file, its most frequent detectors: most findings first, then by name."""
    counts = findings.groupBy("file", "detector").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy(
        F.col("n").desc(), unicode_order(F.col("detector")), "detector"
    )
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    names = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "detector"))), lambda s: s["detector"]
    )
    return top.groupBy("file").agg(names.alias("top_detectors"))


def finding_examples(findings: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """Per file, ``detector:mask`` of its first findings in report order.

    Spark cuts every partition to the first ``limit`` rows per file before the shuffle.
    """
    order = Window.partitionBy("file").orderBy(
        F.coalesce("line", F.lit(_LAST_LINE)),
        unicode_order(F.col("detector")),
        "status",
        "masked",
        "raw_sha256",
    )
    first = findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    texts = F.transform(
        F.sort_array(
            F.collect_list(
                F.struct("rank", F.concat("detector", F.lit(":"), "masked").alias("text"))
            )
        ),
        lambda s: s["text"],
    )
    return first.groupBy("file").agg(texts.alias("examples"))


def file_summaries(findings: DataFrame, limit: int = TOP_DETECTORS) -> DataFrame:
    """:func:`summarize_findings` and :func:`top_detectors` from one aggregation by file and detector.

    A file has as many of its rows as the scanner has kinds of detectors, however many findings.
    """
    status = F.col("status")
    counts = findings.groupBy("file", "detector").agg(
        F.count("*").alias("findings"),
        *[F.count_if(status == s).alias(s) for s in ("verified", "unverified", "unknown")],
    )
    entry = F.struct((-F.col("findings")).alias("n"), unicode_order(F.col("detector")).alias("u"), "detector")
    return counts.groupBy("file").agg(
        *[F.sum(c).alias(c) for c in ("findings", "verified", "unverified", "unknown")],
        F.transform(F.slice(F.sort_array(F.collect_list(entry)), 1, limit), lambda s: s["detector"]).alias("top_detectors"),
    )


def scan_reports(files: DataFrame, findings: DataFrame, content: str = "content") -> DataFrame:
    """One row per scanned file, also without findings: hash, counts, detectors, examples.

    ``findings`` are deduplicated and attached, and read twice: store them first if they are costly.
    They stay in their own table; a report row is bounded whatever a file contains. Content is hashed
    before any join. Files meet their summaries by key, as there may be as many of these as files.
    """
    hashed = files.select("file", F.sha2(F.col(content), 256).alias("redacted_hash"))
    none = F.array().cast("array<string>")
    summaries, examples = shuffled(file_summaries(findings)), shuffled(finding_examples(findings))
    joined = hashed.join(summaries, ["file"], "left").join(examples, ["file"], "left")
    return joined.select(
        "file",
        "redacted_hash",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("findings", "verified", "unverified", "unknown")
        ],
        F.coalesce("top_detectors", none).alias("top_detectors"),
        F.coalesce("examples", none).alias("examples"),
    )


def scan_totals(reports: DataFrame) -> DataFrame:
    """One row, also for no files at all."""

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return reports.agg(
        total("findings").alias("total_findings"),
        total("verified").alias("verified_count"),
        total("unverified").alias("unverified_count"),
        total("unknown").alias("unknown_count"),
        F.count("*").alias("scanned_files"),
    )


def evidence() -> Column:
    """Text of a report row's counts, detectors and examples."""
    detectors = F.when(F.size("top_detectors") > 0, F.array_join("top_detectors", ", "))
    examples = F.when(
        F.size("examples") > 0, F.concat(F.lit(", examples="), F.array_join("examples", ", "))
    )
    return F.concat(
        F.format_string(
            "verified=%d, unknown=%d, unverified=%d, detectors=",
            F.col("verified"),
            F.col("unknown"),
            F.col("unverified"),
        ),
        F.coalesce(detectors, F.lit("none")),
        F.coalesce(examples, F.lit("")),
    )


def blocking_reasons(reports: DataFrame) -> DataFrame:
    """Reports with findings, why they block, and whether something was surely missed."""
    sure = (F.col("verified") > 0) | (F.col("unknown") > 0)
    return reports.where("findings > 0").select(
        "file",
        F.lit(BLOCKING_REASON).alias("reason"),
        evidence().alias("evidence"),
        F.when(sure, "yes").otherwise("maybe").alias("missed_sensitive_data"),
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Findings keyed by the base name of their file.

    A relation rather than one list per file: write it clustered, filter it, or aggregate it.
    """
    return findings.withColumn("basename", basename(F.col("file")))


def auto_reject(reject: DataFrame, reports: DataFrame) -> DataFrame:
    """Files with a verified secret join the reject list."""
    return add_rejected(reject, reports.where("verified > 0"), "file")


def finding_details(findings: DataFrame) -> DataFrame:
    """One text line per finding: ``[STATUS] detector L<line>: mask``."""
    at = F.when(F.col("line").isNotNull(), F.concat(F.lit(" L"), F.col("line").cast("string")))
    text = F.concat(
        F.lit("["),
        F.upper("status"),
        F.lit("] "),
        "detector",
        F.coalesce(at, F.lit("")),
        F.lit(": "),
        "masked",
    )
    return findings.select("file", text.alias("detail"))


def residual_scan(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Findings of the built-in detectors in (redacted) texts, with line numbers.

    No detector can match across a line break, so lines are scanned on their own and need no
    positions. Texts that cannot match, nearly all once redacted, are not split at all.
    """
    lines = texts.where(any_may_match(text)).select(
        F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("_at", "_line")
    )
    hits = lines.select("file", "_at", once(scan_text(F.col("_line"))["hits"]).alias("_hits"))
    found = hits.select("file", "_at", F.explode("_hits").alias("h"))
    raw = F.col("h.match")
    return found.select(
        F.element_at(detector_info(), F.col("h.rule") + 1)["detector"].alias("detector"),
        F.lit(None).cast("string").alias("decoder"),
        F.lit("unverified").alias("status"),
        (F.col("_at") + 1).cast("bigint").alias("line"),
        raw_sha256(raw).alias("raw_sha256"),
        mask_secret(raw).alias("masked"),
        "file",
        raw.alias("raw"),
    )
