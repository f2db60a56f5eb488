"""The whole scan: one wide row per document, in one pass over the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.text import is_blank
from veilmark.operators import comply, report, rewrite
from veilmark.operators.findings import detect_sql, entity_set_of, summary_of, with_findings
from veilmark.sources.documents import text_file_source
from veilmark.sources.rules import rule_list
from veilmark.sources.sinks import output_name


def scan_files(spark, path, mode="redact", **options):
    """Text files of a folder, scanned: the columns of ``scan_documents`` with the path and
    the name of the rewritten file."""
    files = text_file_source(spark, path)
    scanned = scan_documents(files, mode, keep=("path",), **options)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return scanned.withColumn("output_name", output_name(name, mode))


def scan_documents(docs, mode="redact", use_reasoner=True, rules=None, recognizers=None, more=(), keep=()):
    """Findings, counts, rules, exposure, rewritten and marked-up text per document.

    ``docs`` (doc_id, text and optionally warnings).  Every column is computed from
    its own row: the plan has no exchange, so it runs at the speed of the scan.
    Blank texts get the empty result; a null text counts as blank.  With ``more``, findings
    tables from joins, these are put on their documents first: one exchange by id.
    ``keep`` names further columns to pass on.
    """
    listed = rule_list(rules)
    warnings = F.col("warnings") if "warnings" in docs.columns else F.array().cast("array<string>")
    found = docs.select(
        "doc_id",
        *keep,
        F.coalesce("text", F.lit("")).alias("text"),
        F.expr(f"NOT ({is_blank('text')})").alias("has_text"),
        warnings.alias("warnings"),
    )
    found = with_findings(
        found.withColumn("scanned", F.expr("CASE WHEN has_text THEN text ELSE '' END")), recognizers, "scanned", more
    ).withColumnRenamed("hits", "findings") if more else found.withColumn(
        "findings", F.expr(detect_sql("CASE WHEN has_text THEN text ELSE '' END", recognizers))
    )
    ranked = found.withColumn("summary", F.expr(summary_of("findings"))).withColumn(
        "ranked", F.expr(comply.ranked_sql(entity_set_of("findings"), listed))
    ).withColumn("spans", F.expr(rewrite.spans_sql("text", "findings")))
    rewritten = ranked.select(
        "*",
        F.expr(comply.matches_sql("ranked", listed, vocab.TOP_RULES)).alias("compliance_rules"),
        F.expr(comply.exposure_sql("ranked", listed)).alias("compliance_exposure"),
        F.expr(rewrite.rewrite_sql("text", "findings", mode, "spans")).alias(f"{mode}_text"),
        *[
            F.expr(rewrite.rewrite_sql("text", "findings", m, "spans")).alias(f"{m}_text")
            for m in ("redact", "mask")
            if m != mode
        ],
        F.expr(rewrite.highlight_risk_sql("text", "findings")).alias("marked"),
    )

    def if_text(value, blank):
        return f"CASE WHEN has_text THEN {value} ELSE {blank} END"

    no_counts = "cast(map() AS map<string,bigint>)"
    return rewritten.select(
        "doc_id",
        *keep,
        F.expr(if_text("text", "''")).alias("original_text"),
        "findings",
        F.col("summary.total").alias("total"),
        *[
            F.expr(if_text(f"summary.{m}", no_counts)).alias(m)
            for m in ("categories", "risks", "sources")
        ],
        F.expr(if_text("summary.overall_risk", "'None'")).alias("overall_risk"),
        "compliance_rules",
        "compliance_exposure",
        F.expr(
            if_text(report.explanation_sql("findings", use_reasoner), f"'{vocab.NO_TEXT}'")
        ).alias("explanation"),
        F.expr(
            report.prompt_sql("redact_text", "findings", "compliance_rules")
            if use_reasoner
            else "cast(NULL AS string)"
        ).alias("prompt"),
        F.expr(if_text(f"{mode}_text", "''")).alias("redacted_text"),
        F.expr(if_text("mask_text", "''")).alias("masked_text"),
        F.expr(if_text("marked", f"'{vocab.NO_TEXT_HTML}'")).alias("highlighted_html"),
        "warnings",
    )
