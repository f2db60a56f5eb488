"""Views of a scanned document for people and for a language model."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.arrays import quoted


def findings_view(findings):
    """Value cut to 50 characters, score as a whole percent (ties to even)."""
    cut = vocab.VALUE_VIEW_CHARS
    return findings.select(
        "doc_id",
        "span_start",
        F.col("entity_type").alias("entity"),
        "category",
        F.expr(
            f"CASE WHEN length(value) > {cut} THEN concat(left(value, {cut}), '…') ELSE value END"
        ).alias("value"),
        "risk",
        F.concat(F.bround(F.col("score") * 100, 0).cast("int").cast("string"), F.lit("%")).alias(
            "conf"
        ),
        "source",
    )


def snippet(df, text="text"):
    return df.withColumn("snippet", F.left(F.col(text), F.lit(vocab.SNIPPET_CHARS)))


def finding_lines_sql(hits, raw=True):
    """The first findings as lines; with ``raw=False`` the type stands for the value."""
    value = f"left(_h.value, {vocab.VALUE_LINE_CHARS})" if raw else "concat('[', _h.entity_type, ']')"
    return (
        f"array_join(transform(slice({hits}, 1, {vocab.REPORT_FINDINGS}), _h -> concat("
        f"'  - ', _h.entity_type, ' (', _h.category, ', ', _h.risk, ' risk): \\'', {value}, "
        "'\\'')), '\\n')"
    )


def rule_lines_sql(matches):
    return (
        f"array_join(transform(slice({matches}, 1, {vocab.REPORT_RULES}), "
        "_r -> concat('  - [', _r.framework, '] ', _r.rule)), '\\n')"
    )


def frameworks_sql(matches):
    return f"array_sort(array_distinct(transform({matches}, _r -> _r.framework)))"


def high_risk_sql(hits):
    return f"cast(size(filter({hits}, _h -> _h.risk = 'High')) AS bigint)"


def report_lines(df, hits="hits", matches="compliance_rules"):
    """Lines for findings and rules, the frameworks involved, and two counts."""
    return df.select(
        "doc_id",
        F.expr(f"cast(size({hits}) AS bigint)").alias("total"),
        F.expr(high_risk_sql(hits)).alias("high_risk"),
        F.expr(finding_lines_sql(hits)).alias("finding_lines"),
        F.expr(rule_lines_sql(matches)).alias("rule_lines"),
        F.expr(frameworks_sql(matches)).alias("frameworks"),
    )


def prompt_sql(text, hits, matches, raw=False):
    """A request for a three-sentence explanation, ready for any batch model.

    ``text`` should be the redacted text: with ``raw=False`` no found value is in
    the prompt.  Null where there is nothing to explain.
    """
    parts = [
        quoted(
            "Act as a privacy reviewer. Be brief and factual; suggest, do not give legal advice."
        ),
        "concat('TEXT EXCERPT:\\n', left({t}, {n}))".format(t=text, n=vocab.SNIPPET_CHARS),
        f"concat('FINDINGS (', size({hits}), ' in all, ', {high_risk_sql(hits)}, "
        f"' of high risk):\\n', {finding_lines_sql(hits, raw)})",
        f"concat('RULES THAT MAY APPLY:\\n', {rule_lines_sql(matches)})",
        f"concat('FRAMEWORKS: ', array_join({frameworks_sql(matches)}, ', '))",
        quoted(
            "Answer in three sentences: the overall risk, the most serious finding and why, "
            "and one step to take."
        ),
    ]
    joined = f"concat_ws('\\n\\n', {', '.join(parts)})"
    return f"CASE WHEN size({hits}) > 0 THEN {joined} END"


def explanation_prompt(df, text="redacted_text", hits="hits", matches="compliance_rules", raw=False):
    return df.withColumn("prompt", F.expr(prompt_sql(text, hits, matches, raw)))


def finding_prompt(findings):
    """A request about one finding; it names the type, never the value."""
    return findings.withColumn(
        "prompt",
        F.concat(
            F.lit("In two sentences: why is a field of type "), "entity_type", F.lit(" ("),
            "category", F.lit(", "), "risk",
            F.lit(" risk) sensitive, and which regulation usually covers it?"),
        ),
    )


def explanation_sql(hits, use_reasoner=True):
    """Fixed sentence without findings; otherwise empty, or null while a model's
    answer to the prompt is still to come."""
    rest = "cast(NULL AS string)" if use_reasoner else "''"
    return f"CASE WHEN size({hits}) = 0 THEN {quoted(vocab.NOTHING_FOUND)} ELSE {rest} END"


def explanation_default(df, hits="hits", use_reasoner=True):
    return df.withColumn("explanation", F.expr(explanation_sql(hits, use_reasoner)))


def with_replies(scanned, replies):
    """Join a model's replies (doc_id, reply, error) to scanned documents.

    A reply becomes the explanation of its document; an error becomes a fixed sentence and
    a warning.  Documents whose explanation stands already keep it.
    """
    joined = scanned.join(replies.select("doc_id", "reply", "error"), "doc_id", "left")
    failed = F.col("error").isNotNull() & F.col("explanation").isNull()
    text = F.when(failed, F.concat(F.lit(vocab.REPLY_FAILED), "error")).otherwise(F.col("reply"))
    return joined.withColumn(
        "warnings", F.when(failed, F.array_append("warnings", F.col("error"))).otherwise(F.col("warnings"))
    ).withColumn("explanation", F.coalesce("explanation", text)).select(*scanned.columns)


def headline_counts(summary):
    """The four tiles over a summary: three categories, their sum, the risk."""
    tiles = [
        F.col("categories")[c].alias(c.lower()) for c in ("PII", "PHI", "Financial")
    ]
    total = sum(F.col("categories")[c] for c in ("PII", "PHI", "Financial"))
    return summary.select("doc_id", *tiles, total.alias("shown_total"), "overall_risk")
