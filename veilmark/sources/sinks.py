"""Writing results."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab


def output_name(name, mode):
    """Stem, mode and a final "d": ``a.b.txt`` -> ``a.b_redactd.txt``."""
    if mode not in vocab.REWRITE_MODES:
        raise ValueError(f"unknown rewrite mode {mode!r}, expected one of {vocab.REWRITE_MODES}")
    return F.concat(F.regexp_replace(name, r"(?s)\.[^.]*$", ""), F.lit(f"_{mode}d.txt"))


def write_redacted(df, path, mode, name="name", text="redacted_text"):
    """Rewritten texts with their output names, as parquet."""
    df.select(output_name(F.col(name), mode).alias("file_name"), F.col(text).alias("text")).write.mode(
        "overwrite"
    ).parquet(path)


#: Rows of one file of findings, a few dozen MB.
FILE_ROWS = 1_000_000


def write_findings(findings, path, file_rows=FILE_ROWS):
    """Findings, one folder per category, so that readers of one category skip the rest.

    Rows are put together by category, and Spark splits a category that is larger than a
    partition should be among several tasks, so that none writes a hot one alone.  No file
    has more than ``file_rows`` rows.
    """
    findings.hint("rebalance", "category").write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(
        "category"
    ).parquet(path)
