"""The training-data pipeline: quality, near-duplicates, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table.  All but the last return the
columns of documents, and what a stage decides takes effect: rejected documents go and
failing lines leave the text, one document of each near-duplicate class stays,
contaminated documents go, personal data is replaced in the text.  The last stage gives
the tokens of what is left and the hashes of its round trip.

Every decision is on a row, not on its id, so rows that share an id, or have none, are
judged each by their own text.  A null or empty text has no words and goes with the first
stage; of repeated rows one is left by the second; an empty table gives an empty result; columns
that documents have besides stay with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark.llm import decontaminate, near_dedup, pii, quality
from veilmark.llm.common import written
from veilmark.llm.queries import bpe_digest


def quality_rules(spark, docs, sf_dir):
    """Documents that pass, without failing lines; ``n_chars`` follows the text."""
    kept = quality.filter_documents(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class, the one with the smallest id, a null id last."""
    return near_dedup.keep_first(docs, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents without a window of any benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_documents(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark, docs, sf_dir):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]

#: No SQL: the methods of the stages can't be expressed; tests hold them to brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = written(docs, f"stage{place}")
    return docs
