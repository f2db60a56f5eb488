"""Summaries of a corpus that is scanned batch by batch.

Each batch leaves a few rows: counts per category and type, and sketches of the documents
and values that it saw.  They are written under the name of the batch and merged when they
are read, so nothing is scanned twice, and a batch that is run again replaces its own rows.

Defined results: the merged counts are those of one scan over all batches; numbers of documents
and values are estimates of a sketch, whatever the batches; a batch without findings leaves
no rows; a batch that comes late, or out of order, counts like any other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab

#: Registers of a sketch, as a power of two: an error of about 1.6 %.
SKETCH_BITS = 12

_COUNTS = ["total", *[f"risk_{r.lower()}" for r in vocab.RISKS]]
SCHEMA = (
    "category STRING, entity_type STRING, "
    + ", ".join(f"{c} BIGINT" for c in _COUNTS)
    + ", top_score DOUBLE, documents BINARY, values BINARY, batch STRING"
)


def partial_summary(findings):
    """One row per category and type: counts, the top score, and sketches."""
    return findings.groupBy("category", "entity_type").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in vocab.RISKS],
        F.max("score").alias("top_score"),
        F.hll_sketch_agg("doc_id", SKETCH_BITS).alias("documents"),
        F.hll_sketch_agg("value", SKETCH_BITS).alias("values"),
    )


def write_partial(findings, folder, batch):
    """Write the summary of a batch; one of the same name is replaced."""
    partial_summary(findings).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def merged(partials):
    """Partial summaries as one, with subtotals: the rows of ``corpus_summary`` and, as
    estimates, ``n_documents`` and ``n_values``."""
    return partials.rollup("category", "entity_type").agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.max("top_score").alias("top_score"),
        F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("n_documents"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("n_values"),
    )


def read_partials(spark, folder):
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(f"{folder}/batch=*")


def read_summary(spark, folder):
    """The summary over all batches of a folder."""
    return merged(read_partials(spark, folder))
