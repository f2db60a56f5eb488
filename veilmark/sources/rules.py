"""The table of compliance rules: a small configuration, not data."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import functions as F

from veilmark import schemas, vocab

PACKAGED = Path(__file__).with_name("rules.json")

TERM = "[a-z0-9]+"

# Rules of the functions that work in the row become literals of the plan.  A table beyond
# this size is no configuration any more; ``comply.retrieve_table`` and
# ``comply.exposure_table`` take one of any size.
MAX_RULES = 500


def packaged_rules():
    return json.loads(PACKAGED.read_text(encoding="utf-8"))


def rules_source(spark, path=None):
    """Rules from a JSON array file, by default the 18 that come with the package."""
    if path is None:
        return spark.createDataFrame(packaged_rules(), schemas.RULES)
    return spark.read.schema(schemas.RULES).option("multiLine", True).json(path)


def rule_list(rules=None):
    """Rules as Python rows for the plan: packaged, given, or read from a table."""
    if rules is None:
        return packaged_rules()
    if isinstance(rules, list):
        found = rules
    else:
        found = [r.asDict() for r in rules.limit(MAX_RULES + 1).collect()]
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; use retrieve_table and exposure_table")
    return found


def rule_text(rule):
    """One text per rule: framework, rule, description and types."""
    return vocab.RULE_TEXT.format(**{**rule, "types": ", ".join(rule["entity_types"])})


def rule_documents(rules):
    """The same text as a column, next to the rule."""
    columns = {"types": F.array_join("entity_types", ", ")}
    parts = [
        columns.get(name, F.col(name)) if place % 2 else F.lit(name)
        for place, name in enumerate(re.split(r"[{}]", vocab.RULE_TEXT))
    ]
    return rules.withColumn("document", F.concat(*parts))


def rule_vectors(rules):
    """``rule_id, term, idf, rw``: the TF-IDF vector of each rule text, of length one."""
    documents = rule_documents(rules).select(F.col("id").alias("rule_id"), "document")
    return term_vectors(documents)


def write_rule_vectors(vectors, path):
    """Write rule vectors once; an existing table is left alone."""
    vectors.write.mode("ignore").parquet(path)


def read_rule_vectors(spark, path):
    return spark.read.schema("rule_id STRING, term STRING, idf DOUBLE, rw DOUBLE").parquet(path)


def term_counts(documents):
    """``rule_id, term, tf``: how often each document (rule_id, document) has each of its terms."""
    words = F.regexp_extract_all(F.lower("document"), F.lit(TERM), F.lit(0))
    return documents.select("rule_id", F.explode(words).alias("term")).groupBy("rule_id", "term").agg(
        F.count("*").alias("tf")
    )


def inverse_frequencies(counts, documents):
    """``term, idf`` of the ``term_counts`` of documents."""
    n = documents.agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(
        (F.log((F.lit(1) + n.scalar()) / (F.lit(1) + F.count("*"))) + 1).alias("idf")
    )


def term_vectors(documents):
    """TF-IDF vectors of length one of (rule_id, document)."""
    tf = term_counts(documents)
    weighted = tf.join(inverse_frequencies(tf, documents), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("rule_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "rule_id").select(
        "rule_id", "term", "idf", (F.col("w") / F.col("norm")).alias("rw")
    )
