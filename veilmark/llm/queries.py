"""The registered queries of the operators, one for each, on the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from veilmark.llm import (
    bpe, decontaminate, exact, langid, lm, merkle, near_dedup, pii, quality, secrets, spelling, toxicity, warc,
)
from veilmark.llm.oracle import ORACLE_SQL

QUERIES = {}

#: Production parameter: the rank file and the pattern that cuts texts.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def bpe_digest(docs):
    """Encode, decode again, and sum up both as hashes."""
    coded = bpe.round_trip(docs, RANKS, PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def op1_bpe(spark, d):
    return bpe_digest(table(spark, d, "documents"))


@query
def op2_decontaminate(spark, d):
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x["item_id"].cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_lm_score(spark, d):
    return lm.score(table(spark, d, "documents"))


@query
def op4_quality(spark, d):
    return quality.assess(table(spark, d, "documents"), with_text=False)


@query
def op5_pii(spark, d):
    docs = table(spark, d, "documents")
    found = pii.detect(docs, pii.fit(docs))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


@query
def op7_near_dedup(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents"), percent=85)


@query
def op6_warc(spark, d):
    found = warc.round_trip(table(spark, d, "pages"))
    # A record that fails, or is missing, fails the query.
    whole = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error("error").cast("long"))
    return found.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def remainder(column, divisor):
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


@query
def op8_langid(spark, d):
    docs = table(spark, d, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_secrets(spark, d):
    docs = table(spark, d, "documents")
    found = secrets.detect(docs, secrets.identifiers(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op10_toxicity(spark, d):
    docs = table(spark, d, "documents")
    lexicon = toxicity.fit(docs, table(spark, d, "labels").where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, lexicon).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op11_spelling(spark, d):
    return spelling.variants(table(spark, d, "documents"))


@query
def op12_merkle(spark, d):
    docs = table(spark, d, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_hash([F.col("n_chars") + 1 if c == "n_chars" else c for c in fields])
    rows = docs.select(
        "doc_id", "lang", merkle.leaf_hash(fields).alias("leaf"),
        F.when(remainder("doc_id", 7) == 0, tampered).alias("tampered"),
    )
    found = merkle.proofs(rows, carry=["tampered"]).withColumn("present", F.coalesce("tampered", "leaf"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select(
        "doc_id", *hexed, merkle.proof_hash().alias("proof_sha256"), merkle.fold("present").alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_exact(spark, d):
    return exact.exact_duplicates(table(spark, d, "documents"))
