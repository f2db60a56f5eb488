"""The bit filter, and findings of joins that leave other documents where they are."""

import pytest
from pyspark.sql import functions as F

from samples import BANK, MEDICAL
from veilmark.functions.filters import HASHES, MOST_BITS, filter_bits, filter_of, may_hold
from veilmark.operators import findings as fd, layers, rewrite
from veilmark.plans.scan import scan_documents


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_the_filter_grows_with_its_keys_up_to_a_limit():
    assert filter_bits(0) == filter_bits(1) == 1024
    assert filter_bits(1000) == 1 << 14 and filter_bits(10**6) == 1 << 24
    assert filter_bits(10**12) == MOST_BITS and HASHES == 4


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_all_keys_pass_and_few_others(spark, kind):
    ids = spark.range(40_000).select((F.col("id") * 7).cast(kind).alias("k"))
    held = ids.where("cast(k AS bigint) % 4 = 0").unionByName(spark.createDataFrame([(None,)], f"k {kind}"))
    passes = may_hold(filter_of(held, "k", 10_000), "k", 10_000)
    n = ids.select((F.col("k").cast("bigint") % 4 == 0).alias("own"), passes.alias("p")).groupBy("own", "p").count()
    counts = {(r.own, r.p): r["count"] for r in n.collect()}
    assert counts.get((True, False), 0) == 0 and counts[(True, True)] == 10_000
    assert counts.get((False, True), 0) < 0.03 * 30_000
    nulls = spark.createDataFrame([(None,)], f"k {kind}").select(passes.alias("p"))
    assert nulls.first().p is False


def test_an_empty_filter_holds_nothing(spark):
    none = spark.range(0).select(F.col("id").alias("k"))
    assert spark.range(100).select(F.col("id").alias("k")).where(may_hold(filter_of(none, "k", 0), "k", 0)).count() == 0


def corpus(spark):
    texts = [MEDICAL, "nothing", None, BANK, "Tobias Grell again", ""] * 20
    rows = list(enumerate(texts)) + [(None, "Tobias Grell"), (3, "Tobias Grell twice")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")


def names(spark, docs):
    terms = spark.createDataFrame([("Tobias Grell", "PERSON"), ("Elm Row", "LOCATION")], "term STRING, entity_type STRING")
    return layers.find_dictionary(docs, terms)


def as_rows(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()))


def test_both_ways_give_the_same_rows(spark, no_broadcast):
    docs = corpus(spark)
    split = as_rows(rewrite.redact(fd.with_findings(docs, more=[names(spark, docs)])).select("doc_id", "redacted_text"))
    scanned = as_rows(scan_documents(docs, more=[names(spark, docs)]).drop("compliance_exposure"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    whole = rewrite.redact(fd.with_findings(docs, more=[names(spark, docs)])).select("doc_id", "redacted_text")
    assert "BroadcastHashJoin" in whole._jdf.queryExecution().toString()
    assert as_rows(whole) == split and len(split) == docs.count()
    assert as_rows(scan_documents(docs, more=[names(spark, docs)]).drop("compliance_exposure")) == scanned


def test_documents_without_findings_reach_no_exchange(spark, no_broadcast, tmp_path):
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("plain text").alias("text")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    model = spark.range(0, 20_000, 100).selectExpr(
        "id AS doc_id", "0 AS chunk", "'salary' AS label", "0 AS span_start", "5 AS span_end", "'plain' AS value",
        "0.9D AS score",
    )
    found = fd.with_findings(docs, more=[layers.external_findings(model)])
    assert sum(len(r.hits) > 0 for r in found.collect()) == 200
    final = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==\n   Union")[0]
    lines = final.splitlines()
    union = next(i for i, line in enumerate(lines) if line.strip() == "+- Union")
    # The second branch of the union begins where its arm does; the first one holds the join.
    arm = lines[union].index("+-") + 3
    rest = next(i for i, line in enumerate(lines) if i > union and line[arm:].startswith("+-"))
    first, second = "\n".join(lines[union:rest]), "\n".join(lines[rest:])
    assert "SortMergeJoin" in first and "Exchange hashpartitioning(doc_id" in first
    assert "FileScan parquet" in second and "Exchange" not in second and "Join" not in second


def test_rows_that_are_shuffled_are_those_that_pass(spark, no_broadcast):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("plain text").alias("text"))
    keys = spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"))
    passed = docs.where(may_hold(filter_of(keys, "doc_id", 200), "doc_id", 200)).count()
    assert 200 <= passed < 600
