"""Summaries by batch, from tables and streams, and the layout of findings."""

import pytest
from pyspark.sql import functions as F

from samples import BANK, MEDICAL, STAFF, UNICODE
from veilmark.operators import findings as fd, summaries
from veilmark.sources.sinks import write_findings
from veilmark.streaming.scan import read_stream, summary_stream

COUNTS = ["category", "entity_type", "total", "risk_high", "risk_medium", "risk_low", "top_score"]


def counts(frame):
    return sorted((tuple(r) for r in frame.select(*COUNTS).collect()), key=str)


@pytest.fixture
def found(spark, docs):
    return fd.detect(docs(*[MEDICAL, STAFF, BANK, UNICODE, "nothing", None] * 5)).cache()


def test_batches_merged_equal_one_scan(spark, found, tmp_path):
    for batch, rows in enumerate([found.where("doc_id % 3 = 0"), found.where("doc_id % 3 > 0"), found.where("false")]):
        summaries.write_partial(rows, str(tmp_path), batch)
    summaries.write_partial(found.where("doc_id % 3 = 0"), str(tmp_path), 0)  # run again
    whole = summaries.read_summary(spark, str(tmp_path))
    assert counts(whole) == counts(fd.corpus_summary(found))
    total = whole.where("category IS NULL").first()
    # Few enough for a sketch to be exact.
    assert total.n_documents == found.select("doc_id").distinct().count()
    assert total.n_values == found.select("value").distinct().count()


def test_a_late_batch_counts(spark, found, tmp_path):
    summaries.write_partial(found.where("doc_id > 9"), str(tmp_path), "2024-02-02")
    before = counts(summaries.read_summary(spark, str(tmp_path)))
    summaries.write_partial(found.where("doc_id <= 9"), str(tmp_path), "2024-01-01")
    assert counts(summaries.read_summary(spark, str(tmp_path))) == counts(fd.corpus_summary(found)) != before


def test_a_stream_that_stops_and_goes_on_equals_the_batch(spark, docs, tmp_path):
    table = docs(*[MEDICAL, STAFF, BANK, UNICODE, "nothing"] * 3).repartition(4)
    table.write.parquet(str(tmp_path / "in"))

    def run(checkpoint):
        stream = read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
        summary_stream(stream, str(tmp_path / "out"), str(tmp_path / checkpoint))
        return counts(summaries.read_summary(spark, str(tmp_path / "out")))

    assert run("a") == counts(fd.corpus_summary(fd.detect(table)))
    docs(STAFF, MEDICAL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    both = fd.corpus_summary(fd.detect(spark.read.schema(table.schema).parquet(str(tmp_path / "in"))))
    assert run("a") == counts(both)  # from the checkpoint: the new file alone
    assert run("a") == counts(both)


def test_no_task_writes_a_hot_category_alone(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 20 == 0, "PHI").otherwise("PII").alias("category"),
        F.sha2(F.col("id").cast("string"), 256).alias("value"),
    )
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        write_findings(rows, str(tmp_path / "f"), file_rows=9000)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 60_000 and {r.category for r in back.select("category").distinct().collect()} == {"PII", "PHI"}
    files = back.where("category = 'PII'").groupBy(F.input_file_name().alias("f")).count().collect()
    tasks = {r.f.split("part-")[1].split("-")[0] for r in files}
    assert len(tasks) > 3 and max(r["count"] for r in files) <= 9000
