import re

from pyspark.sql import functions as F

from samples import BANK, MEDICAL, STAFF, UNICODE
from veilmark import vocab
from veilmark.operators import findings as fd, layers, recognize as rc, report, rewrite
from veilmark.plans.scan import scan_documents, scan_files
from veilmark.streaming.scan import read_stream, scan_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_scan(docs):
    rows = scan_documents(docs(MEDICAL, STAFF, BANK, "clean", " \n", None)).collect()
    assert [r.total for r in rows] == [10, 10, 6, 0, 0, 0]
    assert [r.overall_risk for r in rows] == ["High", "High", "High", "Low", "None", "None"]
    assert [len(r.compliance_rules) for r in rows] == [6, 6, 6, 0, 0, 0]
    assert [len(r.compliance_exposure) for r in rows] == [5, 5, 5, 0, 0, 0]
    assert rows[3].explanation == vocab.NOTHING_FOUND and rows[4].explanation == vocab.NO_TEXT
    assert rows[3].redacted_text == "clean" and rows[4].original_text == ""
    assert rows[4].highlighted_html == vocab.NO_TEXT_HTML and rows[4].categories == {}
    assert rows[0].explanation is None and rows[0].prompt and rows[3].prompt is None


def test_scan_modes_and_reasoning_switch(docs):
    masked = scan_documents(docs(MEDICAL), mode="mask", use_reasoner=False).first()
    assert masked.redacted_text == masked.masked_text and masked.explanation == "" and masked.prompt is None
    replaced = scan_documents(docs(BANK), mode="replace").first()
    assert "4111-1111-1111-1111" in replaced.redacted_text and "*" in replaced.masked_text


def test_no_found_value_is_in_a_prompt(docs):
    for r in scan_documents(docs(MEDICAL, STAFF, BANK, UNICODE)).collect():
        for f in r.findings:
            assert f.value not in r.prompt, f.value


def test_prompt_can_carry_raw_values_when_asked(docs):
    df = scan_documents(docs(MEDICAL)).withColumnRenamed("findings", "hits")
    assert "351-48-2207" in report.explanation_prompt(df, text="original_text", raw=True).first().prompt


def test_reports_are_cut(docs):
    many = " ".join(f"cvv {100 + i}" for i in range(20)) + " Diagnosis: " + "x" * 60
    df = fd.with_findings(docs(many)).withColumn("m", F.array().cast("array<struct<framework:string,rule:string>>"))
    row = report.report_lines(df, matches="m").first()
    assert row.total == 21 and row.high_risk == 21 and len(row.finding_lines.splitlines()) == 12
    view = report.findings_view(fd.detect(docs(many))).filter("entity = 'diagnosis'").first()
    assert view.value == "x" * 50 + "…" and view.conf == "90%"


def test_percent_ties_go_to_even(spark):
    names = "doc_id, span_start, entity_type, category, value, risk, score, source".split(", ")
    df = spark.createDataFrame([(1, 0, "A", "PII", "v", "Low", 0.845, "ner"), (2, 0, "A", "PII", "v", "Low", 0.855, "ner")], names)
    assert [r.conf for r in report.findings_view(df).collect()] == ["84%", "86%"]


def test_stream_equals_batch(spark, tmp_path):
    texts = [MEDICAL, STAFF, BANK, UNICODE, "nothing"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(3)
    table.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = read_stream(spark, str(tmp_path / "in"), files_per_batch=1)
        scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    back = spark.read.schema(fd.findings_schema()).parquet(str(tmp_path / "out"))
    batch = fd.detect(table)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, batch.select(back.columns).collect()))


# ---- plans ----------------------------------------------------------------
def parquet_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def test_detection_is_one_pass_without_exchange(spark):
    docs = parquet_docs(spark)
    for df in (fd.detect(docs), rewrite.redact(fd.with_findings(docs)), fd.summarize(fd.with_findings(docs)), scan_documents(docs)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "CartesianProduct" not in text
        assert text.count("FileScan parquet") == 1
        assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_every_pattern_is_evaluated_once(spark):
    wanted = [r for r in rc.ALL_LAYERS if r.entity_type != "MRN"]
    groups = sum(bool(r.value_group) + bool(r.label_group) for r in wanted)
    text = plan(fd.detect(parquet_docs(spark)))
    # One more cuts the values of labelled fields into items.
    assert text.count("regexp_extract_all(") == len(wanted) + groups + 1


def test_findings_of_a_join_do_not_move_the_text(spark):
    docs = parquet_docs(spark)
    terms = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").select(
        F.col("n_name").alias("term"), F.lit("LOCATION").alias("entity_type")
    )
    text = plan(fd.detect(docs, more=[layers.find_dictionary(docs, terms)]))
    for line in text.splitlines():
        if "Exchange" in line or "HashAggregate" in line or "SortAggregate" in line:
            assert not re.search(r"\btext#", line)


def test_a_large_dictionary_is_joined_by_shuffle_with_dealt_out_terms(spark):
    docs = parquet_docs(spark)
    terms = spark.range(1000).select(F.concat(F.lit("w"), "id").alias("term"), F.lit("PERSON").alias("entity_type"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(layers.find_dictionary(docs, terms))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in text and re.search(r"hashpartitioning\(gram#\d+, salt#\d+", text)


def test_files_are_scanned_end_to_end(spark, tmp_path):
    (tmp_path / "note.one.txt").write_bytes(b"SSN: 123-45-6789 \xff")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.7 binary")
    (tmp_path / "odd.xyz").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in scan_files(spark, str(tmp_path)).collect()}
    assert rows["note.one.txt"].redacted_text == "SSN: [US_SSN] \ufffd"
    assert rows["note.one.txt"].output_name == "note.one_redactd.txt" and rows["note.one.txt"].warnings == []
    assert rows["scan.pdf"].overall_risk == "None" and "outside reader" in rows["scan.pdf"].warnings[0]
    assert "unsupported" in rows["odd.xyz"].warnings[0] and len({r.doc_id for r in rows.values()}) == 3


def test_joined_findings_reach_every_part_of_the_scan(spark, docs):
    terms = spark.createDataFrame([("Tobias Grell", "PERSON"), ("Elm Row", "LOCATION")], "term STRING, entity_type STRING")
    table = docs(MEDICAL, "nothing", None)
    rows = scan_documents(table, mode="replace", more=[layers.find_dictionary(table, terms)]).orderBy("doc_id").collect()
    assert [r.total for r in rows] == [11, 0, 0]
    assert "Case 7 of the 123 Example St clinic" in rows[0].redacted_text
    assert "LOCATION" in rows[0].highlighted_html and rows[0].sources["rules"] == 5 and "Elm Row" not in rows[0].masked_text
