import json

import pytest

from samples import MEDICAL
from veilmark.operators import findings as fd, rewrite
from veilmark.session import shared_folder
from veilmark.sources import documents as src, rules as rl, sinks


def test_text_files_are_decoded_and_others_warned_about(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é ok".encode() + b"\xff end")
    (tmp_path / "b.md").write_bytes(b"\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xyz").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in src.text_file_source(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"].text == "é ok� end" and rows["a.TXT"].warnings == []
    assert rows["b.md"].text == "\n" and rows["b.md"].warnings == []
    assert rows["c.pdf"].text == "" and ".pdf" in rows["c.pdf"].warnings[0]
    assert "unsupported" in rows["d.xyz"].warnings[0]


@pytest.mark.parametrize(
    "name, route",
    [
        ("a/b.PDF", "pdf"), ("x.jpeg", "image"), ("x.webp", "image"), ("x.csv", "text"), ("x.docx", "unsupported"),
        ("dir.txt/file", "unsupported"), ("dir/.txt", "unsupported"), ("a.tar.md", "text"),
    ],
)
def test_routes(spark, name, route):
    df = spark.createDataFrame([(name,)], "path STRING")
    assert src.route_by_extension(df).first().route == route


def test_pages(spark):
    long = "y" * 51
    df = spark.createDataFrame(
        [(1, 2, "  short ", "scan two"), (1, 1, f" {long} \n", "unused"), (1, 10, None, None), (2, 1, "z" * 50, "s")],
        "doc_id INT, page_num INT, embedded_text STRING, ocr_text STRING",
    )
    got = {r.doc_id: r.text for r in src.assemble_pages(df).collect()}
    assert got == {1: f"{long}\n\n[Page 2]\nscan two\n\n[Page 10]\n", 2: "[Page 1]\ns"}


def test_blank_texts_leave_early(docs):
    full, empty = src.split_empty(docs("a", "  \n", "", None))
    assert [r.doc_id for r in full.collect()] == [0]
    rows = empty.collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3]
    assert {(r.overall_risk, r.total, r.original_text) for r in rows} == {("None", 0, "")}


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rl.packaged_rules(), indent=1), encoding="utf-8")
    assert rl.rules_source(spark, str(path)).collect() == rl.rules_source(spark).collect()


def test_rule_vectors_are_written_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rl.write_rule_vectors(spark.range(3), path)
    rl.write_rule_vectors(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_output_names(spark, tmp_path):
    df = spark.createDataFrame([("a.b.txt", "t"), ("plain", "t")], "name STRING, redacted_text STRING")
    for mode, last in [("redact", "redactd"), ("mask", "maskd"), ("replace", "replaced")]:
        names = [r[0] for r in df.select(sinks.output_name(df["name"], mode)).collect()]
        assert names == [f"a.b_{last}.txt", f"plain_{last}.txt"]
    sinks.write_redacted(df, str(tmp_path / "out"), "mask")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        sinks.output_name(df["name"], "shred")


def test_findings_are_partitioned_by_category(spark, docs, tmp_path):
    path = str(tmp_path / "findings")
    found = fd.detect(docs(MEDICAL))
    sinks.write_findings(found, path)
    back = spark.read.parquet(path)
    assert back.count() == found.count()
    plan = back.filter("category = 'PHI'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan


def test_text_without_findings_is_unchanged(docs):
    text = "Nothing to see: just words, 12 of them \U0001F600."
    assert rewrite.redact(fd.with_findings(docs(text))).first().redacted_text == text


class Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_shared_folder_comes_from_the_session():
    given = Session(spark_checkpoint_dir="/some/shared/place/", spark_master="yarn")
    assert shared_folder(given) == "/some/shared/place"
    assert shared_folder(Session(spark_master="local[2]")).startswith("/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))
