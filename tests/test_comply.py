import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.operators import comply
from veilmark.sources import rules as rl


@pytest.fixture(scope="module")
def type_sets(spark):
    rng = random.Random(11)
    kinds = sorted(vocab.CATEGORY_TABLE)
    rows = [(i, sorted(rng.sample(kinds, rng.randrange(0, 9)))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id BIGINT, entity_types ARRAY<STRING>")


def test_rules_and_vocabulary():
    rules = rl.packaged_rules()
    assert len(rules) == 18 and len({r["id"] for r in rules}) == 18
    frameworks = [r["framework"] for r in rules]
    assert {f: frameworks.count(f) for f in set(frameworks)} == {
        "HIPAA": 9, "GDPR": 3, "PCI-DSS": 3, "CCPA": 2, "GLBA": 1,
    }
    assert {r["id"] for r in rules if r["risk"] != "High"} == {"hipaa-3", "ccpa-1"}
    assert len(vocab.CATEGORY_TABLE) == 34 and len(vocab.DENYLIST) == 49


def test_ranking_in_row_equals_the_term_join(spark, type_sets):
    sets = type_sets.filter(F.size("entity_types") > 0)
    queries = comply.query_text(sets).select(F.col("doc_id").alias("query_id"), F.col("query_text").alias("text"))
    documents = rl.rule_documents(rl.rules_source(spark)).select(F.col("id").alias("rule_id"), "document")
    joined = comply.term_cosine_topk(queries, documents, 18)
    row = comply.retrieve_rules(sets, k=18)
    assert {(r.query_id, r.rule_id): r.relevance for r in joined.collect()} == {
        (r.doc_id, r.id): r.relevance for r in row.collect()
    }
    assert joined.count() == 18 * sets.count()


def test_rule_text_is_the_same_in_python_and_spark(spark):
    rows = rl.rule_documents(rl.rules_source(spark)).collect()
    assert [r.document for r in rows] == [rl.rule_text(r) for r in rl.packaged_rules()]


def test_top_rules_and_ties(type_sets):
    rows = comply.retrieve_rules(type_sets, k=vocab.TOP_RULES).orderBy("doc_id", "rank").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for found in by_doc.values():
        assert [r.rank for r in found] == [1, 2, 3, 4, 5, 6]
        relevance = [r.relevance for r in found]
        assert relevance == sorted(relevance, reverse=True) and all(0 <= x <= 1 for x in relevance)


def test_exposure_names_every_framework_once_anything_is_found(type_sets):
    rows = comply.exposure(type_sets).collect()
    filled = type_sets.filter(F.size("entity_types") > 0).count()
    assert filled < type_sets.count()
    assert len(rows) == 5 * filled
    ranked = comply.rank_frameworks(type_sets).orderBy("doc_id", "rank").collect()
    for i in range(0, len(ranked), 5):
        scores = [(-r.exposure, r.framework) for r in ranked[i:i + 5]]
        assert scores == sorted(scores)


def test_exposure_weighs_risk(spark):
    rules = [
        dict(id="a", framework="X", rule="r", entity_types=["CVV"], description="d", risk="Medium"),
        dict(id="b", framework="Y", rule="r", entity_types=["CVV"], description="d", risk="Odd"),
        dict(id="c", framework="Z", rule="r", entity_types=["CVV"], description="d", risk="High"),
    ]
    df = spark.createDataFrame([(1, ["CVV"])], "doc_id BIGINT, entity_types ARRAY<STRING>")
    got = {r.framework: r.exposure for r in comply.exposure(df, rules).collect()}
    relevance = {r.framework: r.relevance for r in comply.retrieve_rules(df, rules).collect()}
    assert got == {f: round(relevance[f] * w * 100, 1) for f, w in {"X": 0.6, "Y": 0.5, "Z": 1.0}.items()}


def test_bands_are_strict(spark):
    df = spark.createDataFrame([(70.1,), (70.0,), (40.1,), (40.0,)], "exposure DOUBLE")
    assert [r.band for r in comply.exposure_band(df).collect()] == ["High exposure", "Moderate", "Moderate", "Low"]


def test_rules_by_type(spark):
    df = spark.createDataFrame([(1, ["CVV", "US_SSN"]), (2, [])], "doc_id BIGINT, entity_types ARRAY<STRING>")
    rows = comply.rules_by_type(df).collect()
    assert {r.rule_id for r in rows} == {"hipaa-6", "gdpr-3", "pci-2", "ccpa-1", "ccpa-2"}
    assert all(r.doc_id == 1 for r in rows)


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_cosine_equals_brute_force(spark, block_bytes, tmp_path):
    """In one block and in many: the same neighbours in the same order."""
    rng = np.random.default_rng(2)
    known, asked = rng.normal(size=(60, 5)), rng.normal(size=(40, 5))
    to_df = lambda m, key: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} BIGINT, vec ARRAY<DOUBLE>"
    )
    to_df(known, "id").write.parquet(str(tmp_path / "known"))
    table = spark.read.parquet(str(tmp_path / "known"))
    rows = comply.cosine_topk(to_df(asked, "query_id"), table, 4, block_bytes).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    similarity = unit(asked) @ unit(known).T
    expected = {
        (q, k + 1): (int(i), round(float(similarity[q, i]), 3))
        for q in range(40)
        for k, i in enumerate(np.argsort(-similarity[q])[:4])
    }
    got = {(r.query_id, r.rank): (r.id, r.relevance) for r in rows}
    assert got.keys() == expected.keys()
    for key, (i, relevance) in expected.items():
        assert got[key][0] == i and got[key][1] == pytest.approx(relevance, abs=1e-3)


def test_k_is_held_to_the_size_of_the_collection(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id BIGINT, vec ARRAY<DOUBLE>")
    assert comply.cosine_topk(df.withColumnRenamed("id", "query_id"), df, 9).count() == 4


def test_too_many_rules_are_refused(spark):
    rules = spark.range(rl.MAX_RULES + 1).select(
        F.col("id").cast("string"), F.lit("F").alias("framework"), F.lit("r").alias("rule"),
        F.array(F.lit("CVV")).alias("entity_types"), F.lit("d").alias("description"), F.lit("High").alias("risk"),
    )
    with pytest.raises(ValueError, match="exposure_table"):
        rl.rule_list(rules)


def test_rules_as_a_table_of_any_size(spark, type_sets):
    """More rules than the plan may hold, and the packaged ones: as the row functions say."""
    rules = rl.rules_source(spark)
    row = {(r.doc_id, r.framework): (r.exposure, r.band) for r in comply.exposure(type_sets).collect()}
    table = comply.exposure_table(type_sets, rules, k=18).collect()
    assert {(r.doc_id, r.framework): (r.exposure, r.band) for r in table} == row
    top = {(r.doc_id, r.rule_id): r.relevance for r in comply.retrieve_table(type_sets, rules, k=6).collect()}
    assert top == {(r.doc_id, r.id): r.relevance for r in comply.retrieve_rules(type_sets, k=6).collect()}
    many = spark.range(rl.MAX_RULES + 100).select(
        F.col("id").cast("string"), F.concat(F.lit("F"), F.col("id") % 3).alias("framework"), F.lit("r").alias("rule"),
        F.array(F.lit("CVV")).alias("entity_types"), F.lit("d").alias("description"), F.lit("High").alias("risk"),
    )
    one = spark.createDataFrame([(1, ["CVV"])], "doc_id BIGINT, entity_types ARRAY<STRING>")
    assert comply.exposure_table(one, many, k=rl.MAX_RULES + 100).count() == 3


def test_rule_vectors_are_made_written_and_read(spark, type_sets, tmp_path):
    rules = rl.rules_source(spark)
    path = str(tmp_path / "vectors")
    rl.write_rule_vectors(rl.rule_vectors(rules), path)
    vectors = rl.read_rule_vectors(spark, path)
    lengths = vectors.groupBy("rule_id").agg(F.sum(F.col("rw") * F.col("rw")).alias("n")).collect()
    assert len(lengths) == 18 and all(abs(r.n - 1) < 1e-9 for r in lengths)
    documents = rl.rule_documents(rules).select(F.col("id").alias("rule_id"), "document")
    sets = type_sets.filter(F.size("entity_types") > 0)
    queries = comply.query_text(sets).select(F.col("doc_id").alias("query_id"), F.col("query_text").alias("text"))
    fresh = comply.term_cosine_topk(queries, documents, 5)
    assert sorted(comply.term_cosine_topk(queries, documents, 5, vectors).collect()) == sorted(fresh.collect())


def test_sets_of_a_rule_table_are_made_once(spark, type_sets):
    """Sets come from a search of whole texts, so the plan must not hold it twice."""
    sets = type_sets.withColumn("entity_types", F.expr("reverse(reverse(entity_types))"))
    rules = rl.rules_source(spark)
    for done in (comply.exposure_table(sets, rules, 18), comply.retrieve_table(sets, rules)):
        assert "reverse(" not in done._jdf.queryExecution().optimizedPlan().toString()
        assert done.count() > 0
