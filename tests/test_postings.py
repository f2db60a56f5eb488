"""Bounded top-k against the sum of all products."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmark.operators import postings
from veilmark.operators.comply import term_cosine_topk
from veilmark.session import stored
from veilmark.sources.rules import term_vectors


def corpus(spark, seed, n=400):
    """A few terms in nearly every document, many rare ones, and copies, so that scores tie."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(500)]
    texts = []
    for _ in range(n):
        words = [w for w in common for _ in range(rng.randint(0, 3))] + rng.choices(rare, k=rng.randint(1, 6))
        rng.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20]
    docs = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "rule_id STRING, document STRING")
    asked = [(i, " ".join(rng.choices(common, k=4) + rng.choices(rare, k=3))) for i in range(30)]
    asked += [(90, "nowhere"), (91, ""), (92, "c0"), (93, "c0 " * 50), (94, texts[3]), (95, "r7 nowhere")]
    return docs, spark.createDataFrame(asked, "query_id INT, text STRING")


def as_rows(frame):
    return sorted((r.query_id, r["rank"], r.rule_id, r.relevance) for r in frame.collect())


@pytest.mark.parametrize("k, limit", [(1, "10m"), (5, "10m"), (5, "-1"), (1000, "10m")])
def test_the_rows_are_those_of_all_products(spark, k, limit):
    docs, asked = corpus(spark, k)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = as_rows(postings.bounded_topk(asked, docs, k))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == as_rows(term_cosine_topk(asked, docs, k))


def test_common_terms_are_left_out(spark):
    """Documents that share only common terms with a query are never summed up."""
    docs, asked = corpus(spark, 9, 2000)
    asked = asked.where("query_id < 30")
    terms = stored(term_vectors(docs), "postings")
    weighed = postings.weighed_queries(asked, terms).cache()
    all_products = weighed.select(F.explode("weighted").alias("t")).agg(F.sum("t.df")).first()[0]
    true = term_cosine_topk(asked, docs, 5).groupBy("query_id").agg(F.min("relevance").alias("least"))
    reach = weighed.join(true.withColumn("least", F.col("least") - 0.001), "query_id")
    needed = postings.needed_terms(reach).select(F.explode("needed").alias("t"))
    products = needed.agg(F.sum("t.df")).first()[0]
    # Six terms are in most of the 2,020 documents; the rare ones are in a dozen each.
    assert products < 0.25 * all_products
    left = postings.candidates(reach, terms)
    assert left.groupBy("query_id").count().agg(F.max("count")).first()[0] < 120
    weighed.unpersist()


def test_nothing_to_compare(spark):
    docs, asked = corpus(spark, 2, 20)
    assert postings.bounded_topk(asked.where("false"), docs, 3).collect() == []
    assert postings.bounded_topk(asked, docs.where("false"), 3).collect() == []


def test_many_blocks_give_the_same_rows(spark, monkeypatch):
    docs, asked = corpus(spark, 4)
    expected = as_rows(term_cosine_topk(asked, docs, 5))
    monkeypatch.setattr(postings, "BLOCK_TERMS", 100)
    monkeypatch.setattr(postings, "BLOCK_QUERIES", 7)
    assert as_rows(postings.bounded_topk(asked, docs, 5)) == expected


def test_products_are_not_shuffled(spark):
    """Vectors meet in blocks: no join puts a row for each product into a shuffle."""
    docs, asked = corpus(spark, 6, 100)
    terms = stored(term_vectors(docs), "postings")
    reach = stored(postings.weighed_queries(asked, terms).withColumn("least", F.lit(0.1)), "asked")
    plan = postings.candidates(reach, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_only_documents_that_reach_the_score_are_scored_in_full(spark):
    """Bounds of many words that nearly all texts share leave most documents open; sums of all their
    products leave those that come up to the score."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=40) + [f"r{rng.randrange(200)}"]) for _ in range(600)]
    docs = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "rule_id STRING, document STRING")
    asked = spark.createDataFrame(list(enumerate(texts[:20])), "query_id INT, text STRING")
    terms = stored(term_vectors(docs), "postings")
    weighed = stored(postings.weighed_queries(asked, terms), "weighed")
    true = term_cosine_topk(asked, docs, 5)
    reach = weighed.join(true.groupBy("query_id").agg((F.min("relevance") - 0.001).alias("least")), "query_id")
    found = postings.candidates(reach, terms).join(reach.select("query_id", "least"), "query_id").collect()
    assert all(r.score >= r.least - 0.001 for r in found)
    assert {(r.query_id, r.rule_id) for r in true.collect()} <= {(r.query_id, r.rule_id) for r in found}


@pytest.mark.parametrize("k, least, batch, columns", [(5, 0.0, 64, 16), (3, None, 1, 0), (None, None, 10_000, 10_000), (1, 0.0, 3, 2)])
def test_a_block_against_all_its_products(monkeypatch, k, least, batch, columns):
    """Whatever words are common, and however many queries and documents are looked at together."""
    monkeypatch.setattr(postings, "SUMS", batch * 150)
    monkeypatch.setattr(postings, "COMMON", columns * 150)
    monkeypatch.setattr(postings, "FULL", 7)
    rng = random.Random(repr((k, batch)))
    words = [f"c{i}" for i in range(8)] + [f"r{i}" for i in range(60)]
    vectors = [{w: rng.random() for w in rng.sample(words[:8], 4) + rng.sample(words[8:], 3)} for _ in range(150)]
    vectors[20:40] = [vectors[5]] * 20
    asked = [{w: 9 * rng.random() for w in rng.sample(words[:8], 3) + rng.sample(words[8:], 4)} for _ in range(25)]
    asked += [{"nowhere": 1.0}, dict(vectors[5]), {"nowhere": 2.0, "c1": 0.5}]
    norms = [sum(x * x for x in q.values()) ** 0.5 for q in asked]
    scores = [[sum(x * v.get(w, 0.0) for w, x in q.items()) / n for v in vectors] for q, n in zip(asked, norms)]
    leasts = [sorted(s)[-9] if least is None else least for s in scores]
    tops = {w: max(v.get(w, 0.0) for v in vectors) for w in [*words, "nowhere"]}
    needed = []
    for q, low, n in zip(asked, leasts, norms):
        needed.append([])
        rest = 0.0
        for w, x in q.items():
            out = rest + x * tops[w] < low * n - 1e-7
            rest += x * tops[w] if out else 0.0
            needed[-1] += [] if out else [w]
    assert (sum(map(len, needed)) < sum(map(len, asked))) == (least is None)
    queries = pa.table({
        "query_id": range(len(asked)), "norm": norms, "least": leasts, "terms": [list(q) for q in asked],
        "weights": [list(q.values()) for q in asked], "needed": pa.array(needed, pa.list_(pa.string())),
    })
    whole = [(f"d{i:03d}", list(v), list(v.values())) for i, v in enumerate(vectors)]
    # A vector may come in several rows.
    pieces = [(i, t[a:b], w[a:b]) for i, t, w in whole for a, b in ((0, 3), (3, 7))]
    for rows in (whole, pieces):
        ids, terms, weights = zip(*rows)
        table = pa.table({"rule_id": ids, "terms": terms, "weights": weights, "heavy": np.zeros(len(ids), bool)})
        found = postings._scored(queries, table, k).to_pylist()
        for q, s in enumerate(scores):
            mine = {r["rule_id"]: r["score"] for r in found if r["query_id"] == q}
            true = sorted((i for i in range(150) if s[i] > 0 and s[i] >= leasts[q]), key=lambda i: (-round(s[i], 9), i))[:k]
            assert {f"d{i:03d}" for i in true} <= set(mine)
            assert k is None or len(mine) <= k
            assert all(abs(x - s[int(d[1:])]) < 1e-12 for d, x in mine.items())
