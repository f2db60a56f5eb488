"""The index of dense vectors against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators import vectors
from veilmark.operators.comply import cosine_topk

FOLDER = "/root/testdata/sf0.01"


def as_rows(frame):
    return sorted((r.query_id, r["rank"], r.id, r.relevance) for r in frame.collect())


def clustered(spark, n=1500, seed=4):
    """Ten tight groups, one with a third of all, some vectors without length, copies, nulls."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(10)]
    rows = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else i % 10]
        rows.append((i, [x + rng.gauss(0, 0.15) for x in c]))
    rows += [(n, [0.0] * 12), (n + 1, [0.0] * 12), (n + 2, rows[0][1]), (n + 3, rows[0][1]), (n + 4, None)]
    return spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>")


def test_exact_search_equals_all_pairs(spark):
    rows = clustered(spark)
    index = vectors.build(rows, cells=20, block_rows=100)
    asked = rows.where("id % 25 = 0 AND vec IS NOT NULL").withColumnRenamed("id", "query_id")
    true = as_rows(cosine_topk(asked, rows.where("vec IS NOT NULL"), 7))
    assert as_rows(vectors.search(index, asked, 7, probes=1, exact=True)) == true
    assert as_rows(vectors.search(index, asked, 7, probes=1000)) == true
    assert index.rows.count() == rows.count() - 1
    assert index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 200


def test_bounds_leave_most_cells_of_tight_groups_out(spark):
    rows = clustered(spark)
    index = vectors.build(rows, cells=20)
    asked = vectors.prepared(rows.where("id < 50").withColumnRenamed("id", "query_id"), "query_id")
    near = vectors._open_cells(index, asked.withColumn("limit", F.lit(0.05)))
    assert near.count() < 0.5 * 50 * index.centres.count()


@pytest.mark.parametrize("exact", [False, True])
def test_a_query_without_length_meets_everything(spark, exact):
    rows = clustered(spark)
    index = vectors.build(rows, cells=20)
    asked = spark.createDataFrame([(1, [0.0] * 12)], "query_id INT, vec ARRAY<DOUBLE>")
    found = as_rows(vectors.search(index, asked, 3, probes=1, exact=exact))
    assert found == [(1, 1, 0, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0)]


def test_many_queries_of_one_cell_meet_copies_of_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COPY_QUERIES", 10)
    rows = clustered(spark, 600)
    index = vectors.build(rows, cells=5, block_rows=50)
    asked = rows.where("vec IS NOT NULL").withColumnRenamed("id", "query_id")
    assert as_rows(vectors.search(index, asked, 4, probes=5)) == as_rows(cosine_topk(asked, rows.where("vec IS NOT NULL"), 4))


def test_recall_is_measured_and_reached(spark):
    """Vectors without any structure, the hardest case, and grouped ones, which need few cells."""
    random_rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    for rows, most in ((random_rows, 22), (clustered(spark), 6)):
        index = vectors.calibrated(vectors.build(rows), 5)
        asked = rows.where("id % 50 = 0 AND vec IS NOT NULL").withColumnRenamed("id", "query_id")
        true = cosine_topk(asked, rows.where("vec IS NOT NULL"), 5)
        recall = vectors.recall_of(vectors.search(index, asked, 5), true).first().recall
        assert recall >= 0.9, recall
        assert 1 <= index.probes <= most


def test_empty_and_lone_collections(spark):
    none = spark.createDataFrame([], "id INT, vec ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id INT, vec ARRAY<DOUBLE>")
    assert vectors.search(vectors.build(none), asked, 3).collect() == []
    assert vectors.search(vectors.build(none), asked, 3, exact=True).collect() == []
    one = spark.createDataFrame([(5, [2.0, 4.0])], "id INT, vec ARRAY<DOUBLE>")
    assert as_rows(vectors.search(vectors.build(one), asked, 3)) == [(1, 1, 5, 1.0)]


def test_nearest_of_a_group_takes_odd_vectors_and_copies():
    """Held against sums one by one: copies, no length, no vector, other widths, not finite."""
    import numpy as np
    import pyarrow as pa

    from veilmark.operators import nearest as nr

    rng = np.random.default_rng(3)
    rows = [list(map(float, v)) for v in rng.normal(size=(40, 5))]
    rows += [rows[0]] * 9 + [[0.0] * 5, None]

    def table(key, vecs):
        norms = [None if v is None else math.fsum(x * x for x in v) ** 0.5 for v in vecs]
        kind = pa.list_(pa.float64())
        return pa.table({key: list(range(len(vecs), 0, -1)), "vec": pa.array(vecs, kind), "norm": pa.array(norms, pa.float64())})

    def brute(asked, known):
        order = known.sort_by("id")
        return [(asked["query_id"][q].as_py(), d, order["id"][c].as_py()) for q, c, d in nr._one_by_one(asked, order, 6, 9)]

    for extra in ([], [[1.0, 2.0]], [[math.nan] * 5]):
        asked, known = table("query_id", rows[35:] + extra), table("id", rows + extra)
        mine = [(r["query_id"], r["distance"], r["id"]) for r in nr.nearest(asked, known, 6, 9).to_pylist()]
        assert repr(mine) == repr(brute(asked, known)) and len(mine) == 6 * len(asked)
    assert len(nr.nearest(table("query_id", []), table("id", rows), 6, 9)) == 0
    assert list(nr.rounded(np.array([0.5e-9, -0.5e-9, 1.5e-9, 1.2e-9]), 9)) == [1e-9, -1e-9, 2e-9, 1e-9]
