"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canonical
from workload import oracle
from workload.fixtures import TABLES
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(oracle.out) & set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "total"] and df.count() == 1500


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    mine = sorted(tuple(canonical(r[c]) for c in order) for r in frame.collect())
    at = [columns.index(c) for c in order]
    theirs = sorted(tuple(canonical(r[i]) for i in at) for r in cursor.fetchall())
    assert mine == theirs and mine


def test_rows_that_become_texts_are_dealt_out_by_size(spark, monkeypatch):
    """Not by the row groups of their files, which may be few."""
    from workload import queries as wq

    monkeypatch.setattr(wq, "TASK_BYTES", 1 << 10)
    rows = spark.read.parquet(f"{FOLDER}/orders.parquet")
    assert wq.spread(rows).rdd.getNumPartitions() >= 30


def test_rows_of_a_large_join_are_dealt_out_by_size_too(spark, monkeypatch):
    """Not by what a join by shuffle leaves, however many rows its keys have."""
    from workload import queries as wq

    monkeypatch.setattr(wq, "TASK_BYTES", 1 << 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (wq.memo, wq.dossier):
            rows = table(spark, FOLDER)
            sizes = rows.rdd.glom().map(len).collect()
            wanted = -(-wq.estimated(spark.read.parquet(f"{FOLDER}/{'orders' if table is wq.memo else 'customer'}.parquet")) // 1024)
            assert len(sizes) >= wanted and max(sizes) <= 2 * sum(sizes) / len(sizes) + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
