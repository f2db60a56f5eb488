"""Dictionaries of many and of long terms."""

import random
import re

from pyspark.sql import functions as F

from veilmark.functions.filters import filter_bits
from veilmark.operators import layers


def grams_of(docs, dictionary):
    """Runs of words that leave their row."""
    known = layers._terms(dictionary).where(F.array_join("words", " ") == F.col("term"))
    bits = min(layers.FILTER_BITS, filter_bits(3 * known.count()))
    bitmap, held, lengths = layers._filter(known, bits)
    return docs.select("doc_id", F.inline(F.expr(layers.let("_bf", bitmap, layers.grams_sql("text", lengths, held)))))


def long_terms(spark):
    many = spark.range(300_000).select(F.concat(F.lit("name"), "id", F.lit(" of place"), F.col("id") % 977).alias("term"))
    one = spark.createDataFrame([(" ".join(f"w{i}" for i in range(200)),), ("w0 w1 w2",), ("place7 name8",)], "term STRING")
    return many.unionByName(one).withColumn("entity_type", F.lit("PERSON"))


def test_many_terms_and_one_of_two_hundred_words(spark, docs):
    rng, terms = random.Random(1), long_terms(spark)
    plain = " ".join(rng.choice(["w0", "w1", "name", "of", "place", "other"]) + str(rng.randint(0, 9) or "") for _ in range(20_000))
    whole = " ".join(f"w{i}" for i in range(200))
    texts = [plain, f"x {whole} y", f"name12 of place12, name977 of place0 name978 of place7 name8", whole.replace("w9 ", "w9, ")]
    found = layers.find_dictionary(docs(*texts), terms).collect()
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in found if r.doc_id)
    want = [(1, 2, 2 + len(whole)), (1, 2, 10), (3, 0, 8)]
    want += [(2, m.start(), m.end()) for t in ("name12 of place12", "name977 of place0", "place7 name8") for m in re.finditer(t, texts[2])]
    assert got == sorted(want)
    assert all(texts[r.doc_id][r.span_start : r.span_end] == r.value for r in found)
    left = grams_of(docs(plain), terms).count()
    true = sum(r.doc_id == 0 for r in found)
    assert true <= left <= true + 200  # of 20,000 words


def test_runs_are_as_long_as_terms_with_their_first_word(spark, docs):
    """A long term does not make other first words open long runs."""
    sql = layers.grams_sql("text", [1, 3, 200], lambda t: f"held({t})")
    assert "array(1, 3, 200)" in sql and "held(concat(_n, ' ', _w0.value))" in sql
    terms = spark.createDataFrame([("a b", "X"), ("c", "X"), ("d " * 199 + "d", "X")], "term STRING, entity_type STRING")
    text = "a b c d a c b a b " * 50
    rows = layers.find_dictionary(docs(text), terms).collect()
    assert sum(r.value == "a b" for r in rows) == 100 and sum(r.value == "c" for r in rows) == 100 and len(rows) == 200


def test_no_terms(spark, docs):
    none = spark.createDataFrame([], "term STRING, entity_type STRING")
    assert layers.find_dictionary(docs("a b c", None, ""), none).collect() == []
