"""Windows for an outside model that share some characters."""

import random
import re

import pytest

from veilmark.operators import layers
from veilmark.schemas import MODEL_HITS


def modelled(spark, docs, size, overlap, pattern):
    """What a model that knows one pattern says of each window, cut ones included."""
    rows = []
    for r in layers.chunk_text(docs, size, overlap).collect():
        for m in re.finditer(pattern, r.chunk_text):
            rows.append((r.doc_id, r.chunk, "salary", m.start(), m.end(), m.group(), 0.9 if m.end() < size else 0.6))
    return spark.createDataFrame(rows, MODEL_HITS)


@pytest.mark.parametrize("size, overlap", [(50, 12), (64, 63), (10_000, 500), (13, 12)])
def test_hits_across_an_edge_are_found_once(spark, docs, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["x", "é ", "#1234567890#", "\U0001F600", "#77#"]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts += ["", None, "#1234567890#"]
    table = docs(*texts)
    # Whole entities fit into what two windows share; cut ones are reported too.
    pattern = "#[0-9]+#|#[0-9]+$|^[0-9]+#"
    found = layers.external_findings(modelled(spark, table, size, overlap, pattern), size, overlap)
    got = sorted((r.doc_id, r.span_start, r.span_end, r.value) for r in found.collect())
    want = [(i, m.start(), m.end(), m.group()) for i, t in enumerate(texts) for m in re.finditer("#[0-9]+#", t or "")]
    assert got == want


def test_windows_cover_the_text(docs):
    text = "".join(chr(97 + i % 26) for i in range(9001))
    for size, overlap in ((2000, 0), (2000, 300), (5000, 4999 - 4000), (9001, 1), (20_000, 7)):
        rows = layers.chunk_text(docs(text, None, "", "ab"), size, overlap).orderBy("doc_id", "chunk").collect()
        own = [r for r in rows if r.doc_id == 0]
        assert all(r.chunk_text == text[r.chunk_start : r.chunk_start + size] for r in own)
        assert own[-1].chunk_start + len(own[-1].chunk_text) == len(text)
        assert all(b.chunk_start - a.chunk_start == size - overlap for a, b in zip(own, own[1:]))
        assert [r.chunk_text for r in rows if r.doc_id == 3] == ["ab"]
    with pytest.raises(ValueError, match="overlap"):
        layers.chunk_text(docs(text), 10, 10)


def test_hits_of_one_window_and_of_other_types_stay_apart(spark):
    rows = [
        (1, 0, "salary", 80, 100, "a" * 20, 0.9), (1, 1, "salary", 0, 30, "a" * 20 + "b" * 10, 0.7),
        (1, 0, "salary", 75, 90, "z" * 15, 0.8), (1, 1, "national id", 0, 10, "a" * 10, 0.9),
        (2, 1, "salary", 0, 20, "d" * 20, 0.95), (1, 2, "salary", 50, 60, "c" * 10, 0.9), (2, 0, "salary", 80, 100, "d" * 20, 0.9),
    ]
    hits = spark.createDataFrame(rows, MODEL_HITS)
    found = layers.external_findings(hits, 100, 20).orderBy("doc_id", "span_start", "entity_type").collect()
    got = [(r.doc_id, r.entity_type, r.span_start, r.span_end, r.score, len(r.value)) for r in found]
    assert (1, "salary", 75, 90, 0.8, 15) in got and (1, "national_id", 80, 90, 0.9, 10) in got
    assert (1, "salary", 80, 110, 0.9, 30) in got and (1, "salary", 210, 220, 0.9, 10) in got
    assert (2, "salary", 80, 100, 0.95, 20) in got and len(got) == 5
