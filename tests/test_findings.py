import random

from pyspark.sql import functions as F

from samples import BANK, MEDICAL, STAFF, UNICODE
from veilmark.operators import findings as fd, layers, recognize as rc
from veilmark.schemas import MODEL_HITS

SPAN = "struct<st:int,neg:double,ord:int,en:int,sc:double>"


def by_hand(spans):
    """The overlap scan, as a loop over (start, end, score)."""
    kept, last_end = [], -1
    for st, en, sc in sorted(spans, key=lambda s: (s[0], -s[2])):
        if st >= last_end:
            kept.append((st, en, sc))
            last_end = en
        elif sc > kept[-1][2]:
            kept[-1] = (st, en, sc)
    return kept


def random_spans(rng, n, width):
    out = []
    for _ in range(n):
        st = rng.randrange(width)
        out.append((st, st + 1 + rng.randrange(12), rng.choice([0.5, 0.6, 0.85, 1.0])))
    return out


def cases():
    rng = random.Random(1)
    small = [random_spans(rng, rng.randrange(0, 14), 40) for _ in range(500)]
    # Longer than a block of the fold, dense and sparse.
    return small + [random_spans(rng, n, w) for n in (255, 256, 257, 900) for w in (300, 9000)]


def test_overlap_scan_in_row_equals_a_loop(spark):
    spans = cases()
    rows = [
        (i, [(st, -sc, k, en, sc) for k, (st, en, sc) in enumerate(case)])
        for i, case in enumerate(spans)
    ]
    df = spark.createDataFrame(rows, f"i INT, hits array<{SPAN}>")
    got = df.select("i", F.expr(fd.resolve_hits("hits", SPAN)).alias("kept")).collect()
    assert {r.i: [(h.st, h.en, h.sc) for h in r.kept] for r in got} == {
        i: by_hand(case) for i, case in enumerate(spans)
    }


def test_hits_that_only_touch_are_taken_without_the_scan(spark):
    cases = [[(0, 3, 1.0), (3, 5, 0.5), (7, 9, 0.6)], [(0, 3, 0.5), (2, 5, 1.0), (5, 6, 0.5)], [(4, 6, 0.5)], []]
    rows = [(i, [(st, -sc, k, en, sc) for k, (st, en, sc) in enumerate(case)][::-1]) for i, case in enumerate(cases)]
    # A hit without a place is no plain case.
    rows += [(9, [(None, -1.0, 0, None, 1.0), (2, -0.5, 1, 4, 0.5), (3, -0.5, 2, 6, 0.5)])]
    scanned = fd.resolve_hits("hits", SPAN)
    df = spark.createDataFrame(rows, f"i INT, hits array<{SPAN}>").select("i", F.expr(scanned).alias("kept"))
    got = {r.i: [(h.st, h.en, h.sc) for h in r.kept] for r in df.collect()}
    assert {i: got[i] for i in range(4)} == {i: by_hand(case) for i, case in enumerate(cases)} and got[9] == [(2, 4, 0.5)]
    assert "THEN _so ELSE" in scanned


def test_recognizers_without_a_check_look_at_none():
    """A long CASE finds each branch anew, from the first one on."""
    assert "WHEN 13 THEN" not in rc._checked("_h", rc.ALL_LAYERS) and rc._checked("_h", rc.LABEL_LAYER) == "true"


def test_overlap_scan_on_a_table_equals_a_loop(spark):
    spans = cases()
    rows = [(i, k, *s) for i, case in enumerate(spans) for k, s in enumerate(case)]
    df = spark.createDataFrame(
        rows, "doc_id INT, ord INT, span_start INT, span_end INT, score DOUBLE"
    )
    got = {}
    for r in fd.resolve_overlaps(df).collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end, r.score))
    assert {i: sorted(v) for i, v in got.items()} == {
        i: by_hand(case) for i, case in enumerate(spans) if case
    }


def test_a_winner_does_not_move_the_end(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 5, 0.5), (1, 1, 3, 9, 1.0), (1, 2, 6, 8, 0.7)],
        "doc_id INT, ord INT, span_start INT, span_end INT, score DOUBLE",
    )
    kept = sorted((r.span_start, r.span_end) for r in fd.resolve_overlaps(df).collect())
    assert kept == [(3, 9), (6, 8)]


def test_copies_of_one_hit_collapse_before_they_are_gathered(spark):
    copies = spark.range(200_000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.lit(3).alias("span_start"),
        F.lit(9).alias("span_end"), F.lit(1.0).alias("score"),
    )
    rows = fd.resolve_overlaps(copies).collect()
    assert [(r.ord, r.span_start) for r in rows] == [(0, 3)]


def test_categories(spark):
    df = spark.createDataFrame([("Salary",), ("PERSON",), ("person",), ("MRN",), ("CVV",)], "entity_type STRING")
    got = {r.entity_type: (r.category, r.risk) for r in fd.categorize(df).collect()}
    assert got == {
        # The lower-cased name is listed for the first, the name as it is for the
        # second and last; a name listed only in upper case is unknown in lower.
        "Salary": ("PII", "High"), "PERSON": ("PII", "High"), "person": ("Other", "Medium"),
        "MRN": ("Other", "Medium"), "CVV": ("Financial", "High"),
    }
    reason = fd.categorize(df).filter("entity_type = 'MRN'").first().reason
    assert reason.endswith("MRN")


def test_denylist_takes_whole_values_and_all_blanks(spark):
    df = spark.createDataFrame([(" Docker\n",), ("Docker Inc",), ("RANDOM forest",)], "value STRING")
    assert [r.value for r in fd.drop_denylisted(df).collect()] == ["Docker Inc"]


def test_summaries_agree_and_an_empty_document_is_low(docs):
    table = docs(MEDICAL, STAFF, BANK, UNICODE, "nothing", "")
    in_row = {r.doc_id: r for r in fd.summarize(fd.with_findings(table)).collect()}
    joined = {r.doc_id: r for r in fd.summarize_table(table, fd.detect(table)).collect()}
    assert in_row == joined
    assert in_row[4].total == 0 and in_row[4].overall_risk == "Low"
    assert in_row[4].categories == {"PII": 0, "PHI": 0, "Financial": 0, "Other": 0}
    assert in_row[0].overall_risk == "High"


def test_detect_with_a_table_layer_equals_detect_in_row(spark, docs):
    table = docs(MEDICAL, STAFF, BANK, UNICODE)
    none = spark.createDataFrame([], "term STRING, entity_type STRING")
    with_table = fd.detect(table, more=[layers.find_dictionary(table, none)])
    columns = ["doc_id", "span_start", "span_end", "entity_type", "score", "source"]
    assert sorted(map(tuple, with_table.select(columns).collect())) == sorted(
        map(tuple, fd.detect(table).select(columns).collect())
    )


def test_dictionary_finds_whole_words_once_per_place(spark, docs):
    terms = spark.createDataFrame(
        [("New York", "LOCATION"), ("York", "PERSON"), ("Docker", "PERSON"), ("Anna Maria Li", "PERSON")],
        "term STRING, entity_type STRING",
    )
    text = "\U0001F600 New York, Yorkshire; new York Anna Maria Li. Docker New\nYork"
    rows = layers.find_dictionary(docs(text), terms).collect()
    got = sorted((r.span_start, r.value) for r in rows)
    assert got == sorted(
        [(2, "New York"), (6, "York"), (27, "York"), (32, "Anna Maria Li"), (47, "Docker"), (58, "York")]
    )
    assert all(text[r.span_start:r.span_end] == r.value for r in rows)
    kept = fd.detect(docs(text), more=[layers.find_dictionary(docs(text), terms)])
    assert sorted((r.span_start, r.value) for r in kept.collect()) == [
        (2, "New York"), (27, "York"), (32, "Anna Maria Li"), (58, "York"),
    ]


def test_dictionary_terms_of_any_length_and_sign(spark, docs):
    terms = spark.createDataFrame(
        [("United States of America", "LOCATION"), ("Sean O'Brien", "PERSON"), ("New York", "LOCATION"),
         ("New York Times", "PERSON"), ("AT&T", "PERSON"), ("two  blanks", "PERSON"), (None, "PERSON")],
        "term STRING, entity_type STRING",
    )
    text = docs("Sean O'Brien of the United States of America reads the New York Times")
    rows = layers.find_dictionary(text, terms)
    assert {r.value for r in rows.collect()} == {"Sean O'Brien", "United States of America", "New York", "New York Times"}
    assert {r.source for r in rows.collect()} == {"rules"}
    kept = fd.detect(text, more=[rows])
    assert [r.value for r in kept.orderBy("span_start").collect()] == ["Sean O'Brien", "United States of America", "New York Times"]
    assert {r.term for r in layers.unmatchable_terms(terms).collect()} == {"AT&T", "two  blanks", None}


def test_layers_go_rules_labels_regex(spark, docs):
    hits = spark.createDataFrame([(0, 0, "national id", 0, 10, "ABCDE1234F", 1.0)], MODEL_HITS)
    row = fd.detect(docs("ABCDE1234F"), more=[layers.external_findings(hits)]).first()
    assert row.entity_type == "national_id" and row.source == "ner"


def test_chunks_rebase_to_the_document(docs):
    text = "".join(chr(97 + i % 26) for i in range(4500)) + "\U0001F600é"
    rows = layers.chunk_text(docs(text, "", "x" * 2000)).orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, r.chunk, r.chunk_start, len(r.chunk_text)) for r in rows] == [
        (0, 0, 0, 2000), (0, 1, 2000, 2000), (0, 2, 4000, 502), (2, 0, 0, 2000),
    ]
    assert "".join(r.chunk_text for r in rows if r.doc_id == 0) == text


def test_model_hits_become_findings(spark):
    hits = spark.createDataFrame(
        [
            (1, 0, "patient name", 5, 9, "Anna", 0.9),
            (1, 2, "salary", 10, 15, "$1000", 0.5),
            (1, 0, "treatment", 0, 3, "abc", 0.49),
            (1, 0, "salary", 4, 4, "", 0.9),
            (1, 1, "shoe size", 0, 2, "44", 0.9),
        ],
        MODEL_HITS,
    )
    rows = layers.external_findings(hits).collect()
    assert sorted((r.entity_type, r.span_start, r.span_end, r.category) for r in rows) == [
        ("patient_name", 5, 9, "PHI"), ("salary", 4010, 4015, "PII"), ("shoe_size", 2000, 2002, "Other"),
    ]


def test_corpus_summary_adds_up(docs):
    table = fd.detect(docs(MEDICAL, STAFF, BANK))
    rows = fd.corpus_summary(table).collect()
    total = [r for r in rows if r.category is None][0].total
    assert total == table.count() == sum(r.total for r in rows if r.entity_type)


def test_regex_layer_has_rank_order():
    assert [r.entity_type for r in rc.REGEX_LAYER][:2] == ["AADHAAR", "PAN"]
