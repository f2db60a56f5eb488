"""Operators that look across documents, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import corpus_pipeline
from veilmark.llm import lm, near_dedup, pii, quality, queries, warc

FOLDER = "/root/testdata/sf0.001"


# ---- near-duplicates -------------------------------------------------------
def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_classes(rows, percent):
    sets = [shingles(t) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(m for shingle in s for m in holders[shingle])
        for m, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[m]) - n):
                parent[root(k)] = root(m)
        for shingle in s:
            holders[shingle].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def edited(rng, words, vocabulary):
    words = list(words)
    for _ in range(rng.randint(0, 6)):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.7 and len(words) > 20:
            del words[at : at + rng.randint(1, 8)]
        elif kind < 0.8:
            words = words[at // 3 :]
        else:
            words[at:at] = [rng.choice(vocabulary) for _ in range(rng.randint(1, 4))]
    return words


@pytest.mark.parametrize("percent", [80, 85])
def test_classes_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 150, 300)]
    rows = []
    for i in range(500):
        kind = rng.random()
        if kind < 0.7:
            words = edited(rng, bases[min(rng.randint(0, 6), 2)], vocabulary)
        elif kind < 0.9 or not rows:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        else:
            words = edited(rng, rng.choice(rows)[1].split() or ["x"], vocabulary)
        rows.append((i, " ".join(words)))
    rows += [
        (900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One\tTWO "), (905, "one two three four five"),
        (None, rows[3][1]), (7, rows[7][1]), (906, "long " * 30_000), (907, "long " * 40_000), (908, "É b c d e"),
    ]
    docs = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in rows], "doc_id BIGINT, text STRING, n INT, node STRING"
    )
    found = near_dedup.near_duplicates(docs, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_classes(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = near_dedup.keep_first(docs, percent)
    assert kept.columns == docs.columns
    first = {c for i, _, c in brute_classes(rows, percent) if i == c}
    assert {r.doc_id for r in kept.collect()} - {None} == first


def test_a_large_group_of_near_copies_is_one_class_or_none(spark):
    """Copies of one text, each with its own edits: few are alike, most are like the text."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(150)] = f"e{i}_{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute_classes(rows, 85))


def test_no_documents_no_classes(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert near_dedup.near_duplicates(empty, 85).count() == 0


def test_posterior_bound_keeps_pairs_at_the_threshold():
    for k in (20, 60, 120):
        least = near_dedup.least_matches(k, 85)
        below = sum(math.comb(k, m) * 0.85**m * 0.15 ** (k - m) for m in range(least))
        assert below < 1e-4 and least > 0.3 * k


# ---- language model --------------------------------------------------------
def brute_scores(rows, size, least=2, alpha=0.4):
    texts = [(t or "").lower().split() for _, t in rows]
    counts = Counter(w for t in texts for w in t)
    steps = Counter(math.floor(math.log2(n) * 16) for n in counts.values())
    fits = [s for s in steps if sum(n for other, n in steps.items() if other >= s) <= size]
    top = [w for w, n in counts.items() if fits and math.floor(math.log2(n) * 16) >= min(fits)]
    number = {w: i for i, w in enumerate(top, 1)}
    texts = [[number.get(w, 0) for w in t] for t in texts]
    total, one = sum(map(len, texts)), Counter(w for t in texts for w in t)
    two = Counter(p for t in texts for p in zip(t, t[1:]))
    out = []
    for (i, _), t in zip(rows, texts):
        score = None
        if t:
            score = math.log10(one[t[0]] / total)
            for a, b in zip(t, t[1:]):
                score += math.log10(two[a, b] / one[a] if two[a, b] >= least else alpha * one[b] / total)
        out.append((i, len(t), None if score is None else round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, head", [(65536, 256), (30, 5), (65536, 3)])
def test_scores_equal_brute_force(spark, size, head):
    rng = random.Random(size + head)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(900, None), (901, " "), (None, "w1 w2"), (5, "w1 W2 w3"), (5, "w1 W2 w3"), (902, "w1 w2 " * 5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, gram INT")
    found = lm.score(docs, vocabulary=size, head=head).collect()
    got = sorted(((r.doc_id, r.n_words, None if r.log10_score is None else round(r.log10_score, 6)) for r in found), key=str)
    assert got == brute_scores(rows, size)
    assert lm.score(docs.limit(0)).count() == 0


def brute_open(rows, least=2, alpha=0.4):
    """Scores by counts of all words and all pairs, as they stand in the texts."""
    texts = [(t or "").lower().split() for _, t in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(one.values()), []
    for (i, _), t in zip(rows, texts):
        score = math.log10(one[t[0]] / total) if t else None
        for a, b in zip(t, t[1:]):
            score += math.log10(two[a, b] / one[a] if two[a, b] >= least else alpha * one[b] / total)
        out.append((i, len(t), None if score is None else round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranked, head, least", [(1 << 16, 256, 2), (20, 5, 2), (40, 3, 3), (0, 5, 2), (30, 5, 1)])
def test_scores_count_all_words(spark, ranked, head, least):
    rng = random.Random(ranked + head)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.03))}" for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(900, None), (None, "w1 w2"), (5, "w1 W2 w3"), (902, "w1 w2 " * 500), (903, "once twice once twice twice")]
    rows += [(904, f"{'x' * 70} {'y' * 70} w1"), (905, f"{'x' * 70} {'y' * 70} {'x' * 70}"), (906, "a1 b1 a1 b1 b1 a1")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, gram INT")
    found = lm.score(docs, head=head, least=least, ranked=ranked).collect()
    got = sorted(((r.doc_id, r.n_words, None if r.log10_score is None else round(r.log10_score, 6)) for r in found), key=str)
    assert got == brute_open(rows, least)


def test_words_of_nearly_equal_counts_are_all_known(spark):
    """More words in one step of counts than have a rank, and gibberish beside them."""
    rng = random.Random(3)
    words = [f"n{i}" for i in range(300)] * 4
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(30)] + [(99, " ".join(f"g{i}" for i in range(40)))]
    found = lm.score(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), ranked=100).collect()
    assert sorted((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in found) == sorted(brute_open(rows))
    assert min(found, key=lambda r: r.per_word).doc_id == 99


def test_entries_are_shuffled_packed(spark, monkeypatch):
    """A value for each bucket and block of texts, not a row for each pair of each text."""
    rng = np.random.default_rng(5)
    held = [(7 + i, np.sort(rng.integers(0, 1 << 34, 500)), np.zeros(500, int), np.ones(500, int)) for i in range(200)]
    held[3][1][:9], held[3][2][:9] = -rng.integers(1, 1 << 61, 9), -rng.integers(1, 1 << 61, 9)
    packed = pa.Table.from_batches([lm._packed(held, 8, pa.int64())])
    back = np.array(lm._unpacked(packed, lm._FIELDS))
    sent = np.concatenate([[k, g, np.full(500, row), n] for row, k, g, n in held], axis=1)
    assert sorted(back.T.tolist()) == sorted(sent.T.tolist()) and packed.num_rows == 8
    assert sum(len(v.as_py()) for v in packed["data"]) < 7 * 200 * 500

    monkeypatch.setattr(lm, "BUCKET_WORDS", 200)
    rows = [(i, " ".join(f"w{int(rng.exponential(30))}" for _ in range(int(rng.integers(0, 60))))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    found = lm.score(docs, ranked=20, head=5)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.doc_id, r.n_words, None if r.log10_score is None else round(r.log10_score, 6)) for r in found.collect()), key=str)
    assert got == brute_open(rows)


# ---- WARC ------------------------------------------------------------------
def test_pages_come_back(spark):
    same = "<html>" + "same " * 40 + "</html>"
    rows = [(i, f"http://x/{i}", f"<html>page {i} é" + "z" * (i % 7 * 50)) for i in range(300)]
    rows += [(500, "u", same), (400, "v\r\nw", same), (600, None, same), (700, "e", None), (701, "e", ""), (702, "s", "short"), (703, "s", "short")]
    rows += [(704, "big", "ab" * 300_000), (400, "v", same)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id BIGINT, url STRING, html STRING, payload STRING")
    found = warc.round_trip(pages).collect()
    assert len(found) == len(rows) and all(r.error is None for r in found)
    by_id = {r.page_id: r for r in found}
    for i, _, html in rows:
        data, r = (html or "").encode(), by_id[i]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else data)
    assert {i: (by_id[i].record_type, by_id[i].refers_to) for i in (400, 500, 600, 702, 703)} == {
        400: ("response", None), 500: ("revisit", 400), 600: ("revisit", 400), 702: ("response", None), 703: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_archives_are_reported():
    def one(i):
        data = f"<html>{i}</html>".encode() * 3
        return warc.record(i, "u", data, hashlib.sha256(data).hexdigest(), None)

    good = [one(i) for i in range(40)]
    bad_digest = warc.record(41, "u", b"x", "00", None)
    bad_length = one(42).replace(b"Content-Length: ", b"Content-Length: 9")
    data = warc.archive([*good, bad_digest, bad_length, b"no record", one(43)], warc.dictionary(good))
    rows = list(warc.read_archive(data))
    assert [e for *_, e in rows[40:]] == ["payload digest", "length of the body", "no end of headers", None]
    flipped = bytearray(data)
    flipped[rows[5][0] + 20] ^= 0xFF
    again = list(warc.read_archive(bytes(flipped)))
    assert again[5][2] and again[4][2] is None and again[-1][1][0] == 43
    assert list(warc.read_archive(data[:-3]))[-1][2] == "cut frame"
    assert list(warc.read_archive(b"")) == [] and list(warc.read_archive(b"\x00" * 9))[0][2]


def test_damaged_dictionaries_and_false_sizes_are_errors():
    data = b"<html>one</html>"
    records = [warc.record(i, "u", data, hashlib.sha256(data).hexdigest(), None) for i in range(2)]
    good = warc.archive(records, b"plain primer")
    damaged = struct.pack("<II", warc.DICTIONARY_MAGIC, 40) + struct.pack("<I", 0xEC30A437) + b"\xff" * 36 + good[20:]
    assert all(e for _, _, e in warc.read_archive(damaged)) and list(warc.read_archive(damaged))
    # A frame of one raw block that claims 2^61 bytes.
    claim = warc.FRAME_MAGIC + bytes([0xE0]) + (1 << 61).to_bytes(8, "little") + (1 | 5 << 3).to_bytes(3, "little") + b"abcde"
    rows = list(warc.read_archive(good + claim + good[20:]))
    assert [e is None for _, _, e in rows] == [True, True, False, True, True]


def test_missing_records_are_errors(spark):
    data = b"<html>one</html>"
    whole = warc.archive([warc.record(i, "u", data, hashlib.sha256(data).hexdigest(), None) for i in range(3)], b"")
    table = spark.createDataFrame([(3, whole), (4, whole)], "records INT, content BINARY")
    errors = [r.error for r in warc.read_archives(table, count_col="records").collect()]
    assert errors.count(None) == 6 and errors.count("3 of 4 records") == 1


def test_archives_are_read_from_files(spark, tmp_path):
    data = b"<html>one</html>"
    records = [warc.record(i, "u", data, hashlib.sha256(data).hexdigest(), None) for i in range(5)]
    primer = b"<html>one</html> WARC-Type response"
    packed = zstandard.ZstdCompressor().compress(primer)
    plain = warc.archive(records, primer)
    (tmp_path / "plain.warc.zst").write_bytes(plain)
    (tmp_path / "packed.warc.zst").write_bytes(
        struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + plain[8 + len(primer) :]
    )
    rows = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted(r.page_id for r in rows) == sorted([*range(5)] * 2) and all(r.error is None for r in rows)


# ---- queries and pipeline --------------------------------------------------
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_spelling"}))  # its rows are words
def test_query_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name == "op6_warc" else ("documents", "doc_id")
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    found = queries.QUERIES[name](spark, FOLDER)
    assert [r[0] for r in found.select(key).orderBy(key).collect()] == [r[0] for r in rows.select(key).orderBy(key).collect()]


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    verdict = {r.doc_id: r.kept for r in queries.QUERIES["op4_quality"](spark, FOLDER).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}

    unique = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert unique.columns == columns
    assert {r.doc_id for r in unique.collect()} == {i for i, _, c in brute_classes(rows, 80) if i == c}

    clean = corpus_pipeline.decontamination(spark, docs, FOLDER)
    hit = {r.doc_id for r in queries.QUERIES["op2_decontaminate"](spark, FOLDER).where("contaminated").collect()}
    assert hit and clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - hit

    masked = corpus_pipeline.personal_data(spark, docs, FOLDER).collect()
    assert len(masked) == len(rows) and all(r.n_chars == len(r.text) for r in masked)
    assert not any(pii.base_spans(r.text) for r in masked)
    before = {i: t for i, t in rows if not pii.base_spans(t)}
    assert sum(r.text == before[r.doc_id] for r in masked if r.doc_id in before) >= 0.99 * len(before)


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30, "en", "s", 5), (4, "one two " * 2, "en", "s", 5)]
    rows += [(i, " ".join(f"t{i}x{k}" for k in range(30)) + ".", "en", "s", 5) for i in range(5, 9)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this kind")], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == [5, 6, 7, 8]
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_judge_rows_not_ids(spark, tmp_path):
    """Repeated and null ids, clashing and further columns, and no rows at all."""
    words = [" ".join(f"t{i}x{k}" for k in range(40)) + "." for i in range(6)]
    item = " ".join(f"q{k}" for k in range(12))
    rows = [
        (1, words[0], "a"), (1, words[0], "b"), (2, words[0], "c"), (None, words[0], "d"), (3, words[1], "e"),
        (3, words[2] + " " + item, "f"), (None, words[3], "g"), (None, words[4] + " " + item, "h"), (None, words[5], "i"),
    ]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, rest STRING, row INT, hits INT"
    table = [(i, t, "en", "s", 5, x, 7, 8) for i, t, x in rows]
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("one", item)], "item_id STRING, text STRING").selectExpr("1 AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    once = corpus_pipeline.near_duplicates(spark, docs, d)
    left = sorted(r.rest for r in once.collect())
    assert once.columns == docs.columns and left in (list("aefghi"), list("befghi"))
    clean = corpus_pipeline.decontamination(spark, docs, d)
    assert clean.columns == docs.columns and sorted(r.rest for r in clean.collect()) == list("abcdegi")
    assert sorted(r.rest for r in corpus_pipeline.quality_rules(spark, docs, d).collect()) == list("abcdefghi")
    assert corpus_pipeline.run(spark, d).count() == 4
    renamed = docs.withColumnRenamed("text", "body").withColumn("text", pii.F.lit("jane@example.org"))
    assert quality.filter_documents(renamed, text_col="body").count() == 9
    assert {r.text for r in pii.mask_documents(renamed, None, text_col="body").collect()} == {"jane@example.org"}
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
