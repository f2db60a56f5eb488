"""Spelling variants, Merkle manifest and exact duplicates, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilmark.llm import exact, merkle, queries, spelling

FOLDER = "/root/testdata/sf0.001"


# ---- spelling --------------------------------------------------------------
def brute_words(rows, slip=spelling.SLIP):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def mangled(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcéÿ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def some_texts(seed, count=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 14))) for _ in range(60)]
    words = stems + [mangled(rng, w) for w in stems for _ in range(3)]
    words += [mangled(rng, w) for w in words] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "a" * 3000, "a" * 2999 + "b"]
    weights = [1 / (1 + k) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(count)]
    texts[0] = " ".join(["a" * 3000, "A" * 2999 + "b"] * 6)
    return list(enumerate(texts)) + [(None, texts[1]), (5, None), (5, ""), (7, texts[2]), (7, texts[2])]


@pytest.mark.parametrize("tile", [spelling.TILE, 3])
def test_variants_equal_brute_force(spark, tile):
    """Small tiles deal nearly every key out to several blocks."""
    rows = some_texts(3)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    words = spelling.count_words(docs, slip=19)
    expected = brute_words(rows, slip=19)
    assert dict(rows_of(words, "word", "n")) == expected
    near = spelling.near_words(words, tile=tile)
    brute = {w: n for w, _, _, _, n, _ in brute_variants(expected) if n}
    assert dict(rows_of(near, "word", "n_near")) == brute
    if tile == spelling.TILE:
        assert rows_of(spelling.variants(docs, slip=19), *COLUMNS) == sorted(
            brute_variants(expected), key=lambda r: r[0]
        )


def test_variants_under_other_names_and_without_rows(spark):
    rows = [(i, "Banana banana bananna") for i in range(9)]
    docs = spark.createDataFrame(rows, "id INT, body STRING").selectExpr("id", "body", "1 AS word", "2 AS n", "3 AS key")
    found = rows_of(spelling.variants(docs, id_col="id", text_col="body", slip=10**9), *COLUMNS)
    assert found == [("banana", None, "banana", 18, 1, None), ("bananna", None, "bananna", 9, 1, None)]
    assert spelling.variants(docs.where("false"), id_col="id", text_col="body").collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word STRING, form STRING")
    assert {r.root for r in spelling.roots_of(chain).collect()} == {"w13"}


# ---- Merkle manifest -------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[k : k + 2]) for k in range(0, len(row), 2)])
    return levels


def siblings(levels, at):
    out = []
    for row in levels[:-1]:
        other = at ^ 1
        out.append(row[other] if other < len(row) else "")
        at //= 2
    return out


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row, h(*map(framed, row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (order(x[0][0]), x[1]))
        trees[g] = brute_tree([leaf for _, leaf in groups[g]])
    top = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (row, leaf) in enumerate(groups[g]):
            way = siblings(trees[g], at) + siblings(top, k)
            i, source, lang, n, text = row
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None:
                n += 1
            folded = h(*map(framed, (i, source, lang, n, text)))
            place = [(at >> j) % 2 for j in range(len(trees[g]) - 1)] + [(k >> j) % 2 for j in range(len(top) - 1)]
            for right, s in zip(place, way):
                folded = h(s, folded) if right else h(folded, s)
            root = top[-1][0]
            out.append((i, leaf, trees[g][-1][0], root, h(*way), folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def manifest(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("c0", F.lit(2)).write.parquet(
        f"{tmp_path}/{name}/documents.parquet"
    )
    return queries.QUERIES["op12_merkle"](spark, f"{tmp_path}/{name}")


def manifest_cases():
    rng = random.Random(5)

    def row(i, lang):
        return (i, rng.choice(["a", None]), lang, rng.choice([3, None]), rng.choice(["", None, "é x", "long " * 50]))

    yield "one", [row(7, "en")]
    yield "lone groups", [row(i, lang) for i, lang in enumerate(["b", None, "é", "", "a"])]
    yield "one group", [row(i, "en") for i in range(700)]
    many = [row(i, rng.choice([None, "en", "en", "en", "z", "Z", "ä"])) for i in range(900)]
    yield "mixed", many + [row(None, "en"), row(None, None), row(5, "en"), row(5, "en"), many[3], many[3]]


@pytest.mark.parametrize("name, rows", list(manifest_cases()))
def test_manifest_equals_brute_force(spark, tmp_path, name, rows):
    found = manifest(spark, rows, tmp_path, name)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert found.columns == list(columns)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest(spark, [], tmp_path, "none").collect() == []


# ---- exact duplicates ------------------------------------------------------
def brute_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def copies(seed):
    rng = random.Random(seed)
    blanks = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c \n"]
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 30))] for _ in range(150)]
    texts = [rng.choice(blanks).join(rng.choice(bases[: rng.choice([1, 20, 150])])) for _ in range(600)]
    texts += ["", None, " ", " ", " ", "long " * 100_000, "long\n" * 100_000, "Ünï", "Ünï"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "alone"), (None, "twice"), (None, "twice"), (None, texts[0]), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("bits, capacity", [(64, 2048), (64, 1), (64, 20), (5, 2), (3, 1000)])
def test_copies_equal_brute_force(spark, bits, capacity):
    """Few bits make many texts share a key; a small capacity makes the directory double."""
    rows = copies(11)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS key", "2 AS n", "3 AS norm")
    found = exact.exact_duplicates(docs, capacity=capacity, bits=bits).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_copies(rows)


@pytest.mark.parametrize("limit", [0])
def test_copies_without_broadcasts(spark, monkeypatch, limit):
    """What is too large to be broadcast, and chains that are looked up apart."""
    monkeypatch.setattr(exact, "BROADCAST", limit)
    monkeypatch.setattr(exact, "HOT", 20)
    rows = copies(12)
    docs = spark.createDataFrame(rows, "id BIGINT, body STRING")
    found = exact.exact_duplicates(docs, capacity=30, id_col="id", text_col="body").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_copies(rows)


def test_copies_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id STRING, text STRING")
    assert exact.exact_duplicates(none).collect() == []


def test_buckets_split_until_none_is_too_full(spark):
    records = spark.range(5000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("key"))
    index = exact.build_index(records, capacity=100)
    held = index.entries.groupBy("bucket").count().collect()
    assert sum(r["count"] for r in held) == 5000 and max(r["count"] for r in held) <= 100
    slots = index.directory.collect()
    assert sorted(r.slot for r in slots) == list(range(1 << index.depth))
    assert {r.bucket: r.n for r in slots if r.n} == {r.bucket: r["count"] for r in held}
    # A bucket of local depth d is pointed to by 2^(depth - d) neighbouring slots.
    for bucket, found in Counter(r.bucket for r in slots).items():
        (local,) = {r.depth for r in slots if r.bucket == bucket}
        assert found == 1 << (index.depth - local)
    # Owners hold ranges of keys.
    spans = index.entries.groupBy("owner").agg(
        F.min(F.shiftrightunsigned("key", 1)).alias("low"), F.max(F.shiftrightunsigned("key", 1)).alias("high")
    ).orderBy("owner").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))


def test_exact_plan_is_native(spark):
    plan = queries.QUERIES["op13_exact"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
