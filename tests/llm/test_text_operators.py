"""Operators that work text by text, against brute force and exact round trips."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veilmark.llm import bpe, decontaminate, langid, pii, quality, secrets, toxicity
from veilmark.llm.common import Spans
from veilmark.llm.queries import PATTERN, RANKS, bpe_digest

LONG = "word " * 40_000


@pytest.fixture
def table(spark):
    def make(rows, kinds="doc_id BIGINT, text STRING, score STRING, ids STRING, n_words INT"):
        """Texts with ids, and further columns whose names clash with those of results."""
        return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], kinds)

    return make


def edge(rows=()):
    return [*rows, (900, None), (901, ""), (902, " \n\t "), (903, LONG), (None, "no id"), (7, "again"), (7, "again")]


# ---- byte-level BPE --------------------------------------------------------
@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "22", "-", "---", " ", "\x1c", "中", "🙂",
    "ﬁ", "́", "a" * 50, " \n ", "\r\n", "_" * 20, "'re", "<|endoftext|>",
]


def made(rng, most=14):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


def test_bpe_gives_the_ids_of_the_public_library(encoding):
    rng, make = random.Random(1), bpe.encoder(RANKS, PATTERN).encode
    for _ in range(3000):
        text = made(rng)
        assert np.frombuffer(make(text), "<i4").tolist() == encoding.encode_ordinary(text)


def test_bpe_appends_and_edits_are_exact(encoding):
    rng = random.Random(2)
    for _ in range(2000):
        text, new = made(rng), made(rng, 4)
        start = rng.randint(0, len(text))
        stop = rng.randint(start, len(text))
        ids = encoding.encode_ordinary(text)
        changed = text[:start] + new + text[stop:]
        assert bpe.edit_text(text, ids, start, stop, new, RANKS, PATTERN) == encoding.encode_ordinary(changed)
        assert bpe.append_text(text, ids, new, RANKS, PATTERN) == encoding.encode_ordinary(text + new)


def test_every_prefix_of_a_piece_is_encoded():
    words = bpe.load(RANKS, PATTERN)
    data = b"antidisestablishmentarianism"
    piece = bpe.Piece(words, data[:5]).append(data[5:])
    for end in range(len(data) + 1):
        assert piece.ids(end) == words.merge(data[:end])
    assert piece.edit(4, 9, b"XYZ").ids() == words.merge(data[:4] + b"XYZ" + data[9:])


def test_neighbours_are_judged_as_by_merging_them():
    rng, words = random.Random(3), bpe.load(RANKS, PATTERN)
    tokens = [rng.randrange(len(words.bytes_of)) for _ in range(3000)]
    for left, right in zip(tokens, tokens[1:]):
        merged = words.merge(words.bytes_of[left] + words.bytes_of[right])
        assert words.follows(left, right) == (merged == [left, right])
        assert words.stands(left) == (words.merge(words.bytes_of[left]) == [left])


def test_edits_in_a_row_encode_only_what_is_near(encoding):
    rng = random.Random(4)
    known = bpe.Encoded("".join(made(rng, 30) for _ in range(200)), RANKS, PATTERN)
    for _ in range(500):
        start = rng.randint(0, len(known.text))
        stop = min(len(known.text), start + rng.randint(0, 9))
        encoded = known.edit(start, stop, made(rng, 4))
        assert known.ids() == encoding.encode_ordinary(known.text) and encoded <= 25
    assert known.append(" and more").__class__ is int and known.ids() == encoding.encode_ordinary(known.text)
    long = bpe.Encoded("some plain words " * 50_000, RANKS, PATTERN)
    assert long.edit(400_000, 400_004, "PLAIN") < 8


def test_a_small_table_of_words_changes_nothing(encoding):
    rng, small = random.Random(5), bpe.Encoder(bpe.load(RANKS, PATTERN), limit=2000)
    for _ in range(300):
        text = " ".join(made(rng, 3) for _ in range(40))
        assert np.frombuffer(small.encode(text), "<i4").tolist() == encoding.encode_ordinary(text)
        assert small.words.size < 2000 + 20_000


def test_bpe_digest_of_odd_rows(table, encoding):
    rows = edge([(1, "Hello  wörld\n"), (2, "x" * 3000), (3, "日本語 🙂")])
    got = sorted(map(tuple, bpe_digest(table(rows)).collect()), key=str)
    want = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((
            i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        ))
    assert got == sorted(want, key=str)
    assert bpe_digest(table([])).count() == 0
    coded = bpe.encode(table(rows), RANKS, PATTERN)
    assert coded.columns == ["doc_id", "ids"]
    both = bpe.decode(coded, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in both) == sorted((str(i), t or "") for i, t in rows)


# ---- decontamination -------------------------------------------------------
def brute_hits(text, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    doc, hit, ids = words(text), set(), set()
    for item, content in items:
        w = words(content)
        windows = [w[i : i + size] for i in range(len(w) - size + 1)] or ([w] if w else [])
        for window in windows:
            for at in range(len(doc) - len(window) + 1):
                if doc[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    ids.add(item)
    return len(doc), len(hit), ids


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_equals_brute_force(spark, table, block_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "the", "the"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 14, 30])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "--"), (93, items[0][1]), (94, "the " * 12)]
    rows = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = (rng.choice(items)[1] or "").split()
        rows.append((i, ", ".join(text).upper() if rng.random() < 0.2 else "; ".join(text)))
    rows = edge(rows)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, doc_id INT")
    found = decontaminate.contamination(table(rows), bench, block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(x.item_id for x in r["items"])) for r in found), key=str)
    want = []
    for i, text in rows:
        n, hits, ids = brute_hits(text, items)
        want.append((i, n, hits, sorted(ids)))
    assert got == sorted(want, key=str)
    assert all(0 < x.containment <= 1 for r in found for x in r["items"])


def test_whole_items_are_contained_in_full(spark, table):
    item = " ".join(f"q{i}" for i in range(25))
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    rows = [(1, f"before {item} after"), (2, " ".join(item.split()[:15])), (3, "nothing")]
    found = {r.doc_id: r["items"] for r in decontaminate.contamination(table(rows), bench).collect()}
    assert found[1][0].containment == 1 and found[2][0].containment == 6 / 16 and found[3] == []
    empty = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.contamination(table(rows), empty).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.contamination(table([]), bench).count() == 0


def test_item_ids_of_any_type_and_repeated(spark, table):
    words = [f"b{k}" for k in range(30)]
    items = [("x", " ".join(words[:12])), ("x", " ".join(words[15:26])), (None, " ".join(words[3:14])), ("y", "nothing here")]
    bench = spark.createDataFrame(items, "item_id STRING, text STRING")
    rows = [(1, " ".join(words)), (2, " ".join(words[15:26])), (3, "plain")]
    for block_bytes in (1 << 20, 20):
        found = decontaminate.contamination(table(rows), bench, block_bytes=block_bytes).collect()
        met = {r.doc_id: sorted((str(i.item_id) for i in r["items"])) for r in found}
        assert met == {1: ["None", "x"], 2: ["x"], 3: []}
    long = bench.selectExpr("cast(hash(item_id) AS decimal(20,0)) AS item_id", "text")
    kinds = decontaminate.contamination(table(rows), long).schema["items"].dataType.elementType["item_id"].dataType
    assert kinds.simpleString() == "decimal(20,0)"


# ---- quality ---------------------------------------------------------------
def brute_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeats = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


def test_quality_measures_equal_brute_force(table):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [rng.choice(["a", "b", "c", "dé", "#x", " ", "y z", "|"]) for _ in range(rng.randint(0, 40))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", "\n\n"]) for w in words)))
    rows += [(500, "one two three four five " * 3), (501, " ".join(str(i) for i in range(9000)))]
    rows = edge(rows)
    got = sorted(
        ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
         for r in quality.assess(table(rows)).collect()), key=str)
    assert got == sorted(((i, *brute_measure(t)) for i, t in rows), key=str)


def test_many_different_words_stay_exact():
    words = [str(i) for i in range(9000)] + ["7", "8", "9", "10", "11"]
    assert quality.repeated_words(words) == 10


def test_lines_fail_by_rule():
    assert quality.line_fails("HOME | News | About | Contact") == "navigation"
    assert quality.line_fails("Copyright 2020. All Rights Reserved.") == "boilerplate"
    assert quality.line_fails("BUY NOW!! CHEAP!! BEST!! EVER!!") == "punctuation"
    assert quality.line_fails("go### to$$$ the%%% shop&&&") == "punctuation"
    for line in ("A plain sentence, with a comma.", "Really? Yes!", "NATO and the EU met.", "", "costs $5 or 10% more than it"):
        assert quality.line_fails(line) is None


def test_failing_lines_go_and_documents_that_lose_too_much(table):
    good = "This is a plain line of text that says one thing or another to its reader."
    more = "Another line follows here, with other words in it than those above."
    rows = [(1, f"{good}\na | b | c | d\n{more}"), (2, f"{'x | y | z | w | ' * 9}\nshort line here"), (3, None)]
    kept = quality.filter_documents(table(rows)).collect()
    assert [(r.doc_id, r.text, r.score, r.n_words) for r in kept] == [(1, f"{good}\n{more}", "x", 1)]
    assert quality.filter_documents(table([])).count() == 0


def test_lines_of_single_capitals_fail_alone(table):
    good = "This is a plain line of text that says one thing or another to its reader."
    for line in ("F R E E M O N E Y", "U.S.A. F.B.I. C.I.A. N.S.A.", "Ⓐ Ⓑ Ⓒ Ⓓ Ⓔ"):
        assert quality.line_fails(line) == "punctuation"
        assert quality.clean(f"{good}\n{line}")[0] == good
    rows = [(1, f"{good}\nF R E E M O N E Y"), (2, "A B C D E F G H I J K L")]
    assert [(r.doc_id, r.text) for r in quality.filter_documents(table(rows)).collect()] == [(1, good)]
    assert {r.doc_id: r.kept for r in quality.assess(table(rows)).collect()} == {1: True, 2: False}


# ---- personal data ---------------------------------------------------------
BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_pii(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_personal_data_equals_brute_force():
    rng = random.Random(5)
    parts = [
        "1", "23", "456", "255", "300", ".", ".", "-", " ", "+", "@", "a", "b.c", "_", "(", ")", "4539148803436467",
        "4539 1488 0343 6467", "\n", "é", "x@y.z", "+1 (999) 555-1234", "007",
    ]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.base_spans("9" * 20_000 + "a" * 20_000 + "@") == []


def test_model_adds_what_base_patterns_lack(table):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}"
        mail = f"{rng.choice('abc')}{i}.x@mail{i % 9}.example.com"
        rows.append((i, f"then {phone} was called and {mail} written to by {10 + i % 90}.{i % 256}.7.9 ok"))
    weights = pii.fit(table(rows))
    model = pii.SemiMarkov(weights)
    text = "write to joe at example dot com or on 2024-01-12 pay 1,234.50"
    base, spans = pii.find(text, model)
    assert base == [] and [text[a:b] for a, k, b in spans] == ["joe at example dot com"]
    assert pii.find("just some words 12 and 13 at noon", model)[1] == []
    masked = pii.mask_documents(table(edge(rows[:3])), weights)
    assert masked.columns == ["doc_id", "text", "score", "ids", "n_words"]
    assert masked.where("doc_id < 3 and (text like '%555%' or text like '%@%')").count() == 0
    found = pii.detect(table(edge(rows[:3])), weights)
    assert found.count() == len(edge(rows[:3])) and found.where("doc_id >= 900 and spans <> ''").count() == 0
    assert pii.fit(table([])) == pii.fit(table([(1, "no data")])) == {}
    assert pii.detect(table([(1, "a@b.cc")]), {}).first().spans == "email:0:6"


def test_spelled_addresses_need_no_other_sign(table):
    for text in ("ask jane.doe (at) example.com now", "ask jane.doe [AT] example.com now", "ask jane at mail dOt com now"):
        assert len(pii.regions(text)) == 1
    assert pii.regions("look at the cat (late) again") == []
    rows = [(i, f"then {'abc'[i % 3]}{i}.x@mail{i % 9}.example.com was written to, ok") for i in range(200)]
    weights = pii.fit(table(rows))
    text = "ask jane.doe (at) example.com now"
    assert [text[a:b] for a, _, b in pii.find(text, pii.SemiMarkov(weights))[1]] == ["jane.doe (at) example.com"]
    assert pii.mask_documents(table([(1, text)]), weights).first().text == "ask [EMAIL] now"


# ---- secrets ---------------------------------------------------------------
def brute_secrets(text):
    out = []
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_base_secrets_equal_brute_force():
    rng = random.Random(7)
    parts = [
        "password", "PassWD", "secret", "toKen", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "0123456789ab",
        "AKIA", "ABCDEFGH12345678", "Z", "\n", "é", "ſecret", "deadbeefdeadbeef",
    ]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == brute_secrets(text)


def test_novel_strings_in_sensitive_context(table):
    code = "def load_configuration2value(client): return client.load_configuration2value"
    rows = edge([
        (1, "the client secret is Zk83jdKq02LmXx91pQ and so on"), (2, f"auth {code} key: load_configuration2value"),
        (3, "nothing Zk83jdKq02LmXx91pQ near"), (4, "password = hunter2hunter2"),
    ])
    known = secrets.identifiers(table([(i, code + " token") for i in range(3)]))
    assert "load_configuration2value" in known
    found = {r.doc_id: r.spans for r in secrets.detect(table(rows), known).collect()}
    assert found[1] == "novel:21:39" and found[2] == found[3] == found[900] == ""
    assert found[4] == "assign:0:25"
    assert secrets.identifiers(table([])) == [] and secrets.detect(table([]), []).count() == 0


def test_novel_strings_need_no_mix_of_digits_and_letters(table):
    keys = ["Zkqjd7KqvLmXxwbpQ", "ZkqjdWKqvLmXxwbpQRtu", "8391750264417390265817", "Zk+jd/Kq=Lm_Xx-bp"]
    rows = [(i, f"the client secret is {key} and so on") for i, key in enumerate(keys)]
    rows += [(10, "load_configuration token load_configuration"), (11, f"nothing {keys[1]} near")]
    known = secrets.identifiers(table([(i, "auth load_configuration") for i in range(3)]))
    found = {r.doc_id: r.spans for r in secrets.detect(table(rows), known).collect()}
    assert [found[i] for i in range(4)] == [f"novel:21:{21 + len(key)}" for key in keys]
    assert found[10] == found[11] == ""


# ---- language --------------------------------------------------------------
def sentences(rng, lang):
    words = {"en": "the of and shing ther tion with", "de": "der und nicht schen ung lich über", "fr": "le que été eau pour ère les"}
    return " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(4, 30)))


def test_language_of_held_out_texts(spark, table):
    rng = random.Random(8)
    rows = [(i, sentences(rng, lang), lang) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    labelled = spark.createDataFrame(rows[:200], "doc_id BIGINT, text STRING, lang STRING")
    model = langid.fit(labelled, sample=150)
    assert model.languages == ["de", "en", "fr"]
    test = [(i, t) for i, t, _ in rows[200:]]
    found = {r.doc_id: r for r in langid.predict(table(edge(test)), model).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert sum(found[i].lang_pred == truth[i] for i, _ in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].score == 0
    assert {r.lang_pred for r in langid.predict(table([(1, "12 34 !?"), (2, None)]), model).collect()} == {"und"}
    none = langid.fit(labelled.limit(0))
    assert langid.predict(table([(1, "words")]), none).first().lang_pred == "und"


# ---- toxicity --------------------------------------------------------------
def test_folding_meets_disguised_words():
    for word in ("idiot", "1d10t", "IDIOT", "іdіоt", "ｉｄｉｏｔ", "id​iot", "ïdîot", "!diot"):
        assert toxicity.fold(word) == toxicity.fold("idiot"), word


def test_exception_phrases_do_not_count():
    made = toxicity.Lexicon({toxicity.fold("trash"): 2.0, "stem*": 1.0}, [toxicity.fold("trash can")])
    assert [w for *_, w in made.matches(toxicity.fold("you trash"))] == [2.0]
    assert made.matches(toxicity.fold("the trash can is full")) == []
    assert made.matches(toxicity.fold("trashy system")) == [] and len(made.matches("stemming")) == 1


def test_toxicity_of_held_out_texts(spark, table):
    rng = random.Random(9)
    bad, docs, labels = ["moron", "scumbag", "lowlife"], [], []
    for i in range(600):
        words = [rng.choice(["the", "sun", "rose", "over", "hills", "and", "rivers"]) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad) if i < 400 else rng.choice(["m0ron", "SCUMBAG", "lоwlife"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(7, None), (None, 1)]
    marked = spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")
    lexicon = toxicity.fit(table(docs), marked.where("doc_id < 400"))
    found = toxicity.score(table(edge(docs)), lexicon).collect()
    assert len(found) == len(edge(docs)) and all(0 <= r.score <= 1 for r in found)
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in found if r.doc_id is not None and 400 <= r.doc_id < 600)
    assert right == 200
    none = toxicity.fit(table(docs), marked.where("toxic = 0"))
    assert toxicity.score(table(docs[:2]), none).agg({"score": "max"}).first()[0] == 0


# ---- long texts ------------------------------------------------------------
def test_spans_answer_as_a_loop_does():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 9)))]
        known = Spans(spans)
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randint(1, 12)
            assert known.touch(a, b) == any(a < y and x < b for x, y in spans)
            assert known.cover(a, b) == any(x <= a and b <= y for x, y in spans)


def seconds(work):
    start = time.process_time()
    work()
    return time.process_time() - start


def test_long_texts_with_secrets_take_linear_time():
    novelty = secrets.Novelty(["load_configuration"])
    places = lambda n: "a token of the bearer credential password=abc12345 and a b c " * n
    assert len(secrets.find(places(65_000), novelty)[0]) == 65_000
    small, large = (seconds(lambda: secrets.find("key: api secret " * n, novelty)) for n in (30_000, 240_000))  # noqa: B023
    assert large < 20 * max(small, 0.05)


def test_long_texts_with_exceptions_take_linear_time():
    lexicon = toxicity.Lexicon({"idiot*": 2.0, "fool": 1.0}, ["useful idiot"], [0.0, 1.0, 1.0])
    text = "a useful idiot and a fool " * 160_000  # 4 MB
    assert seconds(lambda: lexicon.score(text)) < 60
    assert len(lexicon.matches(toxicity.fold("a useful idiot and a fool " * 1000))) == 1000


def test_long_texts_with_personal_data_take_linear_time():
    model = pii.SemiMarkov({})
    small, large = (
        seconds(lambda: pii.find("call +1 (503) 555-0178 or 10.1.2.3, jane at x dot org; " * n, model)) for n in (500, 4000)  # noqa: B023
    )
    assert large < 14 * max(small, 0.05)


# ---- novelty of secrets ----------------------------------------------------
@pytest.mark.parametrize("signs", ["0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "abcXYZ0189+/_-"])
def test_random_strings_of_any_alphabet_and_length_are_found(signs):
    rng, novelty = random.Random(len(signs)), secrets.Novelty(["internationalization", "load_configuration"])
    found = total = 0
    for size in (12, 20, 32, 64, 128, 256, 600):
        for _ in range(10):
            value = "".join(rng.choices(signs, k=size))
            text = f"the bearer credential {value} is old"
            base, spans = secrets.find(text, novelty)
            total += 1
            found += any(a <= 22 and 22 + size <= b for a, _, b in spans)
    assert found >= 0.95 * total


def test_words_of_the_surroundings_are_no_secrets():
    novelty = secrets.Novelty(["internationalization", "responsibilities-matrix", "load_configuration2value"])
    for text in (
        "the author internationalization and responsibilities-matrix", "auth token load_configuration2value",
        "authors of compatibilities and uninterruptedness", "secretary abcdefghijkl98zz", "the authority AKX8s8s8s8s8s8",
    ):
        assert secrets.find(text, novelty)[1] == []
    for text in ("clientSecret Zk83jdKq02LmXx91pQ", "my_api_key Zk83jdKq02LmXx91pQ", "Tokens: Zk83jdKq02LmXx91pQ", "AUTH Zk83jdKq02LmXx91pQ"):
        assert len(secrets.find(text, novelty)[1]) == 1, text


def brute_novel(text, novelty):
    """Candidates one by one: the sensitive word before each is looked for by itself."""
    out, base = [], secrets.base_spans(text)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m.group()) < 12 or any(m.start() < b and a < m.end() for a, _, b in base):
            continue
        ends = [w.end() for w in secrets._SENSITIVE.finditer(text)]
        starts = [w.start() for w in secrets._SENSITIVE.finditer(text)]
        if not any(s <= m.start() <= e + secrets.NEAR for s, e in zip(starts, ends)):
            continue
        before, after = text[max(0, m.start() - 256) : m.start()], text[m.end() : m.end() + 256]
        if novelty.bytes_of(before, m.group(), after) >= 0.8 * secrets.expected_bytes(m.group()):
            out.append((m.start(), 3, m.end()))
    return out


def test_novel_spans_equal_brute_force():
    rng, novelty = random.Random(9), secrets.Novelty(["load_configuration"])
    parts = ["token", "the", "secret:", "apikey=", "load_configuration", "x" * 15, "a-long-word-of-text", "\n", "auth", "author", "é"]
    for _ in range(400):
        words = [rng.choice(parts) if rng.random() < 0.8 else "".join(rng.choices("abcXYZ0189+/_-", k=rng.randint(8, 40))) for _ in range(rng.randint(1, 60))]
        text = " ".join(words)
        assert secrets.novel_spans(text, novelty, secrets.base_spans(text)) == brute_novel(text, novelty)
