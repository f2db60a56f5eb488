import json
import random
import re

import pytest
from pyspark.sql import functions as F

from samples import BANK, MEDICAL, STAFF, UNICODE
from veilmark.functions.arrays import let
from veilmark.functions.text import PIECE, ordered_cuts, pieces, splice
from veilmark.operators import rewrite
from veilmark.operators.findings import with_findings
from veilmark.operators.rewrite import redact_json_values
from veilmark.schemas import HIT

EDIT = "array<struct<st:int,en:int,new:string>>"
HITS = "array<struct<st:int,en:int,sc:double,entity_type:string>>"


def random_edits(rng, length, overlaps):
    edits, at = [], 0
    while at < length - 8 and len(edits) < 40:
        st = at + rng.randrange(6)
        en = st + 1 + rng.randrange(8)
        edits.append((st, min(en, length), rng.choice(["", "<b>", "[LONG PLACEHOLDER]"])))
        at = st + 1 if overlaps else en
    return edits


@pytest.mark.parametrize("overlaps", [False, True])
def test_splicing_equals_list_assignment(spark, overlaps):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        n = rng.choice([10, 60, 300])
        text = "".join(rng.choice("abc é\U0001F600") for _ in range(n))
        rows.append((i, text, random_edits(rng, n, overlaps)))
    if not overlaps:
        # Texts longer than a piece, with edits across the seams.
        long = "".join(rng.choice("xyzé") for _ in range(3 * PIECE + 17))
        seams = [(k * PIECE - 3, k * PIECE + 4, "|") for k in (1, 2, 3)]
        rows += [(900, long, seams), (901, long, [(0, 2 * PIECE + 5, "")]), (902, long, [])]
    expected = {}
    for i, text, edits in rows:
        chars = list(text)
        for st, en, new in reversed(edits):
            chars[st:en] = list(new)
        expected[i] = "".join(chars)
    df = spark.createDataFrame(rows, f"i INT, text STRING, edits {EDIT}")
    once = let("p", pieces("text"), splice("p", "edits", "text"))
    cuts = let("p", pieces("text"), splice("p", ordered_cuts("edits", "text"), "text"))
    sql = cuts if overlaps else once
    got = df.select("i", F.expr(sql).alias("t")).collect()
    assert {r.i: r.t for r in got} == expected
    if not overlaps:
        again = df.select("i", F.expr(cuts).alias("t")).collect()
        assert {r.i: r.t for r in again} == expected


def test_redaction_on_the_samples(docs):
    rows = rewrite.redact(with_findings(docs(MEDICAL, STAFF, BANK, "clean"))).collect()
    assert rows[0].redacted_text.splitlines()[1:3] == [
        "Patient: [patient_name] | DOB: [date_of_birth]", "SSN: [US_SSN]; MRN: [medical_record_number]",
    ]
    # A pattern's value holds its label, so that goes too.
    assert "(valid to 04/29, [CVV])" in rows[2].redacted_text
    assert rows[3].redacted_text == "clean"


def test_masks_count_characters_not_digits(docs):
    text = rewrite.mask(with_findings(docs(MEDICAL + "\n" + BANK))).first().masked_text
    assert "SSN: *******2207" in text
    assert "card: ************44 1115" in text


def test_stand_ins(docs):
    text = rewrite.replace_values(with_findings(docs(BANK))).first().replaced_text
    assert "card: 4111-1111-1111-1111" in text and "Reply to: user@example.com" in text
    assert "IBAN: [SYNTHETIC]" in text


def test_an_unknown_mode_fails_before_anything_runs(docs):
    with pytest.raises(ValueError, match="rewrite mode"):
        rewrite.rewrite(with_findings(docs("x")), "scramble")


def test_no_character_of_a_finding_survives_redaction(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        text = "".join(chr(0x4E00 + k) for k in range(60))
        spans = []
        for _ in range(rng.randrange(1, 7)):
            st = rng.randrange(50)
            spans.append((st, st + 1 + rng.randrange(10), rng.choice([0.5, 1.0]), rng.choice("AB")))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"doc_id INT, text STRING, hits {HITS}")
    for r in rewrite.redact(df).collect():
        text, spans = rows[r.doc_id][1:]
        inside = {c for st, en, *_ in spans for c in text[st:en]}
        outside = [c for c in text if c not in inside]
        assert [c for c in r.redacted_text if c >= "一"] == outside


def test_partial_overlap_shows_both(spark):
    df = spark.createDataFrame(
        [(1, "abcdefghijkl", [(0, 5, 1.0, "A"), (3, 9, 1.0, "B")])], f"doc_id INT, text STRING, hits {HITS}"
    )
    assert rewrite.redact(df).first().redacted_text == "[A][B]jkl"


def test_neighbours_of_one_type_merge_over_spaces_only(spark):
    rows = [
        (0, "ab  cd", [(0, 2, 1.0, "A"), (4, 6, 1.0, "A")]),
        (1, "ab\n cd", [(0, 2, 1.0, "A"), (4, 6, 1.0, "A")]),
        (2, "ab  cd", [(0, 2, 1.0, "A"), (4, 6, 1.0, "B")]),
        (3, "ab  cd", [(0, 4, 1.0, "A"), (2, 6, 1.0, "A")]),
        (4, "ab  cd", [(0, 6, 0.5, "A"), (2, 4, 1.0, "B")]),
    ]
    df = spark.createDataFrame(rows, f"doc_id INT, text STRING, hits {HITS}")
    got = {r.doc_id: r.redacted_text for r in rewrite.redact(df).collect()}
    assert got == {0: "[A]", 1: "[A]\n [A]", 2: "[A]  [B]", 3: "[A]", 4: "[A]"}


def test_marked_up_views(docs):
    df = with_findings(docs('<b>"x" & y</b> cvv: 847', "<i>none & nothing</i>"))
    risk = [r.highlighted_html for r in rewrite.highlight_risk(df).collect()]
    # Text outside the spans stays raw unless nothing was found.
    assert risk[0].startswith("<pre style='white-space:pre-wrap;word-break:break-word;font-family") and '<b>"x" & y</b>' in risk[0]
    assert 'title="CVV | Financial | High risk | via regex">cvv: 847</span></pre>' in risk[0]
    assert risk[1] == "<pre style='white-space:pre-wrap;word-break:break-word;'>&lt;i&gt;none &amp; nothing&lt;/i&gt;</pre>"
    category = [r.category_html for r in rewrite.highlight_category(df).collect()]
    assert category[0] == (
        '<div class="hl-wrap"><b>"x" & y</b> <span class="hl-fin" '
        'title="CVV · Financial · High risk · regex">cvv: 847</span></div>'
    )
    safe = rewrite.highlight_category(df, escape_all=True).first().category_html
    assert safe.startswith('<div class="hl-wrap">&lt;b&gt;"x" &amp; y&lt;/b&gt; <span')


def test_json_is_parsed_again_if_it_still_can_be(docs):
    df = with_findings(docs('{"mail": "a@b.example.com"}', '{"card": 4539148803436467}'))
    rows = rewrite.redact_json(df).select(
        "redacted_text", F.try_variant_get("json", "$.mail", "string").alias("mail"), F.col("json").isNull().alias("raw")
    ).collect()
    assert (rows[0].mail, rows[0].raw) == ("[EMAIL_ADDRESS]", False)
    assert (rows[1].redacted_text, rows[1].raw) == ('{"card": [CREDIT_CARD]}', True)


def test_hit_struct_has_the_fields_rewriting_needs():
    assert set(re.findall(r"(\w+):", HIT)) >= {"st", "en", "sc", "entity_type", "value", "risk", "category"}


def test_unicode_offsets_survive_rewriting(docs):
    text = rewrite.redact(with_findings(docs(UNICODE))).first().redacted_text
    assert text.startswith("\U0001F600 [PAN] x [CVV] é [PHONE_NUMBER_IN]; Mr Johnsonx")


def test_neighbours_are_masked_each_and_at_full_length(docs):
    text = rewrite.mask(with_findings(docs("Both: 123-45-6789 234-56-7890"))).first().masked_text
    assert text == "Both: *******6789 *******7890"
    long = "x" * 1500
    text = rewrite.mask(with_findings(docs(f"Diagnosis: {long}"))).first().masked_text
    assert text == "Diagnosis: " + "*" * 1500


def test_json_stays_json(docs):
    """Quotes, escapes, keys, bare numbers, nesting, and text that is no JSON."""
    card, mail = "4539148803436467", "joe@example.com"
    values = [
        {"a": f"say \"{mail}\" or \\{mail}\\", "n": int(card), "list": [int(card), f"\n{mail}", None, True, 1.5e3]},
        {mail: 1, "x " + mail: {"deep": {card: [mail]}}, mail + " again": 2},
        {"é\U0001F600": f"ü {mail} \u00e9 123-45-6789\t {card}", "z": []},
        [card, int(card), -1, "10.1.2.3"], mail, int(card), {"plain": "nothing", "k": 97},
    ]
    texts = [json.dumps(v) for v in values] + [json.dumps(v, ensure_ascii=False, indent=1) for v in values]
    texts += [f"no json {mail}", "", None, "{" + mail]
    for mode in ("redact", "mask", "replace"):
        rows = redact_json_values(with_findings(docs(*texts)), mode).orderBy("doc_id").collect()
        for r, text in zip(rows[: 2 * len(values)], texts):
            assert r.json is not None, r.redacted_text
            back = json.loads(r.redacted_text)
            assert mail not in r.redacted_text and card not in r.redacted_text and "10.1.2.3" not in r.redacted_text
            assert len(back) == len(json.loads(text)) if isinstance(back, (dict, list)) else True
        assert json.loads(rows[6].redacted_text) == values[6]
    rows = redact_json_values(with_findings(docs(*texts))).orderBy("doc_id").collect()
    first = json.loads(rows[0].redacted_text)
    assert first["n"] == "[CREDIT_CARD]" and first["list"][0] == "[CREDIT_CARD]" and first["list"][2:] == [None, True, 1500.0]
    assert first["a"] == 'say "[EMAIL_ADDRESS]" or \\[EMAIL_ADDRESS]\\'
    assert rows[14].redacted_text == "no json [EMAIL_ADDRESS]" and rows[14].json is None
    assert rows[15].redacted_text == "" and rows[16].redacted_text is None and rows[17].redacted_text == "{[EMAIL_ADDRESS]"
