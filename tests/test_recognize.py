import random
import re

import pytest

from samples import BANK, MEDICAL, STAFF, UNICODE
from veilmark import vocab
from veilmark.operators import recognize as rc
from veilmark.operators.findings import detect, with_findings
from veilmark.operators.rewrite import redact


def found(df):
    return sorted((r.doc_id, r.span_start, r.span_end, r.entity_type) for r in df.collect())


GOLDEN = {
    MEDICAL: [("MRN", 87, 104)],
    STAFF: [
        ("ROUTING_NUMBER", 252, 270), ("PHONE_NUMBER_IN", 240, 250),
        ("STREET_ADDRESS", 160, 180), ("ZIP_CODE", 192, 200),
    ],
    BANK: [
        ("AADHAAR", 42, 56),
        ("CVV", 79, 87),
        ("ROUTING_NUMBER", 118, 136),
    ],
    UNICODE: [
        ("PAN", 2, 12), ("CVV", 15, 22), ("PHONE_NUMBER_IN", 25, 40), ("MRN", 42, 53),
        ("ZIP_CODE", 54, 64), ("ZIP_CODE", 65, 73), ("NPI", 74, 88), ("AADHAAR", 89, 103),
        ("STREET_ADDRESS", 89, 128), ("ROUTING_NUMBER", 104, 117),
    ],
}


def test_regex_layer_golden_hits(docs):
    texts = list(GOLDEN)
    expected = sorted(
        (i, st, en, kind) for i, t in enumerate(texts) for kind, st, en in GOLDEN[t]
    )
    assert found(rc.find_regex(docs(*texts))) == expected


def test_values_are_the_text_at_their_offsets(docs):
    texts = [MEDICAL, STAFF, BANK, UNICODE, UNICODE * 3 + STAFF]
    rows = rc.find(docs(*texts)).collect()
    assert len(rows) > 40
    for r in rows:
        assert texts[r.doc_id][r.span_start:r.span_end] == r.value


def test_regex_layer_equals_python_on_random_texts(docs):
    """Brute force over the same patterns; guards must not lose a match."""
    rng = random.Random(7)
    parts = [
        "CVV: 123", "cvv#4567", "routing 123456789", "ABA:021000021", "NPI 1234567890",
        "mr-abc123", "MRN: 12345678", "+91 98765 43210", "9876543210", "12 Oak Hill Rd NW",
        "7 A St.", "GA 30309", "30309-1234", "abcde1234z", "2345 6789 0123", "x", "é", "\U0001F600",
        "\n", " ", "\t", "99", "-", ":", "ünï", "Main Street", "1", "٣٤٥٦٧",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(30)) for _ in range(300)]
    expected = sorted(
        (i, m.start(), m.end(), kind)
        for i, t in enumerate(texts)
        for kind, p in vocab.REGEX_PATTERNS.items()
        for m in re.finditer(p, t, re.IGNORECASE)
    )
    assert len(expected) > 1000
    assert found(rc.find_regex(docs(*texts))) == expected


def test_guards_lose_nothing_in_the_rules_layer(docs, monkeypatch):
    rng = random.Random(8)
    parts = [
        "a.b@c.example.org", "(212) 555-0123", "+44 20 7946 0123", "123-45-6789", "DL: A1234567",
        "driver's license no D1234567", "Passport No: P12345678", "2024-01-31", "1/2/99",
        "Sept. 8, 1985", "10.0.0.255", "300.1.1.1", "fe80::1:2", "1:2:3:4:5:6:7:8", "DEA: BJ0000531",
        "Account No: 12345678", "4539 1488 0343 6467", "GB29NWBK60161331926819", "x", "é", ":", "\n",
    ]
    texts = [" ".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    table = docs(*texts)
    guarded = found(rc.find_rules(table))
    monkeypatch.setattr(rc, "GUARDS", {g: "true" for g in rc.GUARDS})
    assert guarded == found(rc.find_rules(table))
    assert len({kind for *_, kind in guarded}) == 11


def test_a_long_list_of_hits_keeps_its_offsets(docs):
    text = "".join(f"{i % 7} CVV {100 + i % 900}, é" for i in range(1500))
    rows = rc.find(docs(text), rc.by_type("CVV")).collect()
    assert len(rows) == 1500
    assert all(text[r.span_start:r.span_end] == r.value for r in rows)


def test_detect_on_the_samples(docs):
    rows = detect(docs(MEDICAL, STAFF, BANK)).collect()
    kinds = [[r.entity_type for r in rows if r.doc_id == i] for i in range(3)]
    assert kinds[0] == [
        "patient_name", "date_of_birth", "US_SSN", "medical_record_number", "DATE_TIME", "diagnosis",
        "prescription", "insurance_id", "EMAIL_ADDRESS", "PHONE_NUMBER",
    ]
    # A bank account that looks like an Indian mobile number is taken for one.
    assert kinds[1] == [
        "employee_id", "US_SSN", "date_of_birth", "PHONE_NUMBER", "EMAIL_ADDRESS", "STREET_ADDRESS",
        "ZIP_CODE", "salary", "PHONE_NUMBER_IN", "ROUTING_NUMBER",
    ]
    # The card beats the Aadhaar hit inside it: same start and score, earlier layer.
    assert kinds[2] == [
        "CREDIT_CARD", "CVV", "IBAN_CODE", "ROUTING_NUMBER", "EMAIL_ADDRESS", "US_PASSPORT",
    ]


def test_a_card_that_fails_its_checksum_is_an_aadhaar(docs):
    rows = detect(docs("4539 1488 0343 6468")).collect()
    assert [(r.entity_type, r.value) for r in rows] == [("AADHAAR", "4539 1488 0343")]


def test_mrn_pattern_hits_but_never_surfaces(docs):
    table = docs("MRN-20248819 and Mr Johnsonx")
    assert [r.entity_type for r in rc.find_regex(table).collect()] == ["MRN", "MRN"]
    assert detect(table).count() == 0


def test_case_is_ignored_and_labels_belong_to_the_value(docs):
    rows = detect(docs("by 30309, abcde1234f, cvv: 847")).collect()
    assert [(r.entity_type, r.value) for r in rows] == [
        ("ZIP_CODE", "by 30309"), ("PAN", "abcde1234f"), ("CVV", "cvv: 847"),
    ]


def test_ties_go_to_the_earlier_pattern(docs):
    rows = detect(docs("2345 6789 0123 aba 12 Main St")).collect()
    assert rows[0].entity_type == "AADHAAR"


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("US_SSN", "123-45-6789", ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"]),
        ("CREDIT_CARD", "4111-1111-1111-1111", ["4111 1111 1111 1112"]),
        ("IBAN_CODE", "DE89 3704 0044 0532 0130 00", ["GB28NWBK60161331926819"]),
        ("IP_ADDRESS", "10.255.0.1", ["10.256.0.1"]),
        ("IP_ADDRESS", "2001:db8::7:1", ["12:34"]),
        ("MEDICAL_LICENSE", "DEA: BJ0000531", ["DEA: BJ0000532"]),
        ("US_DRIVER_LICENSE", "Driver's License: D1234567", ["driver license renewal"]),
        ("DATE_TIME", "Sept. 8, 1985", ["8 of 1985"]),
        ("PHONE_NUMBER", "+44 20 7946 0123", ["20 7946"]),
    ],
)
def test_rules_layer_checks(docs, kind, good, bad):
    rows = rc.find(docs(good, *bad), rc.by_type(kind)).collect()
    assert [r.doc_id for r in rows] == [0]
    assert good.endswith(rows[0].value)


def test_fields_end_at_bar_parenthesis_and_line(docs):
    rows = rc.find_fields(docs("Blood Type: AB+ | Lab Result: 7 mg (fasting)\nTreatment: rest \nx")).collect()
    assert [(r.entity_type, r.value) for r in rows] == [
        ("blood_type", "AB+"), ("lab_result", "7 mg"), ("treatment", "rest"),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Patient: Ann Lee, SSN: 234-56-7890, Diagnosis: HIV positive", ["Ann Lee", "234-56-7890", "HIV positive"]),
        ("Diagnosis: HIV positive, card 4539148803436467, Treatment: ART", ["HIV positive", "4539148803436467", "ART"]),
        ("Salary: $95,000; DOB: May 2, 1991", ["$95,000", "May 2, 1991"]),
        ("Blood Type: AB+ Treatment: long sleep", ["AB+", "long sleep"]),
        ("pay BE68 5390 0754 7034 EUR now", ["BE68 5390 0754 7034"]),
        ("LC14BOSL123456789012345678901234", ["LC14BOSL123456789012345678901234"]),
        ("gift 4539 1488 0343 6460 003", ["4539 1488 0343 6460 003"]),
        ("a" * 70 + "@example.org", ["a" * 70 + "@example.org"]),
        ("joe@example.xn--p1ai", ["joe@example.xn--p1ai"]),
        ("Account No:     12345678", ["12345678"]),
    ],
)
def test_nothing_is_cut_or_lost(docs, text, expected):
    assert [r.value for r in detect(docs(text)).orderBy("span_start").collect()] == expected


def test_a_long_run_of_address_characters_is_read_once(docs):
    assert rc.find(docs("a.b-" * 50_000), rc.by_type("EMAIL_ADDRESS")).count() == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Patient: Smith, John | ward 3", ["Smith", "John"]),
        ("Diagnosis: diabetes, hypertension and HIV", ["diabetes", "hypertension and HIV"]),
        ("Medications: metformin, lisinopril 10mg", ["metformin", "lisinopril 10mg"]),
        ("Employee ID: E-12, 34", ["E-12", "34"]),
        ("Salary: $95,000, bonus $1,200", ["$95,000", "bonus $1,200"]),
        ("DOB: May 2, 1991, June 3, 1992", ["May 2, 1991", "June 3, 1992"]),
        ("Patient: Ann Lee, Ward: 7, Diagnosis: flu , , cough,", ["Ann Lee", "flu", "cough"]),
        ("Diagnosis: 4539148803436467 HIV", ["4539148803436467", "HIV"]),
        ("Diagnosis: flu by mail joe@example.com, cough", ["flu by mail", "joe@example.com", "cough"]),
        ("Treatment: 10.1.2.3 10.4.5.6 long sleep", ["10.1.2.3", "10.4.5.6", "long sleep"]),
        ("Treatment: a b 10.1.2.3 or IP address: 10.4.5.6", ["a b", "10.1.2.3", "or IP", "10.4.5.6"]),
    ],
)
def test_lists_are_split_and_cut_around_stronger_findings(docs, text, expected):
    rows = detect(docs(text)).orderBy("span_start").collect()
    assert [r.value for r in rows] == expected
    assert all(text[r.span_start : r.span_end] == r.value for r in rows)


def test_no_item_of_a_labelled_list_stays_readable(docs):
    rng = random.Random(8)
    words = ["Ωmega", "smith", "type-2", "x9", "O'Neil", "blue pill", "£5", "J.R."]
    strong = ["4539148803436467", "joe@example.com", "10.1.2.3"]
    labels = ["Patient", "Diagnosis", "Medications", "Employee ID", "Salary"]
    texts, hidden = [], []
    for n in range(300):
        fields, secret = [], []
        for label in rng.sample(labels, rng.randint(1, 3)):
            items = [
                " ".join(rng.choices(words + strong, k=rng.randint(1, 4))) + f" q{n}z{k}" for k in range(rng.randint(1, 6))
            ]
            secret += [w for item in items for w in item.split()]
            fields.append(f"{label}: " + rng.choice([", ", ",  ", " , "]).join(items))
        texts.append(rng.choice([" | ", "; ", "\n", ", "]).join(fields))
        hidden.append(secret)
    table = docs(*texts)
    for row, secret in zip(redact(with_findings(table)).orderBy("doc_id").collect(), hidden):
        left = set(re.findall(r"[^\s,;|]+", re.sub(r"\[\w+\]", " ", row.redacted_text)))
        assert not left & set(secret), row


def test_long_lists_are_read_in_one_pass(docs):
    text = "Diagnosis: " + ", ".join(f"flu n{i}n 4539148803436467 x" for i in range(5000))
    assert detect(docs(text)).count() == 15_000


def test_plain_pieces_lose_no_match(docs):
    """A sign outside ASCII turns off the plain pieces; findings must not change."""
    more = [
        "DL: A1234567 Passport No: P12345678 on March 5, 2021 or 1/2/99 from 10.1.2.3",
        "card 4539-1488 0343 6467 and 4539 1488 0343 6460 003; 4539148803436467",
        "NO9386011117947 BE68 5390 0754 7034 GB29NWBK60161331926819 call +44 20 7946 0123, (212) 555-0123",
        "2345 6789 0123 abcde1234F 9136032205 12 Main\tSt\n9 Oak Hill Rd NW GA\t30309 12345-6789",
        "Patient: A, b,, c ; Blood Group# AB+ Salary: $1, 2 card 4539148803436467",
    ]
    texts = [t for t in [*GOLDEN, *more] if t.isascii()]
    assert set(rc.ASCII_PIECES) <= {r.name for r in rc.ALL_LAYERS}
    plain = rc.find(docs(*texts))
    full = rc.find(docs(*(f"{t}\né" for t in texts)))
    assert found(plain) == found(full)
    kinds = {r.entity_type for r in rc.ALL_LAYERS if r.name in rc.ASCII_PIECES}
    assert kinds <= {row.entity_type for row in plain.collect()}


def test_a_text_is_read_once_by_a_pattern():
    """Gaps, matches, values and labels come out of one replacement."""
    assert rc.hits_sql("text").count(f"regexp_replace(text, {rc.raw(rc.UNICODE + rc.FIELD_PATTERN)}") == 1


def test_texts_with_the_sign_between_pieces(docs):
    texts = [MEDICAL, STAFF, BANK, UNICODE, "Diagnosis: flu, cough card 4539148803436467"]
    with_sign = rc.find(docs(*(f"\x1f{t}\x1f\x1f" for t in texts)))
    moved = [(i, st - 1, en - 1, kind) for i, st, en, kind in found(with_sign)]
    assert moved == found(rc.find(docs(*texts))) and moved


def test_shapes_lose_no_match(docs):
    """Every test of a shape has a text that passes it alone and is found."""
    texts = [
        "(212) 555-0123", "212 555 0123", "212.555.0123", "+44 20 7946 0123", "123-45-6789", "2024-01-31", "1/2/99",
        "May 5 2021", "May 15 2021", "May 5, 2021", "May 15, 2021", "4539148803436467", "4539 1488 0343 6467",
        "4539-1488-0343-6467", "4539 1488 0343 6460 003", "2345\t6789\t0123", "abcde1234F", "91360-32205", "GA\t30309",
        "12345-6789", "DL: A1234567", "driver's license no D1234567", "PASSPORT NO: P12345678", "10.1.2.3",
    ]
    assert set(rc.SHAPES) | set(rc.LOWER) <= {r.name for r in rc.ALL_LAYERS}
    plain = found(rc.find(docs(*texts)))
    assert {i for i, *_ in plain} == set(range(len(texts)))
    assert plain == found(rc.find(docs(*(f"{t}\né" for t in texts))))
