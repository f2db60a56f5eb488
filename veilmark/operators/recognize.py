"""Recognizers that read the text of a document row (no shuffle, no join).

A recognizer is one pattern with a type, a score and a source.  All recognizers
of a scan are evaluated in one projection over the text: each yields its matches
as an array, and one shared expression turns matches into findings with offsets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions import checks
from veilmark.functions.arrays import constant_map, empty, let, quoted, raw, scan, text_list
from veilmark.functions.text import MARK, find_parts, find_parts_slowly, place, place_parts, strip
from veilmark.schemas import HIT, LAYER_SPAN, LAYERS

UNICODE = "(?iU)"

# Cheap tests on the whole text; a pattern runs only where its test holds.  Every
# match implies its test.  Word tests look for letters of the word in lower case;
# they avoid i, k and s, which also stand for letters outside ASCII.  ``_t`` holds what is
# looked up once a text: whether it has a digit and three digits in a row (most texts
# without are done after that one look), whether it is ASCII, its lower case, and its shape,
# where each digit 0-9 is a 0: to find a piece in it takes far less than a pattern does.
GUARDS = {
    "any": "true",
    "digit": "_t.dg",
    "digits": "_t.ds",
    "at": "contains({t}, '@')",
    "mark": "contains({t}, ':') OR contains({t}, '#')",
    "plus": "_t.dg AND contains({t}, '+')",
    "dots": "contains(_t.sh, '0.0')",
    "colons": "contains({t}, ':') AND (contains({t}, '::') OR rlike({t}, ':[0-9A-Fa-f]{{1,4}}:'))",
    "cvv": "_t.ds AND contains(_t.lo, 'cvv')",
    "bank": "_t.ds AND (contains(_t.lo, 'rout') OR contains(_t.lo, 'aba'))",
    "np": "_t.ds AND contains(_t.lo, 'np')",
    "mr": "contains(_t.lo, 'mr')",
    "pa": "_t.ds AND contains(_t.lo, 'pa')",
    "acc": "_t.ds AND contains(_t.lo, 'acc')",
    "driver": "_t.dg AND (contains(_t.lo, 'dl') OR contains(_t.lo, 'dr'))",
    "medical": "_t.ds AND (contains(_t.lo, 'dea') OR contains(_t.lo, 'med'))",
}


@dataclass(frozen=True)
class Recognizer:
    name: str
    entity_type: Optional[str]  # None: taken from the label of the match
    pattern: str
    score: float
    source: str
    guard: str = "digits"
    value_group: int = 0
    label_group: Optional[int] = None
    check: Optional[Callable] = None


_REGEX_GUARDS = {
    "CVV": "cvv",
    "ROUTING_NUMBER": "bank",
    "NPI": "np",
    "MRN": "mr",
    "STREET_ADDRESS": "digit",
}

REGEX_LAYER = [
    Recognizer(
        name=kind.lower(),
        entity_type=kind,
        pattern=UNICODE + pattern,
        score=vocab.REGEX_SCORE,
        source="regex",
        guard=_REGEX_GUARDS.get(kind, "digits"),
    )
    for kind, pattern in vocab.REGEX_PATTERNS.items()
]

# What may stand between a label and its number: "no", "number" and separators.
_LABEL_TAIL = r"(?: no\.?| number)?[ :#]+"
_MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|"
    "Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)



def _iban_pattern():
    """Country, check digits and as many characters as the country has, in fours or not."""
    by_length = {}
    for country, length in vocab.IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    forms = []
    for length, countries in sorted(by_length.items()):
        fours, rest = divmod(length - 4, 4)
        tail = rf" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    return rf"\b(?:{'|'.join(forms)})\b"


RULES_PATTERNS = {
    # Read each run of address characters once: begin where it begins, give nothing back.
    "email": (
        r"(?<![A-Z0-9._%+-])[.%+-]*+([A-Z0-9_][A-Z0-9._%+-]*+@(?:[A-Z0-9-]+\.)+"
        r"(?:XN--[A-Z0-9-]*[A-Z0-9]|[A-Z]{2,}))\b"
    ),
    "phone": (
        r"(?:\+?\b1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|\b[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
    ),
    "phone_abroad": r"\+[1-9][0-9]{0,2}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "driver_license": r"\b(?:DL|driver.?s? licen[sc]e)" + _LABEL_TAIL + r"([A-Z0-9]{6,14})\b",
    "passport": r"\bpassport" + _LABEL_TAIL + r"([A-Z]?[0-9]{7,9})\b",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b",
    "date_in_words": r"\b(?:" + _MONTHS + r")\.? [0-9]{1,2},? [0-9]{4}\b",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ipv6": (
        r"\b(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}\b|"
        r"\b(?:[0-9A-F]{1,4}:){1,6}(?::[0-9A-F]{1,4}){1,6}\b"
    ),
    "medical_license": r"\b(?:DEA|medical licen[sc]e)" + _LABEL_TAIL + r"([A-Z][A-Z9][0-9]{7})\b",
    "bank_number": r"\b(?:account|acct)" + _LABEL_TAIL + r"([0-9]{8,17})\b",
    # Nineteen digits in groups of four: one group more than the other forms have.
    "card_long": r"\b(?:[0-9]{4}[ -]){4}[0-9]{1,3}\b",
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{3,6}){2,3}\b",
    "iban": _iban_pattern(),
}


def _rule(name, kind, score, guard="digits", group=0, check=None, flags=UNICODE):
    return Recognizer(
        name, kind, flags + RULES_PATTERNS[name], score, "rules", guard, group, None, check
    )


RULES_LAYER = [
    _rule("email", "EMAIL_ADDRESS", 1.0, "at", 1),
    _rule("phone", "PHONE_NUMBER", 0.75),
    _rule("phone_abroad", "PHONE_NUMBER", 0.75, "plus"),
    _rule("ssn", "US_SSN", 0.85, check=checks.ssn_ok),
    _rule("driver_license", "US_DRIVER_LICENSE", 0.6, "driver", 1, checks.has_digit),
    _rule("passport", "US_PASSPORT", 0.6, "pa", 1),
    _rule("date", "DATE_TIME", 0.6, "digit"),
    _rule("date_in_words", "DATE_TIME", 0.6),
    _rule("ipv4", "IP_ADDRESS", 0.95, "dots", check=checks.ip_ok),
    _rule("ipv6", "IP_ADDRESS", 0.95, "colons", check=checks.ip_ok),
    _rule("medical_license", "MEDICAL_LICENSE", 1.0, "medical", 1, checks.provider_ok),
    _rule("bank_number", "US_BANK_NUMBER", 0.5, "acc", 1),
    _rule("card_long", "CREDIT_CARD", 1.0, check=checks.card_ok),
    _rule("card", "CREDIT_CARD", 1.0, check=checks.card_ok),
    _rule("iban", "IBAN_CODE", 1.0, "digit", check=checks.iban_ok, flags="(?U)"),
]

# Words that open a labelled field, and the model label each stands for.
FIELD_WORDS = {
    "patient name": "patient name",
    "patient": "patient name",
    "dob": "date of birth",
    "date of birth": "date of birth",
    "mrn": "medical record number",
    "medical record number": "medical record number",
    "diagnosis": "diagnosis",
    "medications": "prescription",
    "medication": "prescription",
    "prescription": "prescription",
    "insurance id": "insurance id",
    "employee id": "employee id",
    "salary": "salary",
    "national id": "national id",
    "blood type": "blood type",
    "blood group": "blood type",
    "lab result": "lab result",
    "treatment": "treatment",
}
FIELD_SCORE = 0.9
_LABELS = "|".join(FIELD_WORDS)
# A value ends, without blanks and commas at its end, at a bar, bracket, line end or
# semicolon, at a comma before words and a colon, which look like another label, and where
# the next known label begins.  It is read forward one character at a time: a repeated group
# would take stack for each.
_END = (
    r"(?=[^\S\n]*+(?:,++[ \t\n]*+\p{L}[\p{L}\p{N} .'/-]{0,39}+[:#]|\b(?:" + _LABELS + r")[ \t]*[:#]"
    r"|,*+[^\S\n]*+(?:[|(\n;]|\z)))"
)
FIELD_PATTERN = (
    r"\b(" + _LABELS + r")[ \t]*[:#][ \t]*+([^|(\n;]*?[^|(\s;,])" + _END
)
# Commas before blanks part the items of a value, but for one in a date in words.
ITEM_BREAK = r"[ \t]*+,++(?! [12][0-9]{3}\b)[ \t]++"
LABEL_LAYER = [
    Recognizer(
        "fields", None, UNICODE + FIELD_PATTERN, FIELD_SCORE, "ner", "mark", 2, 1
    )
]

# What a text in ASCII must hold for a pattern to match, after its guard: one of some pieces of
# its shape or lower case, and a plain piece of the pattern, without the word boundaries and
# Unicode classes that make it slow to look for.  An IBAN has fifteen characters at least, a card
# number that passes its checksum thirteen digits, so that four are followed by three.
SHAPES = {
    "phone": ["000-0000", "000 0000", "000.0000"],
    "phone_abroad": ["+0"],
    "ssn": ["000-00-0000"],
    "date": ["0000-00-00", "0/0"],
    "date_in_words": [" 0 0000", " 00 0000", " 0, 0000", " 00, 0000"],
    "card_long": ["0000 0000", "0000-0000"],
    "card": ["0000000", "0000 000", "0000-000"],
    "aadhaar": ["0000"],
    "pan": ["0000"],
    "phone_number_in": ["00000"],
    "zip_code": ["00000"],
}
LOWER = {"driver_license": ["dl", "driver"], "passport": ["passport"]}
_SUFFIX = re.search(r"\\s(\(\?:St\|[^)]*\))", vocab.REGEX_PATTERNS["STREET_ADDRESS"])[1]
ASCII_PIECES = {
    "phone_abroad": r"\+[1-9][0-9]{0,2}[ .-][0-9]",
    "date": r"[0-9](?:[0-9]{3}-[0-9]{2}-[0-9]{2}|/[0-9]{1,2}/[0-9]{2})",
    "card_long": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{3}",
    "phone_number_in": r"[6-9][0-9]{4}[-\s]?[0-9]{5}",
    "street_address": rf"(?i)\s{_SUFFIX}",
}
_SHORTEST = [w for w in FIELD_WORDS if not any(o != w and o in w for o in FIELD_WORDS)]


def _one_of(pieces, text):
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in pieces) + ")"


def _worth_it(r, text):
    """Whether the pattern of a recognizer can match in the text."""
    tests = [_one_of(SHAPES[r.name], "_t.sh")] if r.name in SHAPES else []
    if r.name in LOWER or r.label_group:
        tests.append(_one_of(LOWER.get(r.name, _SHORTEST), "_t.lo"))
    if r.name in ASCII_PIECES:
        tests.append(f"rlike({text}, {raw(ASCII_PIECES[r.name])})")
    plain = " AND ".join(tests) or "true"
    return f"({GUARDS[r.guard].format(t=text)}) AND (NOT _t.asc OR {plain})"


# Layer order decides ties: rules, labels, regex.
ALL_LAYERS = RULES_LAYER + LABEL_LAYER + REGEX_LAYER


def _listed(kind):
    return bool({kind, kind.lower()} & set(vocab.CATEGORY_TABLE))


def _stronger(r):
    """Whether a labelled value is cut around the findings of a recognizer.  A type without a
    category would be dropped later, and the value with it."""
    return r.entity_type is not None and r.score > FIELD_SCORE and _listed(r.entity_type)


# Words that name such findings, like "card" before a card number, are left out of what
# remains of a value.
CAPTIONS = sorted({
    w for r in ALL_LAYERS if _stronger(r) for w in r.entity_type.lower().split("_") if len(w) > 2
})


def by_type(*kinds):
    """The recognizers of the given entity types or names, in rank order."""
    return [r for r in ALL_LAYERS if r.entity_type in kinds or r.name in kinds]


def normalize_label(label):
    """Model label to type name: fixed renames, else blanks become ``_``."""
    renames = constant_map(vocab.LABEL_RENAMES)
    return f"coalesce(try_element_at({renames}, {label}), replace({label}, ' ', '_'))"


def category_of(entity_type):
    """Struct (category, risk, reason) of a type.

    The lower-cased name counts if it is listed, else the name as it is; types in
    neither form are "Other".
    """

    def entry(category, risk, reason):
        return f"named_struct('category', {category}, 'risk', {risk}, 'reason', {reason})"

    table = ", ".join(
        f"{quoted(kind)}, {entry(*map(quoted, row))}"
        for kind, row in vocab.CATEGORY_TABLE.items()
    )
    other = entry(
        *map(quoted, vocab.UNKNOWN_CATEGORY),
        f"concat({quoted(vocab.UNKNOWN_REASON)}, {entity_type})",
    )
    return (
        f"coalesce(try_element_at(map({table}), lower({entity_type})), "
        f"try_element_at(map({table}), {entity_type}), {other})"
    )


def is_denied(value):
    return f"lower({strip(value)}) IN ({text_list(vocab.DENYLIST)})"


def _checked(hit, recognizers):
    """True unless a checksum or range test of the hit's recognizer fails."""
    tests = [(i, r.check(f"{hit}.value")) for i, r in enumerate(recognizers) if r.check is not None]

    def halved(some):
        # Outside compiled code a long CASE looks for each of its branches from the first one on.
        if len(some) == 1:
            return some[0][1]
        half = len(some) // 2
        return f"if({hit}.rank < {some[half][0]}, {halved(some[:half])}, {halved(some[half:])})"

    unchecked = ", ".join("false" if r.check else "true" for r in recognizers)
    return f"(get(array({unchecked}), {hit}.rank) OR {halved(tests)})" if tests else "true"


def _items(spots):
    """Values of labelled fields, as places in the text, split into the items of a list."""
    split = (
        f"named_struct('whole', _its, 'gaps', concat(array(''), regexp_extract_all(_pv.value, {raw(ITEM_BREAK)}, 0)), "
        "'values', _its, 'labels', array_repeat(_pv.label, size(_its)))"
    )
    moved = (
        f"transform(filter({place('_sp')}, _it -> _it.value <> ''), _it -> named_struct('st', _pv.st + _it.st, "
        "'en', _pv.st + _it.en, 'value', _it.value, 'label', _it.label))"
    )
    items = let("_its", f"split(_pv.value, {raw(ITEM_BREAK)}, -1)", let("_sp", split, moved))
    whole = "CASE WHEN _pv.value <> '' THEN array(_pv) ELSE array() END"
    return f"flatten(transform({spots}, _pv -> CASE WHEN contains(_pv.value, ',') THEN {items} ELSE {whole} END))"


_SPOT = (
    "struct<rank:int,entity_type:string,score:double,source:string,layer:bigint,st:int,en:int,value:string>"
)
_PART = "struct<h:" + _SPOT + ",st:int,en:int,before:boolean>"
_CAPTION = r"(?iU)(?:(?<![\p{L}\p{N}])(?:" + "|".join(CAPTIONS) + r")[^\p{L}\p{N}]*+)*+$"


def _cut_around(hits, fields, strong):
    """Labelled values without the stretches of findings with a higher score.

    One pass over both kinds in order of start: a stronger finding ends the part before it,
    the next value or the end of the text ends the rest.
    """
    of_field, of_strong = (f"rank IN ({', '.join(map(str, ranks))})" for ranks in (fields, strong))

    def event(kind):
        return f"_e -> named_struct('st', _e.st, 'kind', {kind}, 'en', _e.en, 'h', _e)"

    def step(s, x):
        cuts, inside = f"{x}.kind = 0", f"{s}.cur IS NOT NULL AND {s}.pos < {s}.cur.en"
        state = (
            f"named_struct('cover', CASE WHEN {cuts} THEN greatest({s}.cover, {x}.en) ELSE {s}.cover END, "
            f"'cur', CASE WHEN {cuts} THEN {s}.cur ELSE {x}.h END, "
            f"'pos', CASE WHEN {cuts} THEN greatest({s}.pos, {x}.en) ELSE greatest({x}.st, {s}.cover) END)"
        )
        part = (
            f"named_struct('h', {s}.cur, 'st', {s}.pos, 'en', CASE WHEN {cuts} THEN least({x}.st, {s}.cur.en) "
            f"ELSE {s}.cur.en END, 'before', {cuts} AND {x}.st < {s}.cur.en)"
        )
        return state, f"{inside} AND NOT ({cuts} AND {x}.st <= {s}.pos)", part

    def last(s):
        rest = f"named_struct('h', {s}.cur, 'st', {s}.pos, 'en', {s}.cur.en, 'before', false)"
        return f"CASE WHEN {s}.cur IS NOT NULL AND {s}.pos < {s}.cur.en THEN array({rest}) ELSE {empty(_PART)} END"

    zero = f"named_struct('cover', 0, 'cur', cast(NULL AS {_SPOT}), 'pos', 0)"
    events = (
        f"array_sort(concat(transform(filter(_vd, _e -> _e.{of_strong}), {event(0)}), "
        f"transform(filter(_vd, _e -> _e.{of_field}), {event(1)})))"
    )
    parts = scan(events, zero, step, _PART, last)
    # Signs beside a cut, and captions before it, are left out; the rest stays as it is.
    text = "substring(_pt.h.value, _pt.st - _pt.h.st + 1, _pt.en - _pt.st)"
    head = f"CASE WHEN _pt.before THEN regexp_replace(regexp_replace(_tx, {raw(_CAPTION)}, ''), {raw(r'(?U)[^\p{L}\p{N}]+$')}, '') ELSE _tx END"
    tail = f"CASE WHEN _pt.st > _pt.h.st THEN regexp_replace(_hd, {raw(r'(?U)^[^\p{L}\p{N}]+')}, '') ELSE _hd END"
    begin = "_pt.st + length(_hd) - length(_tl)"
    spot = (
        f"named_struct('rank', _pt.h.rank, 'entity_type', _pt.h.entity_type, 'score', _pt.h.score, 'source', _pt.h.source, "
        f"'layer', _pt.h.layer, 'st', {begin}, 'en', {begin} + length(_tl), 'value', _tl)"
    )
    kept = f"transform({parts}, _pt -> {let('_tx', text, let('_hd', head, let('_tl', tail, spot)))})"
    others = f"filter(_vd, _e -> NOT _e.{of_field})"
    cut = f"concat({others}, filter({kept}, _e -> _e.value <> ''))"
    both = f"exists(_vd, _e -> _e.{of_field}) AND exists(_vd, _e -> _e.{of_strong})"
    return let("_vd", hits, f"CASE WHEN {both} THEN {cut} ELSE _vd END")


def hits_sql(text, recognizers=None):
    """All findings of ``recognizers`` in ``text`` as an array of HIT structs.

    Order: recognizer, then position.  Failed checksums are filtered; labelled values are
    split into the items of a list and cut around findings of a higher score.
    """
    recognizers = ALL_LAYERS if recognizers is None else recognizers

    def matches(i, r):
        what = (text, r.pattern, r.value_group, r.label_group or 0)
        found = f"CASE WHEN _t.mk THEN {find_parts_slowly(*what)} ELSE {find_parts(*what)} END"
        return f"CASE WHEN {_worth_it(r, text)} THEN named_struct('rank', {i}, 'found', {found}) END"

    every = ", ".join(matches(i, r) for i, r in enumerate(recognizers))
    looked_up = (
        f"named_struct('dg', CASE WHEN _tl.asc THEN contains(_tl.sh, '0') ELSE rlike({text}, r'(?U)\\d') END, "
        f"'ds', CASE WHEN _tl.asc THEN contains(_tl.sh, '000') ELSE rlike({text}, r'(?U)\\d{{3}}') END, "
        f"'asc', _tl.asc, 'sh', _tl.sh, 'lo', lower({text}), 'mk', contains({text}, '{MARK}'))"
    )
    shape = f"named_struct('asc', octet_length({text}) = length({text}), 'sh', translate({text}, '123456789', '000000000'))"
    raw_matches = let("_tl", shape, let("_t", looked_up, f"array({every})"))

    fields = [i for i, r in enumerate(recognizers) if r.label_group]
    spots = place_parts("_m.found")
    if fields:
        spots = let("_ps", spots, f"CASE WHEN _m.rank IN ({', '.join(map(str, fields))}) THEN {_items('_ps')} ELSE _ps END")
    # What a recognizer says of all its findings; a label says the type of its own.
    known = ", ".join(
        f"named_struct('kind', {quoted(r.entity_type) if r.entity_type else 'cast(NULL AS string)'}, 'score', {r.score}D, "
        f"'source', '{r.source}', 'layer', {LAYERS[r.source] * LAYER_SPAN}L)"
        for r in recognizers
    )
    label = f"try_element_at({constant_map(FIELD_WORDS)}, lower(_pl.label))"
    locate = let("_k", f"get(array({known}), _m.rank)", (
        f"transform({spots}, _pl -> named_struct('rank', _m.rank, "
        f"'entity_type', coalesce(_k.kind, {normalize_label(label)}), "
        "'score', _k.score, 'source', _k.source, 'layer', _k.layer, 'st', _pl.st, 'en', _pl.en, "
        "'value', _pl.value))"
    ))
    placed = f"flatten(transform(filter({raw_matches}, _m -> size(_m.found) > 1), _m -> {locate}))"
    valid = f"filter({placed}, _h -> {_checked('_h', recognizers)})"
    strong = [i for i, r in enumerate(recognizers) if _stronger(r)]
    if fields and strong:
        valid = _cut_around(valid, fields, strong)
    # The category of a recognizer's own type is known before any text is read.
    listed = ", ".join(
        category_of(quoted(r.entity_type)) if r.entity_type else "NULL" for r in recognizers
    )
    category = f"get(array({listed}), _h.rank)"
    if fields:
        category = f"coalesce({category}, {category_of('_h.entity_type')})"
    hit = let(
        "_c",
        category,
        "named_struct('st', _h.st, 'neg', -_h.score, 'ord', _h.layer + _o, 'en', _h.en, 'sc', _h.score, "
        "'entity_type', _h.entity_type, 'category', _c.category, 'value', _h.value, "
        "'risk', _c.risk, 'source', _h.source, 'reason', _c.reason)",
    )
    return f"cast(transform({valid}, (_h, _o) -> {hit}) AS array<{HIT}>)"


def find(docs, recognizers=None):
    """Findings of ``recognizers`` as a table, one row each, offsets included."""
    return inline_hits(docs, hits_sql("text", recognizers))


def find_regex(docs):
    """The nine patterns of the regex layer, unfiltered (MRN hits included)."""
    return find(docs, REGEX_LAYER)


def find_rules(docs):
    return find(docs, RULES_LAYER)


def find_fields(docs):
    return find(docs, LABEL_LAYER)


def inline_hits(docs, hits, order=False):
    """A table of findings out of an expression for an array of HIT structs.

    The expression goes straight into the generator.  Had it a column of its own,
    Catalyst would infer the filter ``size(column) > 0`` and, pushing it down,
    evaluate the whole expression twice.
    """
    columns = [
        "doc_id", "entity_type", "category", "value", F.col("st").alias("span_start"),
        F.col("en").alias("span_end"), F.col("sc").alias("score"), "risk", "source", "reason",
    ]
    if order:
        columns.append(F.col("ord").cast("long").alias("ord"))
    return docs.select("doc_id", F.inline(F.expr(hits))).select(*columns)
