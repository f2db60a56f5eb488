"""The registered queries again, as SQL for DuckDB.

Written with joins, windows and recursion over exploded hits, not with the array
expressions of the library, and with its own patterns for the rules layer, the labelled
fields and the word rule.  Shared with the library are fixed tables only: names of types
and labels, categories, scores, the patterns of the regex layer.
"""

from __future__ import annotations

from veilmark import vocab
from veilmark.operators.recognize import FIELD_WORDS
from veilmark.sources.rules import packaged_rules
from workload import fixtures as fx


def q(text):
    return "'" + text.replace("'", "''") + "'"


# DuckDB patterns have no look-around.  For the one pattern that needs it, every run
# of digits is put between two marks, and a plus sign after a digit is replaced, so
# that "no digit before or after" can be written out.  Marks do not count in lengths.
DIGIT_MARKS = (
    "replace(regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g'), "
    "chr(2) || '+', chr(2) || chr(4))"
)
_SEP = r"(?:\x02[\-\s]\x01)?"
PLAIN = {
    "PHONE_NUMBER_IN": r"(?:\+?\x0191" + _SEP + r"|\x01)[6-9]\d{4}" + _SEP + r"\d{5}\x02"
}

DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_D = f"cast(substr({DIGITS}, j, 1) AS int)"
LUHN = (
    f"length({DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), "
    f"lambda j: CASE WHEN (length({DIGITS}) - j) % 2 = 1 THEN 2 * {_D} - "
    f"CASE WHEN {_D} > 4 THEN 9 ELSE 0 END ELSE {_D} END)) % 10 = 0"
)
_V = "replace(value, ' ', '')"
IBAN = (
    f"list_reduce(list_transform(string_split(array_to_string(list_transform(string_split("
    f"substr({_V}, 5) || substr({_V}, 1, 4), ''), "
    "lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN cast(ascii(c) - 55 AS varchar) ELSE c END), ''), ''), "
    "lambda d: cast(d AS int)), lambda a, d: (a * 10 + d) % 97) = 1"
)
SSN = (
    "value[1:3] NOT IN ('000', '666') AND value[1:1] <> '9' AND value[5:6] <> '00' "
    "AND value[8:11] <> '0000'"
)
IPV4 = "list_max(list_transform(string_split(value, '.'), lambda o: cast(o AS int))) <= 255"
IPV6 = (
    "NOT contains(value, '::') OR "
    "len(list_filter(string_split(value, ':'), lambda g: g <> '')) <= 7"
)


def _n(i):
    return f"cast(substr(value, {i}, 1) AS int)"


DEA = f"({_n(3)} + {_n(5)} + {_n(7)} + 2 * ({_n(4)} + {_n(6)} + {_n(8)})) % 10 = {_n(9)}"
CHECKS = {
    "card": LUHN, "card_long": LUHN, "iban": IBAN, "ssn": SSN, "ipv4": IPV4, "ipv6": IPV6,
    "medical_license": DEA, "driver_license": "regexp_matches(value, '[0-9]')",
}

FIELD_TYPE = "CASE lower(label) " + " ".join(
    f"WHEN {q(w)} THEN {q(vocab.LABEL_RENAMES.get(kind, kind.replace(' ', '_')))}"
    for w, kind in FIELD_WORDS.items()
) + " END"

CATEGORY_VALUES = ", ".join(
    f"({q(kind)}, {q(c)}, {q(risk)}, {q(why)})"
    for kind, (c, risk, why) in vocab.CATEGORY_TABLE.items()
)
CATS = f"cats(kind, category, risk, reason) AS (VALUES {CATEGORY_VALUES})"
#: Words that name findings with a score over that of fields.
CAPTIONS = (
    "aadhaar address card code credit cvv email iban license medical npi number pan phone routing street zip"
).split()
DENIED = "(" + ", ".join(q(t) for t in vocab.DENYLIST) + ")"


class Rec:
    def __init__(self, name, kind, pattern, score, source, group=0, label=0, check="true"):
        self.name, self.kind, self.pattern, self.score = name, kind, pattern, score
        self.source, self.group, self.label, self.check = source, group, label, check


# The rules layer in words of its own: (name, type, pattern, score, group).
_AREA, _TAIL = r"[2-9]\d\d", r"\d\d\d[ .\-]\d\d\d\d"
_SEPARATED = r"(?: (?:no\.?|number))?(?: |:|#)+"
_MONTH = "(?:" + "|".join(
    "January Jan February Feb March Mar April Apr May June Jun July Jul August Aug September Sept Sep "
    "October Oct November Nov December Dec".split()
) + ")"
_HEX = "[0-9a-f]{1,4}"
_IBANS = "|".join(
    cc + r"\d\d" + r" ?[A-Z\d]{4}" * ((n - 4) // 4) + (" ?" + r"[A-Z\d]" * ((n - 4) % 4) if n % 4 else "")
    for cc, n in vocab.IBAN_LENGTHS.items()
)
RULES = [
    Rec(name, kind, ("" if name == "iban" else "(?i)") + pattern, score, "rules", group, 0, CHECKS.get(name, "true"))
    for name, kind, pattern, score, group in [
        ("email", "EMAIL_ADDRESS", r"\b[\w.%+\-]+@(?:[a-z\d\-]+\.)+(?:xn--[a-z\d\-]*[a-z\d]|[a-z][a-z]+)\b", 1.0, 0),
        ("phone", "PHONE_NUMBER", rf"(?:(?:\+|\+\b|\b)1[ .\-]?)?(?:\({_AREA}\)[ .\-]?|\b{_AREA}[ .\-]){_TAIL}\b", 0.75, 0),
        ("phone_abroad", "PHONE_NUMBER", r"\+[1-9]\d?\d?[ .\-]\d{2,4}(?:[ .\-]\d{3,4}){2}\b", 0.75, 0),
        ("ssn", "US_SSN", r"\b\d\d\d-\d\d-\d\d\d\d\b", 0.85, 0),
        ("driver_license", "US_DRIVER_LICENSE", rf"\b(?:dl|driver.?s? license|driver.?s? licence){_SEPARATED}([a-z\d]{{6,14}})\b", 0.6, 1),
        ("passport", "US_PASSPORT", rf"\bpassport{_SEPARATED}((?:[a-z]|)\d{{7,9}})\b", 0.6, 1),
        ("date", "DATE_TIME", r"\b(?:\d{4}(?:-\d\d){2}|(?:\d\d?/){2}\d{2,4})\b", 0.6, 0),
        ("date_in_words", "DATE_TIME", rf"\b{_MONTH}(?:\.|) \d\d?(?:,|) \d{{4}}\b", 0.6, 0),
        ("ipv4", "IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.95, 0),
        ("ipv6", "IP_ADDRESS", rf"\b{_HEX}(?::{_HEX}){{7}}\b|\b(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}\b", 0.95, 0),
        ("medical_license", "MEDICAL_LICENSE", rf"\b(?:dea|medical license|medical licence){_SEPARATED}([a-z][a-z9]\d{{7}})\b", 1.0, 1),
        ("bank_number", "US_BANK_NUMBER", rf"\b(?:account|acct){_SEPARATED}(\d{{8,17}})\b", 0.5, 1),
        ("card_long", "CREDIT_CARD", r"\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d\d?\d?\b", 1.0, 0),
        ("card", "CREDIT_CARD", r"\b\d{4}(?:[ \-]?\d{3,6})(?:[ \-]?\d{3,6})(?:[ \-]?\d{3,6})?\b", 1.0, 0),
        ("iban", "IBAN_CODE", rf"\b(?:{_IBANS})\b", 1.0, 0),
    ]
]

# Labelled fields: a mark before each label and in place of each comma before words and a
# colon, where a value ends.
_LABEL_WORDS = "|".join(FIELD_WORDS)
FIELD_MARKS = (
    "regexp_replace(regexp_replace(text, ',([ \t\n]*\\pL[\\pL\\pN .''/\\-]{0,39}[:#])', chr(5) || '\\1', 'g'), "
    f"'(?i)(\\b(?:{_LABEL_WORDS})[ \t]*[:#])', chr(1) || '\\1', 'g')"
)
FIELDS = [
    Rec(
        "fields", None,
        rf"(?i)\x01({_LABEL_WORDS})[ \t]*[:#][ \t]*([^|(\n;\x01\x05]*[^|(\s;,\x01\x05])", 0.9, "ner", 2, 1,
    )
]
REGEX = [
    Rec(kind.lower(), kind, "(?i)" + PLAIN.get(kind, p), vocab.REGEX_SCORE, "regex")
    for kind, p in vocab.REGEX_PATTERNS.items()
]
ALL = RULES + FIELDS + REGEX


def hits(src, recs):
    """Hits with offsets: doc_id, entity_type, value, st, en, sc, source, pat, i."""
    parts = []
    for pat, r in enumerate(recs):
        p = q(r.pattern)
        marked = r.kind in PLAIN or r.name == "fields"
        marks = FIELD_MARKS if r.name == "fields" else DIGIT_MARKS
        table = f"(SELECT doc_id, {marks} AS text FROM {src})" if marked else src

        def clean(x):
            return f"replace(replace({x}, chr(1), ''), chr(2), '')" if marked else x

        kind = q(r.kind) if r.kind else FIELD_TYPE
        parts.append(f"""
SELECT doc_id, {kind} AS entity_type, value, en - length(value) AS st, en,
  cast({r.score} AS double) AS sc, '{r.source}' AS source, {pat} AS pat, i
FROM (
  SELECT doc_id, {clean('v[i]')} AS value, lab[i] AS label, i,
    cast(list_sum(list_transform(s[1:i], lambda x: length({clean('x')})))
      + list_sum(list_transform(m[1:i], lambda x: length({clean('x')}))) AS bigint) AS en
  FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS i
    FROM (
      SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m,
        regexp_extract_all(text, {p}, {r.group}) AS v,
        regexp_extract_all(text, {p}, {r.label}) AS lab, string_split_regex(text, {p}) AS s
      FROM {table} WHERE regexp_matches(text, {p}))))
WHERE {r.check}""")
    own = [i for i, r in enumerate(recs) if r.name == "fields"]
    if own:
        strong = [p for p, r in zip(parts, recs) if r.score > 0.9 and r.kind != "MRN"]
        parts[own[0]] = pieces(items(parts[own[0]]), " UNION ALL ".join(f"({p})" for p in strong))
    return "SELECT * FROM (" + "\nUNION ALL ".join(f"({p})" for p in parts) + ")"


def items(values):
    """Labelled values split into items; a sign of equal length hides the comma of a date."""
    comma = "'[ \t]*,+[ \t]+'"
    return f"""
SELECT doc_id, entity_type, replace(s[j], chr(6), ',') AS value, place AS st, place + length(s[j]) AS en, sc, source, pat,
  i * 1000 + j AS i
FROM (
  SELECT *, cast(st + coalesce(list_sum(list_transform(s[1:j-1], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))), 0) AS bigint) AS place
  FROM (
    SELECT *, unnest(range(1, len(s) + 1)) AS j
    FROM (
      SELECT *, string_split_regex(v, {comma}) AS s, regexp_extract_all(v, {comma}, 0) AS m
      FROM (SELECT *, regexp_replace(value, ',( [12][0-9][0-9][0-9]\\b)', chr(6) || '\\1', 'g') AS v FROM ({values})))))
WHERE s[j] <> ''"""


def pieces(values, strong):
    """What stronger findings leave of the items: the gaps between them, and the rest."""
    if not strong:
        return values
    words = "|".join(CAPTIONS)
    return f"""
WITH item AS MATERIALIZED ({values}), cut AS MATERIALIZED (
  SELECT t.doc_id, t.st, s.st AS a, s.en AS b,
    max(s.en) OVER (PARTITION BY t.doc_id, t.st ORDER BY s.st, s.en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
  FROM item t JOIN ({strong}) s ON s.doc_id = t.doc_id AND s.st < t.en AND s.en > t.st
), gap AS (
  SELECT doc_id, st, greatest(st, coalesce(done, st)) AS a, a AS b, true AS before FROM cut
  UNION ALL SELECT c.doc_id, c.st, max(c.b), any_value(t.en), false
  FROM cut c JOIN item t ON t.doc_id = c.doc_id AND t.st = c.st GROUP BY c.doc_id, c.st
), part AS (
  SELECT t.*, g.a, g.before, substr(t.value, g.a - t.st + 1, g.b - g.a) AS v
  FROM gap g JOIN item t ON t.doc_id = g.doc_id AND t.st = g.st WHERE g.b > g.a
), trimmed AS (
  SELECT *, CASE WHEN a > st THEN regexp_replace(w, '^[^\\pL\\pN]+', '') ELSE w END AS x
  FROM (SELECT *, CASE WHEN before THEN regexp_replace(
    regexp_replace(' ' || v, '(?i)(?:[^\\pL\\pN]+(?:{words}))*[^\\pL\\pN]*$', ''), '^ ', '') ELSE v END AS w FROM part)
)
SELECT doc_id, entity_type, value, st, en, sc, source, pat, i FROM item
WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.doc_id = item.doc_id AND cut.st = item.st)
UNION ALL
SELECT doc_id, entity_type, x, a + length(w) - length(x), a + length(w), sc, source, pat, i FROM trimmed WHERE x <> ''"""


def categorized(rows):
    return f"""
SELECT h.*, coalesce(lo.category, ex.category, 'Other') AS category,
  coalesce(lo.risk, ex.risk, 'Medium') AS risk,
  coalesce(lo.reason, ex.reason, {q(vocab.UNKNOWN_REASON)} || h.entity_type) AS reason
FROM ({rows}) h
LEFT JOIN cats lo ON lo.kind = lower(h.entity_type)
LEFT JOIN cats ex ON ex.kind = h.entity_type"""


def overlap_scan(name, rows):
    """CTEs ending in ``name``: rows kept by the overlap scan; rows carry ``n`` as order."""
    return f"""
{name}_o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, sc DESC, n) AS rn FROM ({rows})),
{name}_w AS (
  SELECT doc_id, rn, rn AS win, en AS le, sc, true AS opened FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.rn,
    CASE WHEN o.st >= w.le OR o.sc > w.sc THEN o.rn ELSE w.win END,
    CASE WHEN o.st >= w.le THEN o.en ELSE w.le END,
    CASE WHEN o.st >= w.le OR o.sc > w.sc THEN o.sc ELSE w.sc END,
    o.st >= w.le
  FROM {name}_w w JOIN {name}_o o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
{name}_g AS (
  SELECT *, sum(CASE WHEN opened THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS grp
  FROM {name}_w),
{name} AS MATERIALIZED (
  SELECT o.* FROM (SELECT doc_id, grp, max_by(win, rn) AS win FROM {name}_g GROUP BY ALL) x
  JOIN {name}_o o ON o.doc_id = x.doc_id AND o.rn = x.win)"""


def source(name, sql):
    return f"{name} AS MATERIALIZED ({sql})"


# Rules and names first, then labels and models, then regex; inside, as recognizers stand.
ARRIVAL = (
    "(CASE source WHEN 'rules' THEN 0 WHEN 'ner' THEN 1 ELSE 2 END) * 1000000000000 "
    "+ cast(pat AS bigint) * 100000000 + i"
)


def found_ctes(src_sql, recs=ALL, more=""):
    """CTEs src and found: the full detection on (doc_id, text)."""
    rows = f"SELECT *, {ARRIVAL} AS n FROM ({hits('src', recs)} {more})"
    kept = (
        f"SELECT * FROM ({categorized(rows)}) "
        f"WHERE lower(trim(value, ' ' || chr(9) || chr(10) || chr(13))) NOT IN {DENIED} "
        "AND category <> 'Other'"
    )
    return ", ".join([source("src", src_sql), CATS, overlap_scan("found", kept)])


FINDING = (
    "doc_id, entity_type, category, value, cast(st AS int) AS span_start, "
    "cast(en AS int) AS span_end, sc AS score, risk, source"
)
FOUND_MEMO = found_ctes(fx.MEMO)
FOUND_DOSSIER = found_ctes(fx.DOSSIER)
FOUND_DOCUMENTS = found_ctes("SELECT doc_id, text FROM documents")
FOUND_NOTES = found_ctes(fx.NOTES)

out = {}


def register(name, sql):
    out[name] = sql


# ---- recognizers ----------------------------------------------------------
def find_query(src_sql, recs):
    return (
        f"WITH {source('src', src_sql)}, {CATS} SELECT {FINDING} FROM "
        f"({categorized(hits('src', recs))})"
    )


for r in REGEX:
    register(f"find_{r.name}", find_query(fx.MEMO, [r]))
register("find_regex", find_query(fx.MEMO, REGEX))
BY_NAME = {r.name: r for r in RULES}
DOCS = "SELECT doc_id, text FROM documents"
for name, src_sql, recs in [
    ("find_email", DOCS, ["email"]),
    ("find_phone", DOCS, ["phone", "phone_abroad"]),
    ("find_ip", DOCS, ["ipv4", "ipv6"]),
    ("find_card", DOCS, ["card_long", "card"]),
    ("find_card_dossier", fx.DOSSIER, ["card_long", "card"]),
    ("find_email_dossier", fx.DOSSIER, ["email"]),
    ("find_ssn", fx.MEMO, ["ssn"]),
    ("find_driver_license", fx.DOSSIER, ["driver_license"]),
    ("find_passport", fx.DOSSIER, ["passport"]),
    ("find_date", fx.DOSSIER, ["date", "date_in_words"]),
    ("find_ip_dossier", fx.DOSSIER, ["ipv4", "ipv6"]),
    ("find_medical_license", fx.DOSSIER, ["medical_license"]),
    ("find_bank_number", fx.DOSSIER, ["bank_number"]),
    ("find_iban", fx.DOSSIER, ["iban"]),
    ("find_rules", fx.MEMO, [r.name for r in RULES]),
]:
    register(name, find_query(src_sql, [BY_NAME[n] for n in recs]))
register("find_fields", find_query(fx.DOSSIER, FIELDS))

# Words with offsets, then runs of words that single blanks join, grown by recursion as
# long as some term goes on.
_SIGN = r"[\pL\pM\pN]"
_OWN_WORD = _SIGN + "+(?:[-_#.’'" + "]" + _SIGN + "+)*"
_TOKENS = f"""
tok AS MATERIALIZED (
  SELECT doc_id, value, i, gap,
    cast(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) AS bigint) AS en
  FROM (
    SELECT doc_id, m[i] AS value, s[i] AS gap, i
    FROM (
      SELECT *, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {q(_OWN_WORD)}, 0) AS m,
              string_split_regex(text, {q(_OWN_WORD)}) AS s FROM src))))"""
_RUNS = """
begun AS (SELECT DISTINCT array_to_string(string_split(term, ' ')[1:k], ' ') AS head
  FROM (SELECT term, unnest(range(1, len(string_split(term, ' ')) + 1)) AS k FROM terms)),
runs AS (
  SELECT doc_id, value AS gram, en - length(value) AS st, en, i FROM tok JOIN begun ON head = value
  UNION ALL
  SELECT r.doc_id, r.gram || ' ' || b.value, r.st, b.en, b.i
  FROM runs r JOIN tok b ON b.doc_id = r.doc_id AND b.i = r.i + 1 AND b.gap = ' '
  JOIN begun ON head = r.gram || ' ' || b.value)"""
_NAMED = """
SELECT doc_id, entity_type, gram AS value, st, en, cast(0.85 AS double) AS sc, 'rules' AS source,
  900 AS pat, 1000 - (en - st) AS i FROM runs JOIN terms ON gram = term"""
_DICT = f"{source('terms', fx.TERMS)}, {_TOKENS}, {_RUNS}"


def dictionary_query(src_sql):
    return (
        f"WITH RECURSIVE {source('src', src_sql)}, {CATS}, {_DICT} SELECT {FINDING} "
        f"FROM ({categorized(_NAMED)})"
    )


register("find_dictionary", dictionary_query(fx.MEMO))
register("find_dictionary_dossier", dictionary_query(fx.DOSSIER))
register(
    "chunk_text",
    """SELECT doc_id, cast(c AS int) AS chunk, cast(c * 2000 AS int) AS chunk_start,
  substring(text, c * 2000 + 1, 2000) AS chunk_text
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS c FROM documents
      WHERE length(text) > 0)""",
)
_LABEL = "CASE label " + " ".join(
    f"WHEN {q(a)} THEN {q(b)}" for a, b in vocab.LABEL_RENAMES.items()
) + " ELSE replace(label, ' ', '_') END"
register(
    "normalize_label",
    f"SELECT label, {_LABEL} AS entity_type, count(*) AS n FROM ({fx.MODEL_HITS}) GROUP BY ALL",
)
register(
    "min_score",
    f"SELECT doc_id, chunk, label, score FROM ({fx.MODEL_HITS}) WHERE score >= 0.5",
)
_MODEL = f"""
SELECT doc_id, {_LABEL} AS entity_type, value, span_start + chunk * 2000 AS st,
  span_end + chunk * 2000 AS en, score AS sc, 'ner' AS source
FROM ({fx.MODEL_HITS}) WHERE score >= 0.5"""
register("external_findings", f"WITH {CATS} SELECT {FINDING} FROM ({categorized(_MODEL)})")

# ---- findings -------------------------------------------------------------
register(
    "categorize",
    f"WITH {CATS} SELECT entity_type, category, risk, reason, count(*) AS n "
    f"FROM ({categorized(_MODEL)}) GROUP BY ALL",
)
_TRIM = "lower(trim(value, ' ' || chr(9) || chr(10) || chr(13)))"
register(
    "drop_denylisted",
    f"WITH {CATS} SELECT {FINDING} FROM ({categorized(_MODEL)}) WHERE {_TRIM} NOT IN {DENIED}",
)
register(
    "drop_other",
    f"WITH {source('src', fx.MEMO)}, {CATS} SELECT {FINDING} FROM "
    f"({categorized(hits('src', REGEX))}) WHERE category <> 'Other'",
)
register(
    "union_layers",
    f"WITH {source('src', fx.MEMO)}, {CATS} SELECT layer_rank, {FINDING} FROM ("
    f"SELECT 0 AS layer_rank, * FROM ({categorized(hits('src', RULES))}) UNION ALL "
    f"SELECT 1, * FROM ({categorized(hits('src', FIELDS))}) UNION ALL "
    f"SELECT 2, * FROM ({categorized(hits('src', REGEX))}))",
)
SPANS_KEPT = overlap_scan("kept", f"SELECT *, ord AS n FROM ({fx.SPANS})")
register(
    "resolve_overlaps",
    f"WITH RECURSIVE {SPANS_KEPT} SELECT DISTINCT doc_id, ord, st, en, sc FROM kept",
)
register("detect", f"WITH RECURSIVE {FOUND_MEMO} SELECT {FINDING} FROM found")
register("detect_dossier", f"WITH RECURSIVE {FOUND_DOSSIER} SELECT {FINDING} FROM found")
register("detect_documents", f"WITH RECURSIVE {FOUND_DOCUMENTS} SELECT {FINDING} FROM found")
register("scan_stream", out["detect_documents"])
register("stored_findings", out["detect_documents"])
_BOTH = ", ".join(
    [
        source("src", fx.MEMO), CATS, _DICT,
        overlap_scan(
            "found",
            "SELECT * FROM ("
            + categorized(
                f"SELECT *, {ARRIVAL} AS n FROM ({hits('src', ALL)} UNION ALL {_NAMED})"
            )
            + f") WHERE {_TRIM} NOT IN {DENIED} AND category <> 'Other'",
        ),
    ]
)
register("detect_with_names", f"WITH RECURSIVE {_BOTH} SELECT {FINDING} FROM found")


def _count(col, name):
    return f"count(CASE WHEN {col} = '{name}' THEN 1 END)"


_TALLY = ", ".join(
    [f"{_count('category', c)} AS n_{c.lower()}" for c in vocab.CATEGORIES]
    + [f"{_count('risk', r)} AS n_{r.lower()}" for r in vocab.RISKS]
    + [f"{_count('source', s)} AS n_{s}" for s in vocab.SOURCES]
)
_RISK = (
    f"CASE WHEN {_count('risk', 'High')} > 0 THEN 'High' "
    f"WHEN {_count('risk', 'Medium')} > 0 THEN 'Medium' ELSE 'Low' END"
)
SUMMARY = (
    f"SELECT src.doc_id, count(entity_type) AS total, {_TALLY}, {_RISK} AS overall_risk "
    "FROM src LEFT JOIN found ON found.doc_id = src.doc_id GROUP BY src.doc_id"
)
register("summarize", f"WITH RECURSIVE {FOUND_MEMO} {SUMMARY}")
register("summarize_table", f"WITH RECURSIVE {FOUND_DOSSIER} {SUMMARY}")
register(
    "headline_counts",
    f"WITH RECURSIVE {FOUND_MEMO} SELECT doc_id, n_pii AS pii, n_phi AS phi, n_financial AS financial, "
    f"n_pii + n_phi + n_financial AS shown_total, overall_risk FROM ({SUMMARY})",
)
register(
    "corpus_summary",
    f"WITH RECURSIVE {FOUND_MEMO} SELECT category, entity_type, count(*) AS total, "
    + ", ".join(f"{_count('risk', r)} AS risk_{r.lower()}" for r in vocab.RISKS)
    + ", max(sc) AS top_score FROM found GROUP BY ROLLUP (category, entity_type)",
)
register("corpus_summary_merged", out["corpus_summary"])
SETS = (
    "sets AS (SELECT src.doc_id, coalesce(string_agg(DISTINCT entity_type, ', ' ORDER BY entity_type), '') "
    "AS types FROM src LEFT JOIN found ON found.doc_id = src.doc_id GROUP BY src.doc_id)"
)
register("entity_set", f"WITH RECURSIVE {FOUND_MEMO}, {SETS} SELECT doc_id, types FROM sets")

# ---- compliance -----------------------------------------------------------
RULE_VALUES = ", ".join(
    "({}, {}, {}, {}, {}, [{}], {})".format(
        i, q(r["id"]), q(r["framework"]), q(r["rule"]), q(r["description"]),
        ", ".join(q(t) for t in r["entity_types"]), q(r["risk"]),
    )
    for i, r in enumerate(packaged_rules())
)
RULE_TABLE = (
    f"rules(i, id, framework, rule, description, entity_types, risk) AS (VALUES {RULE_VALUES})"
)
QUERY_TEXT = f"CASE WHEN types <> '' THEN {q(vocab.QUERY_PREFIX)} || types END"
register(
    "query_text",
    f"WITH RECURSIVE {FOUND_MEMO}, {SETS} SELECT doc_id, {QUERY_TEXT} AS query_text FROM sets",
)
register(
    "rules_by_type",
    f"""WITH RECURSIVE {FOUND_MEMO}, {RULE_TABLE},
kinds AS (SELECT i, unnest(entity_types) AS kind FROM rules)
SELECT doc_id, id AS rule_id, framework, rule, rules.risk, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS matched_types
FROM found JOIN kinds ON kind = entity_type JOIN rules ON rules.i = kinds.i GROUP BY ALL""",
)
RULE_DOC = (
    "'Framework: ' || framework || '. Rule: ' || rule || '. Description: ' || description || "
    "'. Entity types: ' || array_to_string(entity_types, ', ') || '.'"
)
register(
    "rule_documents",
    f"""WITH RECURSIVE {FOUND_MEMO}, {RULE_TABLE},
kinds AS (SELECT i, unnest(entity_types) AS kind FROM rules)
SELECT id AS rule_id, {RULE_DOC} AS document, count(found.doc_id) AS findings
FROM rules JOIN kinds ON rules.i = kinds.i LEFT JOIN found ON kind = entity_type GROUP BY ALL""",
)
register(
    "rule_vectors",
    f"""WITH RECURSIVE {FOUND_MEMO}, {RULE_TABLE},
terms AS (SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(regexp_extract_all(lower({RULE_DOC}), '[a-z0-9]+')) AS term FROM rules) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM rules)) / (1 + count(*))) + 1 AS idf FROM terms GROUP BY term),
norms AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM terms JOIN idf USING (term) GROUP BY id),
kinds AS (SELECT id, unnest(entity_types) AS kind FROM rules),
named AS (SELECT kinds.id, count(*) AS findings FROM kinds JOIN found ON found.entity_type = kind GROUP BY kinds.id)
SELECT id AS rule_id, term, round(idf, 6) AS idf, round(tf * idf / norm, 6) AS rw, findings
FROM terms JOIN idf USING (term) JOIN norms USING (id) JOIN named USING (id)""",
)
# TF-IDF cosine between each distinct set of types and each rule.
VECTORS = f"""
{RULE_TABLE},
rt AS (SELECT i, term, count(*) AS tf FROM (
  SELECT i, unnest(regexp_extract_all(lower({RULE_DOC}), '[a-z0-9]+')) AS term FROM rules) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM rules)) / (1 + count(*))) + 1 AS idf FROM rt GROUP BY term),
rw AS (SELECT i, term, tf * idf AS w FROM rt JOIN idf USING (term)),
rn AS (SELECT i, sqrt(sum(w * w)) AS norm FROM rw GROUP BY i),
asked AS (SELECT DISTINCT types FROM sets WHERE types <> ''),
qt AS (SELECT types, term, count(*) AS tf FROM (
  SELECT types, unnest(regexp_extract_all(lower({QUERY_TEXT}), '[a-z0-9]+')) AS term FROM asked) GROUP BY ALL),
qw AS (SELECT types, term, tf * idf AS w FROM qt JOIN idf USING (term)),
qn AS (SELECT types, sqrt(sum(w * w)) AS norm FROM qw GROUP BY types),
dots AS (SELECT types, i, sum(qw.w * rw.w) AS dot FROM qw JOIN rw USING (term) GROUP BY ALL),
scored AS (
  SELECT asked.types, rules.i, round(coalesce(dot / (qn.norm * rn.norm), 0), 9) AS exact
  FROM asked JOIN rules ON true JOIN rn USING (i) LEFT JOIN qn ON qn.types = asked.types
  LEFT JOIN dots ON dots.types = asked.types AND dots.i = rules.i),
ranked AS (
  SELECT types, i, row_number() OVER (PARTITION BY types ORDER BY exact DESC, i) AS rank,
    round(exact, 3) AS relevance FROM scored)"""
register(
    "term_cosine_topk",
    f"""WITH RECURSIVE {FOUND_MEMO}, {SETS}, {VECTORS},
byid AS (SELECT types, id, row_number() OVER (PARTITION BY types ORDER BY exact DESC, id) AS rank,
  round(exact, 3) AS relevance FROM scored JOIN rules USING (i))
SELECT types AS query_id, cast(rank AS int) AS rank, id AS rule_id, relevance FROM byid WHERE rank <= 6""",
)
register(
    "retrieve_rules",
    f"""WITH RECURSIVE {FOUND_MEMO}, {SETS}, {VECTORS}
SELECT doc_id, cast(rank AS int) AS rank, id, framework, rule, description,
  array_to_string(entity_types, ', ') AS entity_types, risk, relevance
FROM sets JOIN ranked USING (types) JOIN rules USING (i) WHERE rank <= 6""",
)
EXPOSURE = """
exposure AS (
  SELECT doc_id, framework, round(least(max(relevance * CASE risk WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6
    WHEN 'Low' THEN 0.3 ELSE 0.5 END * 100), 100), 1) AS exposure
  FROM sets JOIN ranked USING (types) JOIN rules USING (i) WHERE rank <= 20 GROUP BY ALL)"""
BAND = "CASE WHEN exposure > 70 THEN 'High exposure' WHEN exposure > 40 THEN 'Moderate' ELSE 'Low' END"
register(
    "exposure",
    f"WITH RECURSIVE {FOUND_MEMO}, {SETS}, {VECTORS}, {EXPOSURE} "
    f"SELECT doc_id, framework, exposure, {BAND} AS band FROM exposure",
)
register(
    "rank_frameworks",
    f"WITH RECURSIVE {FOUND_MEMO}, {SETS}, {VECTORS}, {EXPOSURE} "
    "SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY exposure DESC, framework) AS int) AS rank, "
    f"framework, exposure, {BAND} AS band FROM exposure",
)
register(
    "exposure_band",
    f"SELECT event_id, exposure, {BAND} AS band FROM (SELECT event_id, round(value * 2, 1) AS exposure FROM events)",
)
register(
    "cosine_topk",
    """WITH dims AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS d,
  unnest(embedding::double[]) AS x FROM embeddings),
centre AS (SELECT label, d, avg(x) AS c FROM dims GROUP BY ALL),
cn AS (SELECT label, sqrt(sum(c * c)) AS norm FROM centre GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM dims GROUP BY vec_id),
dist AS (SELECT dims.vec_id, centre.label, round(1 - sum(x * c) / (any_value(vn.norm) * any_value(cn.norm)), 9) AS distance
  FROM dims JOIN centre USING (d) JOIN cn ON cn.label = centre.label JOIN vn ON vn.vec_id = dims.vec_id
  GROUP BY ALL)
SELECT vec_id AS query_id, cast(rank AS int) AS rank, label AS id, round(1 - distance, 3) + 0.0 AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS rank FROM dist)
WHERE rank <= 5""",
)


# ---- rewriting ------------------------------------------------------------
def rewritten(mode, found="found", src="src"):
    """Query (doc_id, text) of rewritten texts from found(doc_id, st, en, sc, entity_type)."""
    value = "substring(text, st + 1, cut - st)"
    masked = " ".join(f"WHEN '{k}' THEN {n}" for k, n in vocab.MASK_CHARS.items())
    shown = f"(CASE entity_type {masked} ELSE length({value}) END)"
    apart = "true" if mode == "mask" else "false"
    stand_in = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in vocab.STAND_INS.items())
    new = {
        "redact": "'[' || entity_type || ']'",
        "mask": f"repeat('*', least({shown}, length({value}))) || substring({value}, {shown} + 1)",
        "replace": f"CASE entity_type {stand_in} ELSE '[SYNTHETIC]' END",
        "span": "''",
    }[mode]
    return f"""
outer_spans AS (
  SELECT * FROM (
    SELECT doc_id, st, en, entity_type, coalesce(max(en) OVER (PARTITION BY doc_id
      ORDER BY st, en DESC, sc DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach
    FROM {found}) WHERE en > reach),
flagged AS (
  SELECT o.*, text, CASE WHEN NOT {apart} AND lag(entity_type) OVER w = entity_type AND (st < lag(en) OVER w OR
    regexp_full_match(substring(text, lag(en) OVER w + 1, st - lag(en) OVER w), ' +')) THEN 0 ELSE 1 END AS fresh
  FROM outer_spans o JOIN {src} USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY st)),
islands AS (
  SELECT doc_id, text, entity_type, min(st) AS st, max(en) AS en FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY st) AS isle FROM flagged)
  GROUP BY doc_id, text, entity_type, isle),
edits AS (
  SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY st), 0) AS prev FROM (
    SELECT *, least(en, coalesce(lead(st) OVER (PARTITION BY doc_id ORDER BY st), en)) AS cut FROM islands)),
changed AS (
  SELECT doc_id, string_agg(substring(text, prev + 1, st - prev) || {new}, '' ORDER BY st)
    || substring(any_value(text), max(cut) + 1) AS new_text FROM edits GROUP BY doc_id)"""


def rewrite_query(ctes, mode, name, found="found"):
    return (
        f"WITH RECURSIVE {ctes}, {rewritten(mode, found)} "
        f"SELECT src.doc_id, coalesce(new_text, src.text) AS {name} "
        "FROM src LEFT JOIN changed ON changed.doc_id = src.doc_id"
    )


register("redact", rewrite_query(FOUND_MEMO, "redact", "redacted_text"))
register("mask", rewrite_query(FOUND_MEMO, "mask", "masked_text"))
register("mask_dossier", rewrite_query(FOUND_DOSSIER, "mask", "masked_text"))
register("replace_values", rewrite_query(FOUND_DOSSIER, "replace", "replaced_text"))
register("redact_documents", rewrite_query(FOUND_DOCUMENTS, "redact", "redacted_text"))

# Overlapping spans on a short text, with two types and blanks in between.
SPAN_TEXT = "repeat('ab  c d   ', 6)"
SPANS_SRC = (
    f"{SPANS_KEPT}, src AS (SELECT DISTINCT doc_id, {SPAN_TEXT} AS text FROM kept), "
    "found AS (SELECT DISTINCT doc_id, ord, st, en, sc, CASE WHEN ord % 3 = 0 THEN 'A' ELSE 'B' END AS entity_type FROM kept)"
)
register("redact_overlaps", rewrite_query(SPANS_SRC, "redact", "redacted_text"))
register("mask_overlaps", rewrite_query(SPANS_SRC, "mask", "masked_text"))
register(
    "merge_adjacent",
    f"WITH RECURSIVE {SPANS_SRC}, {rewritten('span')} "
    "SELECT doc_id, cast(st AS int) AS span_start, cast(en AS int) AS span_end, entity_type FROM islands",
)


def _esc(x, quotes=True):
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else []):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def marked(ctes, span, before, plain, after, quotes, name):
    return f"""WITH RECURSIVE {ctes},
edits AS (SELECT *, coalesce(lag(en) OVER (PARTITION BY doc_id ORDER BY st), 0) AS prev
  FROM found JOIN src USING (doc_id)),
changed AS (SELECT doc_id, string_agg(substring(text, prev + 1, st - prev) || {span}, '' ORDER BY st)
  || substring(any_value(text), max(en) + 1) AS body FROM edits GROUP BY doc_id)
SELECT src.doc_id, CASE WHEN body IS NULL THEN {plain} || {_esc('src.text', quotes)} ELSE {before} || body END
  || '{after}' AS {name} FROM src LEFT JOIN changed ON changed.doc_id = src.doc_id"""


def _style(risk):
    bg, fg, border = vocab.RISK_COLOURS[risk]
    return (
        f"'background:{bg};color:{fg};border:1px solid {border};border-radius:3px;"
        "padding:1px 4px;font-weight:600;cursor:pointer;'"
    )


RISK_SPAN = (
    f"'<span style=\"' || CASE risk WHEN 'High' THEN {_style('High')} WHEN 'Medium' THEN {_style('Medium')} "
    f"ELSE {_style('Low')} END || '\" title=\"' || entity_type || ' | ' || category || ' | ' || risk || "
    f"' risk | via ' || source || '\">' || {_esc('value')} || '</span>'"
)
RISK_HTML = marked(
    FOUND_DOSSIER, RISK_SPAN, q(vocab.PRE_MARKED), q(vocab.PRE_PLAIN), "</pre>", True,
    "highlighted_html",
)
register("highlight_risk", RISK_HTML)
CLASS_SPAN = (
    "'<span class=\"' || CASE category WHEN 'PII' THEN 'hl-pii' WHEN 'PHI' THEN 'hl-phi' "
    "WHEN 'Financial' THEN 'hl-fin' ELSE 'hl-other' END || '\" title=\"' || entity_type || ' · ' || category || "
    f"' · ' || risk || ' risk · ' || source || '\">' || {_esc('value', False)} || '</span>'"
)
register(
    "highlight_category",
    marked(
        FOUND_MEMO, CLASS_SPAN, "'<div class=\"hl-wrap\">'", "'<div class=\"hl-wrap\">'", "</div>",
        False, "category_html",
    ),
)
register(
    "escape_html",
    f"SELECT page_id, {_esc('html')} AS escaped, {_esc('html', False)} AS escaped_text FROM pages",
)
register(
    "redact_json",
    f"WITH RECURSIVE {FOUND_NOTES}, {rewritten('redact')} "
    "SELECT doc_id, new_text AS redacted_text, json_valid(new_text) AS parsed, "
    "CASE WHEN json_valid(new_text) THEN json_extract_string(new_text, '$.mail') END AS mail FROM changed",
)

# The only bare value that is found is a card number.
register(
    "redact_json_values",
    f"WITH RECURSIVE {FOUND_NOTES}, {rewritten('redact')}, "
    "whole AS (SELECT doc_id, replace(new_text, ': [CREDIT_CARD]', ': \"[CREDIT_CARD]\"') AS t FROM changed) "
    "SELECT doc_id, t AS redacted_text, json_valid(t) AS parsed, json_extract_string(t, '$.mail') AS mail, "
    "json_extract_string(t, '$.card') AS card FROM whole",
)

# ---- reports --------------------------------------------------------------
VIEW = (
    "doc_id, cast(st AS int) AS span_start, entity_type AS entity, category, "
    "CASE WHEN length(value) > 50 THEN left(value, 50) || '…' ELSE value END AS value, risk, "
    "cast(cast(round_even(sc * 100, 0) AS int) AS varchar) || '%' AS conf, source"
)
register("findings_view", f"WITH RECURSIVE {FOUND_DOSSIER} SELECT {VIEW} FROM found")
register("snippet", "SELECT doc_id, left(text, 500) AS snippet FROM documents")


def line_ctes(value):
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS k FROM found),
flines AS (SELECT doc_id, count(*) AS total, {_count('risk', 'High')} AS high_risk,
  string_agg('  - ' || entity_type || ' (' || category || ', ' || risk || ' risk): ''' || {value} || '''',
    chr(10) ORDER BY k) FILTER (WHERE k <= 12) AS finding_lines FROM numbered GROUP BY doc_id),
top6 AS (SELECT doc_id, rank, framework, rule FROM sets JOIN ranked USING (types) JOIN rules USING (i) WHERE rank <= 6),
rlines AS (SELECT doc_id, string_agg('  - [' || framework || '] ' || rule, chr(10) ORDER BY rank)
    FILTER (WHERE rank <= 5) AS rule_lines,
  string_agg(DISTINCT framework, ', ' ORDER BY framework) AS frameworks FROM top6 GROUP BY doc_id)"""


register(
    "report_lines",
    f"""WITH RECURSIVE {FOUND_DOSSIER}, {SETS}, {VECTORS}, {line_ctes('left(value, 40)')}
SELECT src.doc_id, coalesce(total, 0) AS total, coalesce(high_risk, 0) AS high_risk,
  coalesce(finding_lines, '') AS finding_lines, coalesce(rule_lines, '') AS rule_lines,
  coalesce(frameworks, '') AS frameworks
FROM src LEFT JOIN flines ON flines.doc_id = src.doc_id LEFT JOIN rlines ON rlines.doc_id = src.doc_id""",
)
PROMPT = (
    "'Act as a privacy reviewer. Be brief and factual; suggest, do not give legal advice.' || chr(10) || chr(10) || "
    "'TEXT EXCERPT:' || chr(10) || left(new_text, 500) || chr(10) || chr(10) || "
    "'FINDINGS (' || total || ' in all, ' || high_risk || ' of high risk):' || chr(10) || finding_lines || chr(10) || chr(10) || "
    "'RULES THAT MAY APPLY:' || chr(10) || rule_lines || chr(10) || chr(10) || 'FRAMEWORKS: ' || frameworks || chr(10) || chr(10) || "
    "'Answer in three sentences: the overall risk, the most serious finding and why, and one step to take.'"
)
TYPE_VALUE = "'[' || entity_type || ']'"
register(
    "explanation_prompt",
    f"""WITH RECURSIVE {FOUND_DOSSIER}, {SETS}, {VECTORS}, {line_ctes(TYPE_VALUE)}, {rewritten('redact')}
SELECT src.doc_id, {PROMPT} AS prompt FROM src LEFT JOIN changed ON changed.doc_id = src.doc_id
LEFT JOIN flines ON flines.doc_id = src.doc_id LEFT JOIN rlines ON rlines.doc_id = src.doc_id""",
)
register(
    "finding_prompt",
    f"""WITH RECURSIVE {FOUND_MEMO} SELECT entity_type,
'In two sentences: why is a field of type ' || entity_type || ' (' || category || ', ' || risk || ' risk) sensitive, and which regulation usually covers it?' AS prompt,
count(*) AS n FROM found GROUP BY ALL""",
)
register(
    "explanation_default",
    f"""WITH RECURSIVE {FOUND_MEMO} SELECT src.doc_id, CASE WHEN count(found.doc_id) = 0
THEN {q(vocab.NOTHING_FOUND)} ELSE '' END AS explanation
FROM src LEFT JOIN found ON found.doc_id = src.doc_id GROUP BY src.doc_id""",
)

# ---- sources and sinks ----------------------------------------------------
register("text_source", "SELECT doc_id, text FROM documents")
_EXT = "lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1))"
register(
    "route_by_extension",
    f"""SELECT page_id, CASE WHEN {_EXT} = '.pdf' THEN 'pdf'
 WHEN {_EXT} IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.webp') THEN 'image'
 WHEN {_EXT} IN ('.txt', '.md', '.csv') THEN 'text' ELSE 'unsupported' END AS route
FROM (SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.Txt' ELSE '' END AS url FROM pages)""",
)
_STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
register(
    "assemble_pages",
    f"""SELECT conv_id AS doc_id, string_agg(CASE WHEN length({_STRIPPED}) > 50 THEN {_STRIPPED}
 ELSE '[Page ' || (turn + 1) || ']' || chr(10) || role END, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""",
)
register(
    "join_paragraphs",
    "SELECT conv_id AS doc_id, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL",
)
register(
    "split_empty",
    f"""SELECT doc_id, CASE WHEN empty THEN 'None' END AS overall_risk,
CASE WHEN empty THEN {q(vocab.NO_TEXT)} END AS explanation, CASE WHEN empty THEN '' ELSE text END AS text
FROM (SELECT doc_id, text, regexp_matches(text, '^\\s*$') AS empty
  FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN repeat(' ' || chr(10), cast(doc_id % 5 AS int)) ELSE text END AS text FROM documents))""",
)
register(
    "redacted_names",
    "SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') || '_redactd.txt' AS redact_name, "
    "regexp_replace(url, '\\.[^.]*$', '') || '_maskd.txt' AS mask_name, "
    "regexp_replace(url, '\\.[^.]*$', '') || '_replaced.txt' AS replace_name FROM pages",
)
register("decode_text", "SELECT page_id, chr(65533) || html || chr(65533) AS text FROM pages")

# ---- the whole scan -------------------------------------------------------
register(
    "scan_documents",
    f"""WITH RECURSIVE {FOUND_DOSSIER}, {SETS}, {VECTORS}, {EXPOSURE}, {rewritten('redact')},
summary AS ({SUMMARY}),
top6 AS (SELECT doc_id, string_agg(id, ',' ORDER BY rank) AS rule_ids
  FROM sets JOIN ranked USING (types) JOIN rules USING (i) WHERE rank <= 6 GROUP BY doc_id),
best AS (SELECT doc_id, max(exposure) AS top_exposure FROM exposure GROUP BY doc_id),
listed AS (SELECT doc_id, string_agg(entity_type || ':' || st || ':' || en, ',' ORDER BY st) AS found
  FROM found GROUP BY doc_id)
SELECT s.doc_id, s.total, s.n_pii, s.n_phi, s.n_financial, s.overall_risk, rule_ids, top_exposure,
  coalesce(new_text, text) AS redacted_text, masked_text, text AS original_text, highlighted_html,
  CASE WHEN s.total > 0 THEN prompt END AS prompt,
  CASE WHEN s.total = 0 THEN {q(vocab.NOTHING_FOUND)} END AS explanation,
  s.n_high, s.n_medium, s.n_low, s.n_rules, s.n_ner, s.n_regex, cast(0 AS bigint) AS n_warnings,
  coalesce(listed.found, '') AS found
FROM summary s JOIN src USING (doc_id) LEFT JOIN changed USING (doc_id) LEFT JOIN top6 USING (doc_id)
LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id)
JOIN ({out['mask_dossier']}) m USING (doc_id) JOIN ({out['highlight_risk']}) h USING (doc_id)
LEFT JOIN ({out['explanation_prompt']}) p USING (doc_id)""",
)
register("exposure_table", out["exposure"])


def joined_ctes(src_sql, more, before=""):
    """CTEs src and found: the detection with findings of another table."""
    rows = f"SELECT *, {ARRIVAL} AS n FROM ({hits('src', ALL)} UNION ALL {more})"
    kept = f"SELECT * FROM ({categorized(rows)}) WHERE {_TRIM} NOT IN {DENIED} AND category <> 'Other'"
    return ", ".join(filter(None, [source("src", src_sql), CATS, before, overlap_scan("found", kept)]))


# Hits of the model stand between labels and regex; equal ones go by what they say.
_MODEL_HITS = f"""
SELECT doc_id, entity_type, value, st, en, sc, source, 5000 AS pat,
  row_number() OVER (PARTITION BY doc_id, st, sc ORDER BY en, entity_type, value) AS i FROM ({_MODEL})"""
WITH_NAMES = joined_ctes(fx.DOSSIER, _NAMED, _DICT)
WITH_MODEL = joined_ctes(fx.MEMO, _MODEL_HITS)


def brief(ctes):
    """The scan in short: counts, redacted and masked text, each from the same findings."""
    def text(mode, name):
        return f"(WITH RECURSIVE {rewritten(mode)} SELECT src.doc_id, coalesce(new_text, src.text) AS {name} FROM src LEFT JOIN changed ON changed.doc_id = src.doc_id)"

    return f"""WITH RECURSIVE {ctes}, summary AS ({SUMMARY})
SELECT doc_id, total, overall_risk, n_rules, n_ner, n_regex, redacted_text, masked_text
FROM summary JOIN {text('redact', 'redacted_text')} r USING (doc_id) JOIN {text('mask', 'masked_text')} m USING (doc_id)"""


register("scan_with_names", brief(WITH_NAMES))
register("scan_with_model", brief(WITH_MODEL))
register("redact_with_model", rewrite_query(WITH_MODEL, "redact", "redacted_text"))
register("replace_with_names", rewrite_query(WITH_NAMES, "replace", "replaced_text"))
_TIES = overlap_scan(
    "kept",
    f"""SELECT *, layer * 1000000000000000000000::HUGEINT + ord AS n FROM (
  SELECT DISTINCT doc_id, st, en, cast(1.0 AS double) AS sc, ord, 2 - ord % 3 AS layer FROM ({fx.SPANS}))""",
)
register(
    "detect_ties",
    f"""WITH RECURSIVE {_TIES} SELECT doc_id, st AS span_start, en AS span_end, 'v' || ord AS value,
CASE layer WHEN 0 THEN 'rules' WHEN 1 THEN 'ner' ELSE 'regex' END AS source FROM kept""",
)
register(
    "join_replies",
    f"""WITH RECURSIVE {FOUND_MEMO} SELECT src.doc_id,
CASE WHEN count(found.doc_id) = 0 THEN {q(vocab.NOTHING_FOUND)}
  WHEN src.doc_id % 7 = 0 THEN 'Reasoning unavailable: timeout'
  WHEN src.doc_id % 3 = 0 THEN 'Reply ' || src.doc_id END AS explanation,
CASE WHEN count(found.doc_id) > 0 AND src.doc_id % 7 = 0 THEN 'timeout' ELSE '' END AS warnings
FROM src LEFT JOIN found ON found.doc_id = src.doc_id GROUP BY src.doc_id""",
)
register(
    "highlight_overlaps",
    f"""WITH RECURSIVE edits AS (
  SELECT doc_id, st, en, row_number() OVER (PARTITION BY doc_id ORDER BY st, ord) AS k,
    '<span class="hl-pii" title="' || CASE WHEN ord % 3 = 0 THEN 'A' ELSE 'B' END || ' · PII · '
      || CASE WHEN ord % 2 = 0 THEN 'High' ELSE 'Low' END || ' risk · regex">v' || (ord % 97) || '</span>' AS new
  FROM (SELECT DISTINCT doc_id, st, en, ord FROM ({fx.SPANS}))),
steps AS (
  SELECT doc_id, max(k) + 1 AS k, repeat('ab  c d   ', 6) AS body FROM edits GROUP BY doc_id
  UNION ALL
  SELECT s.doc_id, e.k, left(body, st) || new || substring(body, en + 1)
  FROM steps s JOIN edits e ON e.doc_id = s.doc_id AND e.k = s.k - 1)
SELECT doc_id, '<div class="hl-wrap">' || body || '</div>' AS category_html FROM steps WHERE k = 1""",
)
register(
    "cosine_topk_large",
    """WITH vectors AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
dist AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
    round(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS distance
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0)
SELECT query_id, cast(rank AS int) AS rank, id, round(1 - distance, 3) + 0.0 AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist)
WHERE rank <= 5""",
)
register("index_topk_exact", out["cosine_topk_large"])
register(
    "similar_turns",
    """WITH turns AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text FROM conversations),
tf AS (SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM turns) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM turns)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
asked AS (SELECT id FROM turns WHERE conv_id % 50 = 0),
dots AS (SELECT a.id AS query_id, b.id, sum(a.w * b.w) AS dot FROM w a JOIN asked USING (id) JOIN w b ON b.term = a.term GROUP BY ALL),
scored AS (
  SELECT asked.id AS query_id, turns.id, round(coalesce(dot / (q.norm * n.norm), 0), 9) AS exact
  FROM asked JOIN turns ON true LEFT JOIN norms q ON q.id = asked.id LEFT JOIN norms n ON n.id = turns.id
  LEFT JOIN dots ON dots.query_id = asked.id AND dots.id = turns.id)
SELECT query_id, cast(rank AS int) AS rank, id AS rule_id, round(exact, 3) AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS rank FROM scored) WHERE rank <= 5""",
)
