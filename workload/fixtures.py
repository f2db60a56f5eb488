"""Inputs derived from the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re


def _num(expr, width):
    return f"lpad(cast({expr} AS string), {width}, '0')"


def _when(test, text):
    return f"CASE WHEN {test} THEN {text} || chr(10) ELSE '' END"


# One memo per order: regex types, SSN, e-mail, phone, card, IP, some fields.
MEMO = """
SELECT k AS doc_id,
 CASE WHEN k % 10 = 0 THEN 'Nothing to report.' ELSE
 'Customer: ' || c_name || ' | Nation: ' || n_name || chr(10)
 || CASE WHEN k % 2 = 0 THEN 'SSN: ' || lpad(cast(100 + k % 566 AS string),3,'0') || '-' || lpad(cast(10 + k % 89 AS string),2,'0') || '-' || lpad(cast(1000 + (k * 7) % 9000 AS string),4,'0') || chr(10) ELSE '' END
 || CASE WHEN k % 3 = 0 THEN 'Email: user' || cast(k AS string) || '@mail' || cast(k % 9 AS string) || '.example.com' || ' | Phone: (' || cast(200 + k % 800 AS string) || ') 555-' || lpad(cast(k % 10000 AS string),4,'0') || chr(10) ELSE '' END
 || CASE WHEN k % 4 = 1 THEN 'Aadhaar: ' || cast(2000 + k % 8000 AS string) || ' ' || lpad(cast((k * 13) % 10000 AS string),4,'0') || ' ' || lpad(cast((k * 17) % 10000 AS string),4,'0') || chr(10) ELSE '' END
 || CASE WHEN k % 5 = 1 THEN 'PAN: ABCDE' || lpad(cast(k % 10000 AS string),4,'0') || chr(cast(65 + k % 26 AS int)) || chr(10) ELSE '' END
 || CASE WHEN k % 5 = 2 THEN 'Card: 4539 1488 0343 ' || CASE WHEN k % 3 = 0 THEN '6467' ELSE lpad(cast(k % 10000 AS string),4,'0') END || ' (CVV: ' || lpad(cast(k % 1000 AS string),3,'0') || ')' || chr(10) ELSE '' END
 || CASE WHEN k % 6 = 1 THEN 'Routing: ' || lpad(cast((k * 31) % 1000000000 AS string),9,'0') || ' | IP: 10.' || cast(k % 256 AS string) || '.' || cast((k * 3) % 256 AS string) || '.' || cast((k * 5) % 256 AS string) || chr(10) ELSE '' END
 || CASE WHEN k % 7 = 1 THEN 'NPI: ' || lpad(cast(1000000000 + k AS string),10,'0') || ' | MRN: MRN-' || lpad(cast(k AS string),8,'0') || ' | Diagnosis: Type 2 Diabetes' || chr(10) ELSE '' END
 || CASE WHEN k % 8 = 1 THEN 'Mobile: +91 ' || cast(60000 + k % 40000 AS string) || ' ' || lpad(cast((k * 19) % 100000 AS string),5,'0') || chr(10) ELSE '' END
 || CASE WHEN k % 9 = 1 THEN 'Address: ' || cast(1 + k % 9999 AS string) || ' Oak Hill Rd NW, Atlanta, GA ' || lpad(cast((k * 3) % 100000 AS string),5,'0') || chr(10) ELSE '' END
 || CASE WHEN k % 11 = 1 THEN 'Salary: $' || cast(30000 + k % 90000 AS string) || '/year | Employee ID: EMP-' || lpad(cast(k AS string),5,'0') || ' | Skill: Docker' || chr(10) ELSE '' END
 END AS text
FROM (SELECT o_orderkey AS k, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

_BBAN = _num("(k * 7919) % 100000000000000", 14)
_IBAN_CHECK = (
    f"98 - ((cast('23321120' || substring({_BBAN}, 1, 6) AS bigint) % 97) * 100000000000000 "
    f"+ cast(substring({_BBAN}, 7, 8) || '161100' AS bigint)) % 97"
)
_DEA = _num("(k * 53) % 1000000", 6)
_DEA_CHECK = "({odd} + 2 * ({even}) + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) % 10".format(
    odd=" + ".join(f"cast(substring({_DEA}, {i}, 1) AS int)" for i in (1, 3, 5)),
    even=" + ".join(f"cast(substring({_DEA}, {i}, 1) AS int)" for i in (2, 4, 6)),
)

# One dossier per customer: the types and labelled fields that memos lack.
DOSSIER = f"""
SELECT k AS doc_id,
 'File of ' || c_name || ' <' || r_name || ' & co>' || chr(10)
 || {_when("k % 2 = 0", "'Patient: Pat' || cast(k AS string) || ' Doe | DOB: 19' || " + _num("k % 100", 2) + " || '-0' || cast(1 + k % 9 AS string) || '-1' || cast(k % 10 AS string)")}
 || {_when("k % 3 = 0", "'Medications: Metformin ' || cast(k % 900 AS string) || 'mg daily (oral) | Insurance ID: INS-' || " + _num("k", 8))}
 || {_when("k % 3 = 1", "'Blood Type: AB+ | Lab Result: glucose ' || cast(k % 200 AS string) || ' mg | Treatment: physio, ' || cast(k % 12 AS string) || ' weeks'")}
 || {_when("k % 4 = 0", "'Passport No: P' || " + _num("(k * 37) % 100000000", 8))}
 || {_when("k % 4 = 1", "'Driver' || chr(39) || 's License: D' || " + _num("(k * 41) % 10000000", 7))}
 || {_when("k % 4 = 2", "'Account No: ' || " + _num("(k * 7919) % 1000000000000", 12))}
 || {_when("k % 4 = 3", "'Bank Account: ' || cast(7291048832 + k AS string)")}
 || {_when("k % 5 = 0", "'IBAN: GB' || lpad(cast(" + _IBAN_CHECK + " AS string), 2, '0') || 'NWBK' || " + _BBAN)}
 || {_when("k % 5 = 1", "'DEA: BJ' || " + _DEA + " || cast(" + _DEA_CHECK + " AS string)")}
 || {_when("k % 5 = 2", "'IBAN: GB' || " + _num("k % 100", 2) + " || 'NWBK' || " + _BBAN)}
 || {_when("k % 6 = 0", "'Host 2001:db8::' || cast(k % 10000 AS string) || ':1 or fe80:1:2:3:4:5:6:' || cast(k % 9999 AS string)")}
 || {_when("k % 6 = 1", "'Host 300.1.2.3 or 10.0.' || cast(k % 300 AS string) || '.7'")}
 || {_when("k % 7 = 0", "'National ID: N' || " + _num("k", 9) + " || ' | SSN: 000-12-3456'")}
 || {_when("k % 7 = 1", "'Seen March 5, 20' || " + _num("k % 100", 2) + " || ' and 03/1' || cast(k % 10 AS string) || '/1978'")}
 || {_when("k % 8 = 0", "'Abroad: +44 20 7946 0' || " + _num("k % 1000", 3))}
 || {_when("k % 9 = 0", "'Faith and nation: ' || r_name || ' ' || n_name || ', Docker'")}
 || {_when("k % 11 = 0", "'Gift card: 4539 1488 0343 6460 003 or 4539 1488 0343 6467 123'")}
 || {_when("k % 11 = 1", "'Mail: ' || repeat('ab', 40) || cast(k AS string) || '@example.org or joe@example.xn--p1ai'")}
 || {_when("k % 11 = 2", "'Pay BE68 5390 0754 7034 EUR or to ES91 2100 0418 4502 0005 1332 PAID'")}
 || {_when("k % 11 = 3", "'Account No:     ' || " + _num("k", 8) + " || ' | LC14BOSL123456789012345678901234'")}
 || {_when("k % 11 = 4", "'Both: 123-45-6789 234-56-7890'")}
 || {_when("k % 11 = 5", "'Diagnosis: ' || repeat('a long condition ', 70) || 'ends'")}
 || {_when("k % 11 = 6", "'Patient: Ann Lee, SSN: 234-56-7890, Diagnosis: HIV positive, Salary: $95,000; Treatment: ART'")}
 || {_when("k % 11 = 7", "'Diagnosis: HIV positive, card 4539148803436467, Treatment: ART Blood Type: AB+; DOB: May 2, 1991'")}
 || {_when("k % 13 = 1", "'Patient: Smith, John ' || cast(k AS string) || ' | Diagnosis: diabetes, hypertension and HIV'")}
 || {_when("k % 13 = 2", "'Medications: metformin, lisinopril 10mg, aspirin; Employee ID: E-' || cast(k AS string) || ', 34, 56'")}
 || {_when("k % 13 = 3", "'Diagnosis: flu, paid with card 4539148803436467 and mail joe@example.com, cough'")}
 || {_when("k % 13 = 4", "'Treatment: joe@example.com, 10.1.2.3 10.4.5.6 long sleep, DOB: May 2, 1991, Note: keep'")}
 || {_when("k % 11 = 8", "'Met Sean O' || chr(39) || 'Brien in the United States of America'")}
 || {_when("k % 11 = 9", "'Wrote to the New York Times in New York'")}
 AS text
FROM (SELECT c_custkey AS k, c_name, n_name, r_name FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

# Spans with scores and overlaps, several per order.  The arrival number comes
# from the row itself: numbering rows per order would sort a large order alone.
SPANS = """
SELECT l_orderkey AS doc_id,
 l_linenumber * 100000000000000000 + l_partkey * 100000000 + l_suppkey AS ord,
 cast(l_partkey % 40 AS int) AS st,
 cast(l_partkey % 40 + 1 + l_suppkey % 15 AS int) AS en,
 CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN cast(0.5 AS double) WHEN 1 THEN cast(0.6 AS double) WHEN 2 THEN cast(0.85 AS double) ELSE cast(1.0 AS double) END AS sc
FROM lineitem
"""

# Output of an outside model: one hit per order line.
MODEL_HITS = """
SELECT l_orderkey AS doc_id, cast(l_linenumber - 1 AS int) AS chunk,
 CASE l_partkey % 5 WHEN 0 THEN 'medical record number' WHEN 1 THEN 'salary' WHEN 2 THEN 'national id'
   WHEN 3 THEN 'date of birth' ELSE 'shoe size' END AS label,
 cast(l_partkey % 1900 AS int) AS span_start,
 cast(l_partkey % 1900 + 1 + l_suppkey % 20 AS int) AS span_end,
 CASE WHEN l_suppkey % 9 = 0 THEN ' Docker ' ELSE 'v' || cast(l_partkey AS string) END AS value,
 cast(l_quantity AS double) / 50 AS score
FROM lineitem
"""

# People and places to look up by name.
TERMS = """
SELECT c_name AS term, 'PERSON' AS entity_type FROM customer
UNION ALL SELECT n_name, 'LOCATION' FROM nation
UNION ALL SELECT r_name || ' ' || n_name, 'NRP' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'Docker', 'PERSON' FROM region
UNION ALL SELECT DISTINCT 'Sean O' || chr(39) || 'Brien', 'PERSON' FROM region
UNION ALL SELECT DISTINCT 'United States of America', 'LOCATION' FROM region
UNION ALL SELECT DISTINCT 'New York Times', 'PERSON' FROM region
UNION ALL SELECT DISTINCT 'New York', 'LOCATION' FROM region
"""

# JSON notes on events; a bare card number breaks the JSON once it is replaced.
NOTES = """
SELECT event_id AS doc_id,
 '{"k": ' || cast(event_id % 97 AS string) || ', "ip": "10.0.' || cast(event_id % 300 AS string) || '.9", "mail": "u'
 || cast(user_id AS string) || '@example.com"'
 || CASE WHEN event_id % 5 = 0 THEN ', "card": 4539148803436467' ELSE '' END
 || ', "props": ' || props || '}' AS text
FROM events
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark, sf_dir, sql, dealt=lambda rows, table: rows):
    """Run one of the texts above on the tables of ``sf_dir``, without temp views.

    ``dealt`` is applied to the rows that become texts, next to the first table, which they come
    from.  Where tables are joined first, those are the rows of the join: a large one leaves as
    many tasks as there are cores or fewer, and all rows of a key in one of them.
    """
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    first = re.search(rf"\bFROM ({'|'.join(TABLES)})\b", sql)[1]
    joined = re.search(r"\bFROM \((SELECT .*)\)\s*$", sql, re.S)
    if not joined:
        return _run(spark, sql, {**frames, first: dealt(frames[first], frames[first])})
    rows = dealt(_run(spark, joined[1], frames), frames[first])
    return _run(spark, f"{sql[:joined.start()]}FROM rows", {"rows": rows})


def _run(spark, sql, frames):
    escaped = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        escaped = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", escaped)
    return spark.sql(escaped, **frames)
