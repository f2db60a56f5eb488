"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

ORACLE_SQL = {}

#: CRC-32 of an ASCII text: its bytes with eight shifts after each, by the reversed polynomial.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
)

ORACLE_SQL["op13_exact"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""

_FIELD = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen(cast({x} AS varchar)) || ':' || {x} END"


def _leaf(n_chars):
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(_FIELD.format(x=x) for x in fields) + ")"


ORACLE_SQL["op12_merkle"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, {_leaf('n_chars')} AS leaf,
         CASE WHEN {CRC32.format(x='cast(doc_id AS varchar)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM documents
), lower AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM lower WHERE n > 1 GROUP BY tree, level, pos // 2, n
), upper AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, digest FROM lower WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), nodes AS (
  SELECT tree, level, pos, n, digest FROM lower UNION ALL SELECT -1, level, pos, n, digest FROM upper
), walk AS (
  SELECT doc_id, leaf, tree AS own, tree, 0 AS level, pos, n, '' AS proof, coalesce(changed, leaf) AS folded FROM leaves
  UNION ALL
  SELECT doc_id, leaf, own, CASE WHEN w.n = 1 THEN -1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.n = 1 THEN w.tree ELSE w.pos // 2 END,
         CASE WHEN w.n = 1 THEN (SELECT max(n) FROM upper) ELSE (w.n + 1) // 2 END,
         proof || coalesce(s.digest, ''),
         CASE WHEN w.n = 1 THEN folded
              WHEN w.pos % 2 = 1 THEN sha256(s.digest || folded)
              ELSE sha256(folded || coalesce(s.digest, '')) END
  FROM walk w LEFT JOIN nodes s
    ON w.n > 1 AND s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1 OR w.tree >= 0
)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = r.digest AS verified
FROM walk w JOIN lower s ON s.tree = w.own AND s.n = 1, (SELECT digest FROM upper WHERE n = 1) r
WHERE w.tree = -1 AND w.n = 1
"""

# A word's keys: each letter as a sign that is no letter, for replacements; the word and
# each of its letters left out, for the rest.
ORACLE_SQL["op11_spelling"] = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM runs GROUP BY ALL
), bytes AS (
  SELECT *, coalesce(cast(doc_id AS varchar), '') || ':' || run AS whole FROM lowered
), hashed AS (
  SELECT run, k, {CRC32.replace("[ascii(c)::BIGINT,", "list_concat(CASE WHEN ascii(c) < 128 THEN [ascii(c)::BIGINT] ELSE [195::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, ascii(c)::BIGINT - 64] END, [").replace("-1, -1]))", "-1, -1])))").format(x='whole')} AS h
  FROM bytes
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
  FROM hashed
), words AS (
  SELECT word, cast(sum(k) AS bigint) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), keys AS (
  SELECT word, unnest(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || '*' || substr(word, i + 1)),
    list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))) AS key FROM words
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near
  FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE contains(a.key, '*') OR (length(a.word) <> length(b.word) AND (a.key = a.word OR b.key = b.word))
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(struct_pack(w := p.near, n := v.n), (-v.n, p.near)) AS b
  FROM pairs p JOIN words v ON v.word = p.near GROUP BY p.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.w END AS form,
         CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS last, form AS next FROM formed
  UNION ALL
  SELECT f.word, f.next, g.form FROM followed f JOIN formed g ON g.word = f.next
)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN followed r ON r.word = f.word AND r.next IS NULL
"""

ORACLE_SQL["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) AS again,
  min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM q
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLE_SQL["op2_decontaminate"] = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w
  FROM (SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs JOIN sizes ON len(ws) >= size)),
met AS (SELECT r, places.size, i, item_id FROM places JOIN windows ON places.w = windows.w AND places.size = windows.size),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM met) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids
  FROM met GROUP BY r)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_TOKENS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)
ORACLE_SQL["op7_near_dedup"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS ws FROM documents),
sets AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM docs UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
least AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least ON x = docs.r LEFT JOIN sizes ON sizes.r = docs.r
"""
