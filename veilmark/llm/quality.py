"""Quality rules, lines first.

Every line is held against rules of three families: punctuation (shouting in capitals or
with exclamation marks, words dressed in symbols), navigation (items between separators)
and boilerplate (licence and cookie phrases).  Lines that fail are removed; a document
that loses more than a share of its characters, or that fails a base rule on its whole
text, is rejected.

Defined results: a null or empty text has no words, so it fails the base rule and is
rejected; its cleaned text is empty (null stays null).  Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from veilmark.llm.common import boxed, per_text, pick, releasing, slices, texts

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept all cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "powered by wordpress",
    "lorem ipsum",
)

SEPARATORS = frozenset("| > < » « • · / ›".split())
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I | re.A)
_DRESSED = re.compile(r"[#*$%&<>|]")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules, as shares of the words of a line or the text."""

    min_words: int = 10
    max_repeat_percent: int = 20
    #: A line fails with this share of words that end in an exclamation mark.
    shout: float = 0.3
    #: ... of words in capitals, among those with letters of both cases.
    capitals: float = 0.8
    #: ... of words with a symbol.
    symbols: float = 0.3
    #: ... of separators.
    separators: float = 0.3
    #: Capitals, shouting and symbols are judged from this many words on.
    judged_words: int = 4
    #: The document is rejected if it loses more than this share of its characters.
    max_lost: float = 0.5


def line_fails(line, rules=Rules()):
    """The family of the rule that a line fails, or None."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    apart = sum(w in SEPARATORS for w in words)
    if apart >= 2 and apart >= rules.separators * n:
        return "navigation"
    if _PHRASES.search(line):
        return "boilerplate"
    if n >= rules.judged_words:
        if sum(w[-1] == "!" for w in words) >= rules.shout * n:
            return "punctuation"
        if sum(_DRESSED.search(w) is not None for w in words) >= rules.symbols * n:
            return "punctuation"
        cased = [w for w in words if w.upper() != w.lower()]
        if len(cased) >= rules.judged_words and sum(w == w.upper() for w in cased) >= rules.capitals * len(cased):
            return "punctuation"
    return None


def clean(text, rules=Rules()):
    """The text without failing lines, and the number of characters removed."""
    kept, lost = [], 0
    for line in text.split("\n"):
        if line_fails(line, rules) is None:
            kept.append(line)
        else:
            lost += len("".join(line.split()))
    return ("\n".join(kept), lost) if lost else (text, 0)


def repeated_words(words, window=WINDOW):
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    if size ** window < 2**63:
        code = ids[:n].copy()
        for k in range(1, window):
            code = code * size + ids[k : n + k]
    else:  # number the pairs, triples ... anew, so that the codes stay exact
        code = ids[:n]
        for k in range(1, window):
            code = np.unique(code * size + ids[k : n + k], return_inverse=True)[1]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(code, twice))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text, rules=Rules()):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    the cleaned text of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, repeats = set(), 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in seen:
                repeats += 1
            elif line.strip():
                seen.add(line)
    again = repeated_words(words)
    failed = n < rules.min_words or 100 * again > rules.max_repeat_percent * n
    cleaned, lost = clean(text, rules)
    kept = not failed and lost <= rules.max_lost * word_chars
    return n, word_chars, symbols, repeats, again, failed, kept, cleaned


COLUMNS = (
    "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, "
    "n_repeat_words BIGINT, base_failed BOOLEAN, kept BOOLEAN, cleaned STRING"
)
_KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]


def assess(docs, rules=Rules(), id_col="doc_id", text_col="text", with_text=True):
    """``doc_id``, the measures and verdict of each document, and its cleaned text."""

    def run(batch):
        column = batch.column(batch.schema.get_field_index("text"))
        rows = [measure(t, rules) for t in texts(batch)]
        parts = list(zip(*rows))
        if with_text:
            parts[7] = [None if not there else t for there, t in zip(column.is_valid().to_pylist(), parts[7])]
        return [pa.array(part, kind) for part, kind in zip(parts, _KINDS if with_text else _KINDS[:7])]

    columns = COLUMNS if with_text else COLUMNS.removesuffix(", cleaned STRING")
    return per_text(pick(docs, id_col, text_col), run, columns)


def filter_documents(docs, rules=Rules(), text_col="text"):
    """The documents that pass, with all their columns, without their failing lines."""

    def run(batches):
        for batch in slices(batches):
            rows = [measure(t, rules) for t in texts(batch)]
            at = [i for i, row in enumerate(rows) if row[6]]
            if not at:
                continue
            out = batch.take(pa.array(at))
            place = out.schema.get_field_index("text")
            columns = list(out.columns)
            columns[place] = pa.array([rows[i][7] for i in at], out.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=out.schema.names)

    inner, back = boxed(docs, text_col)
    return back(inner.mapInArrow(releasing(run), inner.schema))
