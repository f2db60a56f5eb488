"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, letters of other scripts that look Latin, full-width
and accented letters and digits or signs that stand for letters all become plain letters,
and marks without width go.  ``l``, ``i``, ``1`` and ``!`` fold to one letter, since a
``1`` may mean either.  An Aho-Corasick automaton finds the terms of the lexicon, which are
whole words or stems at the start of a word, in one pass; terms inside an exception phrase do not count.  The weight found, per
length and in all, goes through a logistic curve.

Terms, weights, exception phrases and the curve are learned from a bounded sample of
labelled rows: weights are smoothed log odds of the documents that hold a word, exceptions
are the phrases around a term that clean documents hold and toxic ones do not.

Defined results: a null or empty text has no terms and gets the score of a text without
any; rows without a label teach nothing; a document with several labels counts with each;
without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm.common import Spans, per_text, pick, slices, texts

#: Labelled rows that are learned from, terms and exception phrases kept.
SAMPLE = 12000
TERMS = 2000
PHRASES = 2000
#: Lengths of the stems that are weighed besides whole words.
STEMS = (4, 5, 6)
#: A term must be in this many toxic documents, with log odds of at least this much.
LEAST_TOXIC = 4
LEAST_ODDS = 2.5
#: An exception phrase must be in this many clean documents, and in so small a share of toxic ones.
LEAST_CLEAN = 3
MOST_TOXIC_SHARE = 0.2

# Letters of other scripts that look like Latin ones, and signs for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ѵ": "v", "ѡ": "w", "ɡ": "g", "ӏ": "l", "ո": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ω": "w",
    "η": "n", "μ": "u", "β": "b", "ı": "i", "ℓ": "l", "ø": "o", "ł": "l", "đ": "d",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
NO_WIDTH = "­​‌‍⁠﻿"
#: Phrases that are never toxic, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "pond scum", "clown fish", "rodeo clown")


@lru_cache(maxsize=1)
def _table():
    table = {ord(c): None for c in NO_WIDTH}
    for first, last in ((0xC0, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2460, 0x2500), (0xFF00, 0xFF60), (0x1D400, 0x1D800)):
        for c in range(first, last):
            plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
            if len(plain) <= 1 and plain != chr(c):
                table[c] = SIGNS.get(plain, plain) or None
    for letter, plain in HOMOGLYPHS.items():
        table[ord(letter)] = SIGNS.get(plain, plain)
    table.update({ord(c): plain for c, plain in SIGNS.items()})
    return table


def fold(text):
    """The text in plain letters; exclamation marks at the end of a word stay apart."""
    return _ENDS.sub(" ", text.lower()).translate(_table())


_ENDS = re.compile(r"[!|$@]+(?=\s|$)")
_WORD = re.compile(r"[^\W_]+")


class Lexicon:
    """Weighted terms, exception phrases, and the logistic curve."""

    def __init__(self, weights, exceptions=(), curve=None):
        self.weights, self.exceptions, self.curve = dict(weights), tuple(exceptions), curve
        self.automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def _built(self):
        if self.automaton is None:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term.rstrip("*"), (len(term.rstrip("*")), weight, term[-1] == "*"))
            for phrase in self.exceptions:
                if phrase not in made:
                    made.add_word(phrase, (len(phrase), None, False))
            if len(made):
                made.make_automaton()
            self.automaton = made
        return self.automaton

    def matches(self, folded):
        """(start, end, weight) of words and stems outside exception phrases."""
        found, free, made = [], [], self._built()
        if not len(made):
            return found
        for last, (size, weight, stem) in made.iter(folded):
            start, end = last - size + 1, last + 1
            if (start and folded[start - 1].isalnum()) or (not stem and end < len(folded) and folded[end].isalnum()):
                continue
            (free if weight is None else found).append((start, end, weight))
        if free:
            exempt = Spans((a, b) for a, b, _ in free)
            found = [m for m in found if not exempt.cover(m[0], m[1])]
        return found

    def features(self, text):
        """Weight per root of the length, and in all."""
        found = self.matches(fold(text))
        total = sum(w for _, _, w in found)
        return (total / math.sqrt(20 + text.count(" ")), math.log1p(total)) if found else (0.0, 0.0)

    def score(self, text):
        if self.curve is None:
            return 0.0
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def logistic(x, y, rounds=60, ridge=1e-2):
    """Weights of a logistic curve by Newton steps; slopes are held at zero or above."""
    x = np.column_stack([np.ones(len(x)), np.asarray(x, float)])
    y, w = np.asarray(y, float), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def _counts(rows, names, of_text):
    """Documents of each label that hold each of the strings ``of_text`` gives."""

    def run(batches):
        from collections import Counter

        held = Counter()
        for batch in slices(batches):
            labels = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            for text, label in zip(texts(batch), labels):
                held.update((name, label) for name in of_text(text))
                if len(held) > 400_000:
                    yield _pairs(held, names)
                    held = Counter()
        yield _pairs(held, names)

    out = rows.select("text", "toxic").mapInArrow(run, f"{names} STRING, toxic INT, n BIGINT")
    bad, good = F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.sum(F.when(F.col("toxic") == 0, F.col("n")))
    return out.groupBy(names).agg(F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(good, F.lit(0)).alias("good"))


def _pairs(held, name):
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int32()),
         pa.array([held[k] for k in keys], pa.int64())],
        names=[name, "toxic", "n"],
    )


def terms_of(folded):
    """The words of a text and their stems, which are marked by a star."""
    words = set(_WORD.findall(folded))
    return words | {w[:k] + "*" for k in STEMS for w in words if len(w) >= k}


def shortest(weights):
    """Terms that no shorter stem of the lexicon covers, so that a word counts once."""
    kept = {}
    for term in sorted(weights, key=lambda t: (len(t.rstrip("*")), t[-1] != "*", t)):
        plain = term.rstrip("*")
        if not any(plain[:k] + "*" in kept for k in range(1, len(plain) + 1)):
            kept[term] = weights[term]
    return kept


def phrases(folded, lexicon):
    """The words before and after each term, with the term."""
    out = set()
    for start, end, _ in lexicon.matches(folded):
        before, after = _WORD.findall(folded, max(0, start - 40), start), _WORD.findall(folded, end, end + 40)
        if before:
            out.add(before[-1] + " " + folded[start:end])
        if after:
            out.add(folded[start:end] + " " + after[0])
    return out


def fit(docs, labels, sample=SAMPLE, exceptions=EXCEPTIONS, id_col="doc_id", text_col="text", toxic_col="toxic"):
    """Learn from the ``sample`` labelled rows that come first by a hash of their id."""
    marked = labels.where(F.col(toxic_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.select(F.col(id_col).alias("labelled"), F.col(toxic_col).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("labelled").cast("string"))
    chosen = marked.orderBy(order, "labelled", "toxic").limit(sample)
    base = tuple(fold(p) for p in exceptions)
    rows = pick(docs, id_col, text_col)
    rows = rows.join(F.broadcast(chosen), rows.doc_id == chosen.labelled).select("text", "toxic")
    sizes = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, base)

    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    words = _counts(rows, "word", lambda text: terms_of(fold(text))).withColumn("odds", odds)
    words = words.where((F.col("bad") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_ODDS) & (F.length("word") > 2))
    top = words.orderBy(F.desc(F.col("odds") * F.log(F.col("bad"))), "word").limit(TERMS).collect()
    lexicon = Lexicon(shortest({r.word: float(r.odds) for r in top}), base)

    around = _counts(rows, "phrase", lambda text: phrases(fold(text), lexicon))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    kept = around.where((F.col("good") >= LEAST_CLEAN) & (share <= MOST_TOXIC_SHARE))
    learned = [r.phrase for r in kept.orderBy(F.desc("good"), "phrase").limit(PHRASES).collect()]
    lexicon = Lexicon(lexicon.weights, [*base, *learned])

    def run(batches):
        for batch in slices(batches):
            found = [lexicon.features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.float64()) for c in zip(*found)] + [batch.column(batch.schema.get_field_index("toxic"))],
                names=["a", "b", "toxic"],
            )

    points = rows.mapInArrow(run, "a DOUBLE, b DOUBLE, toxic INT").groupBy("a", "b", "toxic").count().collect()
    points = sorted(tuple(r) for r in points)
    x = np.repeat([p[:2] for p in points], [p[3] for p in points], axis=0)
    y = np.repeat([p[2] for p in points], [p[3] for p in points])
    return Lexicon(lexicon.weights, lexicon.exceptions, logistic(x, y))


def score(docs, lexicon, id_col="doc_id", text_col="text"):
    """``doc_id, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batch):
        return [pa.array([shared.value.score(t) for t in texts(batch)], pa.float64())]

    return per_text(pick(docs, id_col, text_col), run, "score DOUBLE")
