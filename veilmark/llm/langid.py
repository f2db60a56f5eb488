"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum: the number of character n-grams of one to
four characters that both hold, over the root of the product of their numbers (presence,
not counts).  A kernel ridge regression, one versus the rest, is fitted in the space of
Nystroem landmarks: with the kernel matrices K of the sample against the landmarks and W of
the landmarks, the coefficients solve (K'K + n r W) a = K'Y.  Since the kernel is an inner
product of presence vectors, scoring is one matrix product for a batch of texts.

N-grams are taken from the lower-cased text, each run of other characters than letters
being one blank, and are numbered by hash into ``BUCKETS`` places for each length.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is
every text if there is no row to learn from; ties between languages go to the first by
name; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm.common import per_text, pick, texts

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 12
WIDTH = BUCKETS * len(LENGTHS)
#: Rows of the sample that the model is fitted on, and landmarks among them.
SAMPLE = 2000
LANDMARKS = 256
RIDGE = 1e-3
_MIX = np.uint64(0x9E3779B97F4A7C15)

_letters = []


def _is_letter():
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(text):
    """The places of the n-grams of a text, as a 0/1 vector, or None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    codes = np.pad(codes, (1, int(letter[-1])), constant_values=32)
    out = np.zeros(WIDTH, np.float32)
    value = np.zeros(len(codes), np.uint64)
    for at, n in enumerate(LENGTHS):
        if n > len(codes):
            break
        value = (value[: len(codes) - n + 1] + codes[n - 1 :]) * _MIX
        value ^= value >> np.uint64(31)
        out[at * BUCKETS + (value >> np.uint64(20)) % np.uint64(BUCKETS)] = 1
    return out


class Model:
    """Languages and the matrix that turns presence vectors into scores."""

    def __init__(self, languages, matrix):
        self.languages, self.matrix = languages, matrix

    def predict(self, batch):
        """(language, score between 0 and 1) of each text."""
        out = [("und", 0.0)] * len(batch)
        vectors = [presence(t) for t in batch]
        there = [i for i, v in enumerate(vectors) if v is not None]
        if not there or not self.languages:
            return out
        x = np.stack([vectors[i] for i in there])
        margins = (x @ self.matrix) / np.sqrt(x.sum(axis=1, keepdims=True))
        best = margins.argmax(axis=1)
        scores = np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1)
        for i, k, s in zip(there, best, scores):
            out[i] = self.languages[k], float(s)
        return out


def solve(rows, landmarks=LANDMARKS, ridge=RIDGE):
    """A model from (language, packed presence vector) rows."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], None)
    x = np.stack([np.unpackbits(np.frombuffer(bits, np.uint8)) for _, bits in rows])
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang, _ in rows])
    # Landmarks: the first rows of each language in turn, so that rare ones have some.
    order, seen = [], {}
    for i, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        order.append((seen[lang], lang, i))
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    marks = x[chosen].astype(np.float32)
    marks /= np.sqrt(marks.sum(axis=1, keepdims=True))
    k = np.empty((len(rows), len(chosen)))
    for i in range(0, len(rows), 256):
        part = x[i : i + 256].astype(np.float32)
        k[i : i + 256] = (part @ marks.T) / np.sqrt(part.sum(axis=1, keepdims=True))
    w = k[chosen]
    left = k.T @ k + len(rows) * ridge * (w + w.T) / 2 + 1e-8 * np.eye(len(chosen))
    a = np.linalg.solve(left, k.T @ y)
    return Model(languages, (marks.T @ a).astype(np.float32))


def fit(labelled, sample=SAMPLE, id_col="doc_id", text_col="text", lang_col="lang"):
    """Learn from a labelled table: the ``sample`` rows that come first by a hash of the id.

    The rows are chosen by ids alone; then only the chosen texts are read, and only their
    presence vectors leave the tasks.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"))
    last = rows.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model([], None)
    chosen = pick(rows.where(order <= last), id_col, text_col, (F.col(lang_col).alias("lang"), order.alias("h")))

    def run(batch):
        vectors = [presence(t) for t in texts(batch)]
        return [pa.array([None if v is None else np.packbits(v.astype(bool)).tobytes() for v in vectors], pa.binary())]

    found = per_text(chosen, run, "bits BINARY", keep=("h", "lang")).where("bits is not null")
    # Rows of one id share a hash; the limit holds for them too.
    got = found.orderBy("h", "lang", "bits").limit(sample).collect()
    return solve([(r.lang, bytes(r.bits)) for r in got])


def predict(docs, model, id_col="doc_id", text_col="text"):
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        all_texts, out = texts(batch), []
        for i in range(0, len(all_texts), 128):
            out += shared.value.predict(all_texts[i : i + 128])
        langs, scores = zip(*out)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return per_text(pick(docs, id_col, text_col), run, "lang_pred STRING, score DOUBLE")
