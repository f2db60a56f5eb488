"""Secrets by patterns and by novelty under a primed compressor.

Base patterns find assigned passwords and tokens, access keys and long hexadecimal runs.
Beyond them every string of key-like characters that stands near a sensitive word is a
candidate.  A Zstandard compressor is primed with a dictionary of identifiers that occur
in several documents and with the text around the candidate; the bytes that the candidate
adds to the compressed text are its novelty.  A candidate that adds nearly what random characters
of its alphabet would, so that neither the surroundings nor known identifiers explain it, is
reported as ``novel``.

Defined results: a null or empty text has no spans; base spans always stay, novel ones are
added where no base span stands; repeated rows give equal rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from veilmark.llm.common import Spans, per_text, pick, slices, texts

KINDS = ("assign", "access", "hex", "novel")

# The base patterns; the case of ASCII letters alone is ignored.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.I | re.A
)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")

# Words that make a context sensitive.
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api key", "access key",
    "private key", "auth", "authorization", "bearer", "credential", "signature", "client_id", "key=", "key:",
)
# Whole words, also as a part of camelCase, in the plural, or with a sign at their end.
_SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=(?-i:[A-Z])))(?:(?:"
    + "|".join(re.escape(w) for w in SENSITIVE if w[-1].isalpha())
    + r")s?(?-i:(?![a-z]))|(?:" + "|".join(re.escape(w) for w in SENSITIVE if not w[-1].isalpha()) + "))",
    re.I | re.A,
)
_STRING = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+")
# Longer identifiers are counted by their first 64 characters.
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{4,63}")

#: Characters before a candidate in which a sensitive word must stand, and around it that
#: prime the compressor.
NEAR = 40
AROUND = 256
#: Least share that a candidate must add of what random characters of its alphabet would.
NOVELTY = 0.8
#: Up to this length random characters are measured, beyond it their share is carried on.
MEASURED = 1024
#: Identifiers in the dictionary, each from at least this many documents.
IDENTIFIERS = 4000
LEAST_DOCUMENTS = 2


def base_spans(text):
    """(start, kind number, end) of all base matches, in order."""
    out, low = [], text.lower()
    for m in _ASSIGN.finditer(text) if any(w in low for w in _NAMES) else ():
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def sensitive_places(text):
    """Stretches after sensitive words, joined where they overlap."""
    out, low = [], text.lower()
    if not any(w in low for w in SENSITIVE):
        return out
    for m in _SENSITIVE.finditer(text):
        if out and m.start() <= out[-1][1]:
            out[-1][1] = m.end() + NEAR
        else:
            out.append([m.start(), m.end() + NEAR])
    return out


class Novelty:
    """Marginal compressed bytes of a candidate."""

    def __init__(self, identifiers):
        self.known = "\n".join(identifiers).encode()

    def bytes_of(self, before, value, after):
        """Compressed bytes that ``value`` adds to its surroundings."""
        primer = self.known + b"\n" + (after + "\n" + before).encode("utf-8", "surrogatepass")
        shared = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=False)
        tail = before[-16:].encode("utf-8", "surrogatepass")
        return len(packer.compress(tail + value.encode())) - len(packer.compress(tail))


# Signs that random strings are drawn from, and the fewest that count as an alphabet.
_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
_FEWEST = 10


@lru_cache(maxsize=8192)
def _random_bytes(signs, size):
    """Compressed bytes that ``size`` random characters out of so many signs add."""
    rng = random.Random(size)
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False)
    tail = "".join(rng.choices(_SIGNS[:signs], k=16)).encode()
    value = "".join(rng.choices(_SIGNS[:signs], k=size)).encode()
    return len(packer.compress(tail + value)) - len(packer.compress(tail))


def expected_bytes(value):
    """What random characters, out of as many signs as the candidate has and of its length,
    would add; fewer than ten signs count as ten, so that repetition does not pass."""
    signs, size = max(_FEWEST, len(set(value))), len(value)
    measured = min(size, MEASURED)
    return min(size, _random_bytes(signs, measured) * size / measured)


def novel_spans(text, novelty, base, least=NOVELTY):
    """Incompressible strings in sensitive context that no base span touches, in one pass
    over the strings and the sensitive places."""
    out, places, at = [], sensitive_places(text), 0
    known = Spans((a, b) for a, _, b in base)
    for m in _STRING.finditer(text) if places else ():
        while at < len(places) and places[at][1] < m.start():
            at += 1
        if at == len(places):
            break
        if m.start() < places[at][0] or known.touch(*m.span()):
            continue
        value = m.group()
        before, after = text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]
        if novelty.bytes_of(before, value, after) >= least * expected_bytes(value):
            out.append((m.start(), 3, m.end()))
    return out


def identifiers(docs, count=IDENTIFIERS, id_col="doc_id", text_col="text"):
    """The identifiers near sensitive words that most documents share, rarest first, so
    that the compressor finds the common ones nearest; all documents are counted."""

    def run(batches):
        for batch in slices(batches):
            found = []
            for text in texts(batch):
                here = set()
                for start, end in sensitive_places(text):
                    here.update(_IDENTIFIER.findall(text, max(0, start - AROUND), end + AROUND))
                found += sorted(here)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["name"])

    rows = pick(docs, id_col, text_col).select("text").mapInArrow(run, "name STRING")
    counted = rows.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    top = counted.orderBy(F.desc("n"), "name").limit(count).collect()
    return [r.name for r in reversed(top)]


def find(text, novelty):
    base = base_spans(text)
    return base, sorted({*base, *novel_spans(text, novelty, base)})


def described(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs, known, id_col="doc_id", text_col="text"):
    """``doc_id``, base counts, base spans and all spans of every whole text."""
    novelty = Novelty(known)

    def run(batch):
        rows = []
        for text in texts(batch):
            base, spans = find(text, novelty)
            rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), described(base), described(spans)))
        return [pa.array(p, t) for p, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)]

    columns = "n_assign BIGINT, n_access BIGINT, n_hex BIGINT, base STRING, spans STRING"
    return per_text(pick(docs, id_col, text_col), run, columns)
