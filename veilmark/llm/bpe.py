"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes if and only if each token is its
own encoding and each two neighbours are: a merge across a boundary would already occur
between the two tokens beside it.  So for every prefix of a piece exactly one token can
come last, and ``last[i]`` is found from left to right: the token that ends at i, fits
after ``last`` of the place where it starts.  Following ``last`` backwards from any
prefix gives the encoding of that prefix.  Bytes appended to a piece only add entries;
an edit leaves all entries before it, and the pieces after it, as they are.

The tokens that end at each place come from one Aho-Corasick pass.  Whether two tokens may
be neighbours is read off their edges: how the right edge of the one and the left edge of
the other grow, merge by merge, and whether a merge across the boundary comes first.

Texts are cut into pieces by the pattern of the vocabulary first.  Words between single
blanks are cut and encoded alone and remembered per worker in one table whose size is
bounded in bytes.

Defined results: null or empty text gives no ids; every text decodes to its own bytes;
ids that are not in the vocabulary fail the decoding, null ids give empty bytes.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from veilmark.llm.common import per_text, pick, releasing, texts

#: Bytes of a worker's table of encoded words, in each of two generations, and what an entry
#: takes besides its own characters.  A worker keeps its table from task to task.
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 220
#: Checked pairs of neighbours that a worker remembers.
PAIRS = 250_000


class Vocabulary:
    """Ranks of tokens, where they end in a text, and the checks between neighbours."""

    def __init__(self, ranks, pattern):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.longest = max(map(len, ranks), default=0)
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        if ranks:
            self.ends.make_automaton()
        self.packed = [_packed([rank]) for rank in range(len(self.bytes_of))]
        self.fits, self.pairs = {}, 0
        self.edges, self.alone, self.whole = {}, {}, {}

    def merge(self, data):
        """Plain BPE by the lowest rank, leftmost first: for checks alone."""
        return [self.ranks[p] for p in self._merged(data, 1)]

    def _merged(self, data, least):
        """The parts after merging until ``least`` are left, or no pair merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token):
        """How a token grows at its left and at its right end: bytes and ranks of the parts
        there, from the first byte to the token; None if it is not the encoding of its bytes."""
        known = self.edges.get(token, self)
        if known is not self:
            return known
        data = self.bytes_of[token]
        if len(data) == 1:
            known = ([(data, token)], [(data, token)])
        else:
            parts = self._merged(data, 2)
            known = None
            if len(parts) == 2:
                left, right = (self.edge(self.ranks[p]) for p in parts)
                known = (left[0] + [(data, token)], right[1] + [(data, token)])
        self.edges[token] = known
        return known

    def stands(self, token):
        """Whether a token is the encoding of its own bytes."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.edge(token) is not None
            if known:
                self.whole[self.bytes_of[token]] = self.packed[token]
        return known

    def follows(self, left, right):
        """Whether ``right`` may stand after ``left``; ``fits`` remembers it by ``left``."""
        row = self.fits.get(left)
        if row is None:
            row = self.fits[left] = {}
        known = row.get(right)
        if known is None:
            known = self._stable(left, right)
            if self.pairs >= PAIRS:  # rows that are in use elsewhere stay right, they are only left behind
                self.fits, self.pairs, row = {}, 0, {}
                self.fits[left] = row
            row[right] = known
            self.pairs += 1
        return known

    def _stable(self, left, right):
        """Merges happen in order of rank, of equal ones the leftmost first.  Both edges grow
        until a merge across the boundary is due before the next one of either side."""
        if not self.stands(left) or not self.stands(right):
            return False
        ones, twos, ranks = self.edges[left][1], self.edges[right][0], self.ranks
        i, j, last_one, last_two = 0, 0, len(ones) - 1, len(twos) - 1
        while True:
            across = ranks.get(ones[i][0] + twos[j][0])
            next_one = ones[i + 1][1] if i < last_one else None
            next_two = twos[j + 1][1] if j < last_two else None
            if across is not None and (next_one is None or across < next_one) and (
                next_two is None or across <= next_two
            ):
                return False
            if next_one is None and next_two is None:
                return True
            if next_two is None or (next_one is not None and next_one <= next_two):
                i += 1
            else:
                j += 1

    def extend(self, lasts, data):
        """Append the last token of each prefix of ``data`` that ``lasts`` does not cover."""
        known, follows = len(lasts) - 1, self.follows
        lasts.extend([None] * (len(data) - known))
        first = max(0, known + 1 - self.longest)
        for end, (size, token) in self.ends.iter(data[first:].decode("latin-1")):
            end += first + 1
            if end <= known or lasts[end] is not None:
                continue
            start = end - size
            if start:
                if lasts[start] is not None and follows(lasts[start], token):
                    lasts[end] = token
            elif self.stands(token):
                lasts[end] = token
        if None in lasts[max(known, 0) + 1 :]:
            raise ValueError("the vocabulary lacks a byte")

    def ids(self, lasts, end):
        """The encoding of a prefix."""
        out, bytes_of = [], self.bytes_of
        while end:
            token = lasts[end]
            out.append(token)
            end -= len(bytes_of[token])
        out.reverse()
        return out

    def encode_piece(self, piece):
        """The ids of one piece, packed: the prefix table of ``extend``, from the start."""
        data = piece.encode()
        whole = self.whole.get(data)
        if whole is not None:
            return whole
        size = len(data)
        lasts, rows = [None] * (size + 1), [None] * (size + 1)
        rows[0] = self.alone
        for end, (length, token) in self.ends.iter(data.decode("latin-1")):
            end += 1
            if lasts[end] is None:
                start = end - length
                fit = rows[start].get(token)
                if fit is None:
                    fit = self.follows(lasts[start], token) if start else self.stands(token)
                if fit:
                    lasts[end] = token
                    row = self.fits.get(token)
                    if row is None:
                        row = self.fits[token] = {}
                    rows[end] = row
        if None in lasts[1:]:
            raise ValueError("the vocabulary lacks a byte")
        out, packed, bytes_of = [], self.packed, self.bytes_of
        while size:
            token = lasts[size]
            out.append(packed[token])
            size -= len(bytes_of[token])
        out.reverse()
        return b"".join(out)


@lru_cache(maxsize=2)
def load(path, pattern):
    """The vocabulary of a rank file: base64 token and rank per line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


class Piece:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary, data=b""):
        self.vocabulary, self.data, self.lasts = vocabulary, b"", [None]
        self.append(data)

    def append(self, more):
        """Add bytes; entries of earlier prefixes stay as they are."""
        self.data += more
        self.vocabulary.extend(self.lasts, self.data)
        return self

    def edit(self, start, stop, new):
        """Replace bytes start:stop; entries up to start are reused."""
        tail = new + self.data[stop:]
        self.data = self.data[:start]
        del self.lasts[start + 1 :]
        return self.append(tail)

    def ids(self, end=None):
        """The encoding of the first ``end`` bytes, all by default."""
        return self.vocabulary.ids(self.lasts, len(self.data) if end is None else end)


class _Memo(dict):
    """A table in two generations, bounded in bytes: what was used since the last turn
    survives the next."""

    def __init__(self, make, limit):
        super().__init__()
        self.make, self.limit, self.old, self.size = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self.size += ENTRY_BYTES + len(key) + (len(value) if value else 0)
        self[key] = value
        return value


class Encoder:
    """Encode whole texts to packed little-endian 32-bit ids."""

    def __init__(self, vocabulary, limit=CACHE_BYTES):
        self.vocabulary = vocabulary
        self.words = _Memo(self._word, limit)

    def clear(self):
        """Forget all words."""
        self.words = _Memo(self._word, self.words.limit)

    def direct(self, text):
        """Cut and encode; pieces that begin with a blank go by the table, under a key that
        no word has."""
        pieces, make = self.vocabulary.pattern.findall(text), self.vocabulary.encode_piece
        if len(pieces) == 1:
            return pieces[0][0] == " " and self.words.get(pieces[0]) or make(pieces[0])
        return b"".join([self.words[p] if p[0] == " " else make(p) for p in pieces])

    def _word(self, word):
        """A blank and a word, or None if white space at an end keeps it from being cut
        apart from its neighbours.  A piece that begins with a blank is encoded as it is."""
        if word and word[0] == " ":
            return self.vocabulary.encode_piece(word)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self.direct(" " + word)

    def encode(self, text):
        words = text.split(" ")
        if len(words) == 1 or not words[0] or words[0][-1].isspace():
            return self._grouped(words)
        try:
            return self.direct(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))
        except TypeError:  # a word gave None
            return self._grouped(words)

    def _grouped(self, words):
        """Cut at those blanks that have no other white space beside them."""
        out, group = [], [words[0]]
        for before, word in zip(words, words[1:]):
            if before and word and not before[-1].isspace() and not word[0].isspace():
                out.append(self._part(group))
                group = ["", word]
            else:
                group.append(word)
        out.append(self._part(group))
        return b"".join(out)

    def _part(self, group):
        """A stretch between such blanks; where it is a blank and one word, by the table."""
        if len(group) == 2 and not group[0]:
            known = self.words[group[1]]
            if known is not None:
                return known
        return self.direct(" ".join(group))


def _packed(ids):
    return np.asarray(ids, dtype="<i4").tobytes()


_encoders = {}


def encoder(path, pattern):
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(load(path, pattern))
    return _encoders[key]


def lists(parts, kind=pa.int32(), width=4):
    """Packed values as an Arrow list column, one list per part."""
    data = b"".join(parts)
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(kind, len(data) // width, [None, pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(docs, path, pattern, id_col="doc_id", text_col="text"):
    """``doc_id, ids`` of every whole text, without special tokens."""

    def run(batch):
        make = encoder(path, pattern).encode
        return [lists([make(t) for t in texts(batch)])]

    return per_text(pick(docs, id_col, text_col), run, "ids ARRAY<INT>")


def round_trip(docs, path, pattern, id_col="doc_id", text_col="text"):
    """``doc_id, ids, data``: encoded and decoded again in one pass over the texts."""

    def run(batch):
        lookup = load(path, pattern).bytes_of.__getitem__
        make = encoder(path, pattern).encode
        parts = [make(t) for t in texts(batch)]
        data = [b"".join(map(lookup, np.frombuffer(p, "<i4").tolist())) for p in parts]
        return [lists(parts), pa.array(data, pa.binary())]

    return per_text(pick(docs, id_col, text_col), run, "ids ARRAY<INT>, data BINARY")


def decode(encoded, path, pattern, id_col="doc_id", ids_col="ids"):
    """``doc_id, ids, data``: the bytes that the ids stand for."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        lookup = load(path, pattern).bytes_of.__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                data = [b"".join(map(lookup, ids or ())) for ids in batch.column(1).to_pylist()]
                arrays = [*batch.columns, pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "data"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(releasing(run), f"doc_id {kind}, ids ARRAY<INT>, data BINARY")


class Encoded:
    """A text with its pieces and their ids, to be appended to and edited in place.

    ``begins`` holds where pieces begin, ``parts`` the ids of each.  An edit cuts and encodes
    anew from the piece before it to the first place behind it where an old piece begins;
    all other pieces keep their ids.
    """

    def __init__(self, text, path, pattern, ids=None):
        self.vocabulary, self.text = load(path, pattern), text
        spans = [m.span() for m in self.vocabulary.pattern.finditer(text)]
        self.begins = [a for a, _ in spans]
        if ids is None:
            self.parts = [self._ids(text[a:b]) for a, b in spans]
        else:  # known ids are dealt out to the pieces by their lengths
            sizes = self.vocabulary.bytes_of
            self.parts, at = [], 0
            for a, b in spans:
                left, part = len(text[a:b].encode()), []
                while left:
                    part.append(ids[at])
                    left -= len(sizes[ids[at]])
                    at += 1
                self.parts.append(part)

    def _ids(self, piece):
        return np.frombuffer(self.vocabulary.encode_piece(piece), dtype="<i4").tolist()

    def ids(self):
        return [i for part in self.parts for i in part]

    def append(self, more):
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start, stop, new):
        """Replace ``text[start:stop]``; returns the number of pieces encoded."""
        text = self.text = self.text[:start] + new + self.text[stop:]
        shift, safe = len(new) - (stop - start), start + len(new)
        # A piece ends where the next one begins, and a match looks one character ahead.
        keep = max(0, bisect_left(self.begins, start - 1) - 1)
        at = self.begins[keep] if keep < len(self.begins) else 0
        begins, parts, match = [], [], self.vocabulary.pattern.match
        behind = len(self.begins)
        while at < len(text):
            if at >= safe:
                place = bisect_left(self.begins, at - shift)
                if place < len(self.begins) and self.begins[place] == at - shift and at - shift >= stop:
                    behind = place
                    break
            found = match(text, at)
            begins.append(at)
            parts.append(self._ids(found.group()))
            at = found.end()
        self.begins[keep:] = begins + [b + shift for b in self.begins[behind:]]
        self.parts[keep:] = parts + self.parts[behind:]
        return len(parts)


def append_text(text, ids, more, path, pattern):
    """The ids of ``text + more`` from those of ``text``: only the last pieces change."""
    return edit_text(text, ids, len(text), len(text), more, path, pattern)


def edit_text(text, ids, start, stop, new, path, pattern):
    """The ids after ``text[start:stop]`` was replaced by ``new``; the text is cut into pieces,
    but only those near the edit are encoded.  ``Encoded`` keeps them for further edits."""
    known = Encoded(text, path, pattern, ids)
    known.edit(start, stop, new)
    return known.ids()
