"""Benchmark decontamination by a prefix-filtered set join.

The shingles of an item are its windows of ten words.  A window occurs in a document only
if all of its words do, so its necessary prefix is one token: the word of the window that
is rarest in the corpus.  Words of documents are joined with these prefix tokens; the
place of the token in its window gives the only place where the window can begin
(positional bound), which must leave room for its length (length bound); what remains is
compared word by word.  The share of an item's windows that a document holds is then
taken over stretches of the item's own size.

Rarity is counted over all documents, for words of the benchmark only.  The index of the
benchmark goes to the tasks in blocks of bounded size; a benchmark beyond one block is
worked off block by block, each against all documents.

Defined results: a null or empty text has no words and no hits; an item without words has
no windows and never occurs; rows of the benchmark with one id, or none, are one item, reported
once; item ids may be of any type; repeated documents are reported each on a row; with an
empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm.common import boxed, per_text, pick, raw_texts, slices, written

WINDOW = 10
#: Bytes of item texts in one block of the benchmark.
BLOCK_BYTES = 16 << 20

# Word bytes stay, A-Z are lowered, all others become blanks.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(data):
    """The words of UTF-8 bytes: runs of ASCII letters, digits and non-ASCII characters."""
    return data.translate(_TABLE).split()


def item_windows(words, size=WINDOW):
    """The windows of an item; an item shorter than one is a window itself."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Index:
    """Windows by prefix token and its place."""

    def __init__(self, items, counts, size=WINDOW):
        """``items``: (id, words), an id once for each of its texts; ``counts``: how often each
        word occurs in the corpus."""
        texts_of = {}
        for i, words in items:
            texts_of.setdefault(i, []).append(words)
        self.item_words = [max(map(len, found)) for found in texts_of.values()]
        self.ids = list(texts_of)
        self.n_windows = []
        self.by_token = {}
        for number, found in enumerate(texts_of.values()):
            windows = dict.fromkeys(w for words in found for w in item_windows(words, size))
            self.n_windows.append(len(windows))
            for window in windows:
                place = min(range(len(window)), key=lambda k: (counts.get(window[k], 0), window[k], k))
                places = self.by_token.setdefault(window[place], {})
                places.setdefault((place, len(window)), {}).setdefault(window, []).append(number)
        self.tokens = frozenset(self.by_token)

    def scan(self, words):
        """The places of hit words, and for each item met its windows as (start, window)."""
        if self.tokens.isdisjoint(words):
            return set(), {}
        n, hit, met = len(words), set(), defaultdict(list)
        for at, word in enumerate(words):
            places = self.by_token.get(word)
            if places is None:
                continue
            for (place, length), windows in places.items():
                start = at - place
                if start < 0 or start + length > n:
                    continue
                window = tuple(words[start : start + length])
                found = windows.get(window)
                if found:
                    hit.update(range(start, start + length))
                    for number in found:
                        met[number].append((start, window))
        return hit, met

    def containment(self, number, found):
        """The largest share of an item's windows within one stretch of the item's size."""
        found = sorted(found)
        span = self.item_words[number]
        inside, first, best = Counter(), 0, 0
        for start, window in found:
            inside[window] += 1
            while start + len(window) - found[first][0] > span:
                gone = found[first][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                first += 1
            best = max(best, len(inside))
        return best / self.n_windows[number]


def corpus_counts(docs, vocabulary):
    """How often each word of ``vocabulary`` occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches):
        counts, known = Counter(), shared.value
        for batch in slices(batches):
            for data in raw_texts(batch):
                counts.update(filter(known.__contains__, words_of(data)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    rows = docs.select("text").mapInArrow(run, "word BINARY, n BIGINT")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def blocks(items, limit=BLOCK_BYTES):
    """The items in lists of bounded size; whole items only, with all texts of one id."""
    block, size = [], 0
    for row in items.orderBy("doc_id").toLocalIterator():
        data = (row.text or "").encode("utf-8", "surrogatepass")
        if block and size + len(data) > limit and row.doc_id != block[-1][0]:
            yield block
            block, size = [], 0
        block.append((row.doc_id, words_of(data)))
        size += len(data)
    yield block


STATE = "n_words BIGINT, hits ARRAY<INT>, items ARRAY<STRUCT<item_id: STRING, containment: DOUBLE>>"


def scan_documents(docs, index, keep=("doc_id",)):
    """Add to each document its number of words, the places of hit words and the items met.

    A table that already has these columns from an earlier block has them extended.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("containment", pa.float64())]))
    again = "hits" in docs.columns

    def run(batch):
        here, rows = shared.value, []
        before = (
            [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hits", "items")]
            if again else None
        )
        for i, data in enumerate(raw_texts(batch)):
            words = words_of(data)
            hits, met = here.scan(words)
            items = [{"item_id": here.ids[k], "containment": here.containment(k, v)} for k, v in met.items()]
            if before:
                hits.update(before[0][i])
                items = before[1][i] + items
            rows.append((len(words), sorted(hits), items))
        n_words, hits, items = zip(*rows)
        return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, kind)]

    return per_text(docs, run, STATE, keep, reads=("hits", "items") if again else ())


def contamination(
    docs, benchmark, window=WINDOW, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
    block_bytes=BLOCK_BYTES,
):
    """``doc_id, n_words, n_hit, hits, items`` of every document.

    ``hits`` are the places of words inside any occurrence of a window.  ``items`` holds
    each benchmark item with an occurring window, once, and the largest share of its
    windows within one stretch of its size.
    """
    items = pick(benchmark, item_col, item_text)
    state = _scanned(pick(docs, id_col, text_col), items, window, block_bytes, "doc_id")
    kind = items.schema["doc_id"].dataType
    items = F.transform(
        "items", lambda x: F.struct(x["item_id"].cast(kind).alias("item_id"), x["containment"].alias("containment"))
    )
    return state.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", items.alias("items"))


def clean_documents(
    docs, benchmark, window=WINDOW, text_col="text", item_col="item_id", item_text="text", block_bytes=BLOCK_BYTES,
):
    """The documents without a window of any item, with all their columns; each row is judged
    by its own text."""
    inner, back = boxed(docs, text_col)
    items = pick(benchmark, item_col, item_text)
    return back(_scanned(inner, items, window, block_bytes, "rest", "text").where("size(hits) = 0"))


def _scanned(rows, items, window, block_bytes, *keep):
    """The kept columns and the state of each row after all blocks of the benchmark."""
    items = items.withColumn("doc_id", F.col("doc_id").cast("string"))  # ids of any type, through the tasks
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    single, state = total <= block_bytes, rows
    for block in blocks(items, block_bytes):
        vocabulary = {w for _, words in block for w in words}
        counts = {}
        if vocabulary:
            counts = {bytes(r.word): r.n for r in corpus_counts(rows, vocabulary).toLocalIterator()}
        index = Index(block, counts, window)
        state = scan_documents(state, index, keep if single else tuple(dict.fromkeys([*keep, "text"])))
        if not single:
            state = written(state, "decontaminated")
    return state
