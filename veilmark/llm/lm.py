"""Stupid-backoff language-model scores, computed as joins.

The model is of order two over all words of all texts.  S(b | a) is count(a b) / count(a)
where the pair was counted at least ``LEAST`` times, and ``ALPHA`` * count(b) / total
elsewhere.  Counts come from all texts, the scored one too, so a pair counted once is
known from the scored text alone; taken at its count it would give a text of words that
nobody else uses the best score there is.

Words are numbered in three ways, none of which changes a result.  The most frequent ones,
a bounded number, have their rank and their count in a broadcast table.  Words that a
filter of fixed size shows to occur once need no count and form no pair of two.  Any other
word is a 62-bit hash, negative, and is counted where its rows meet.

Each text gives its distinct pairs, its distinct hashed words and one row of its own with
all that is known by then.  Pairs of ranked words are dealt to buckets by the pair; everything
else goes to the bucket of the hashed word that it holds, so that the word's count and those of
its pairs are taken there.  A pair of two hashed words goes to both, and gets each word's part
of its score there.  The parts are summed per text.  What the texts of a task give to a bucket
is shuffled as one value, its numbers sorted, parted into bytes and compressed, and so are the
parts of a block of texts; there are as many buckets as keep each within a bounded number of
words on average.

Pairs of two of the ``HEAD`` most frequent words are counted beforehand, within tasks
first, and need no shuffle in the scoring; any other pair holds a word that has at most
1 / HEAD of all occurrences, so no key of the shuffle can have more.  Broadcast are tables
of fixed size alone: ranked words, their counts, the filter, and the pairs of the head.

Defined results: words are runs without ASCII white space, A-Z lowered; a null or empty
text has no words and a null score; repeated rows are scored each; words of more than
``LONGEST`` bytes are known by a 128-bit digest.  With ``vocabulary``, the words that
``frequent`` takes for this number are all there are, and all others are one word.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from veilmark.llm.common import pick, raw_texts, slices, written

ALPHA = 0.4
LEAST = 2
#: Words with a rank, at most.
RANKED = 1 << 16
HEAD = 256
LONGEST = 64
#: Bits of the filter of words that occur twice or more, and of one of its slices.
_FILTER = 26
_SLICE = 22
_SHIFT = 17
_MASK = (1 << _SHIFT) - 1
#: Words of all texts that a bucket of the shuffle stands for, and entries a task holds before it deals them out.
BUCKET_WORDS = 1_000_000
HELD = 1_000_000


def words_of(data):
    words = data.lower().split()
    if words and max(map(len, words)) > LONGEST:
        # A blank is in no word.
        words = [w if len(w) <= LONGEST else b" " + hashlib.blake2b(w, digest_size=16).digest() for w in words]
    return words


def word_counts(rows):
    """``word, n`` over all texts; counted within tasks before the shuffle."""

    def run(batches):
        held = Counter()
        for batch in slices(batches):
            for data in raw_texts(batch):
                held.update(words_of(data))
            if len(held) > 300_000:
                yield _counted(held, pa.binary())
                held = Counter()
        yield _counted(held, pa.binary())

    return rows.select("text").mapInArrow(run, "key BINARY, n BIGINT").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(held, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), kind), pa.array(list(held.values()), pa.int64())], names=["key", "n"]
    )


def frequent(counted, most):
    """The most frequent words with their counts, ``most`` at most, by falling count.

    Counts fall into steps of a sixteenth of a doubling; the words of as many steps from
    above as fit are taken, so only they and the sizes of the steps reach the driver.
    Where no step fits, none is taken: the open model counts all words alike, ranked or not.
    """
    known = counted.withColumn("step", F.floor(F.log2("n") * 16))
    sizes = {r.step: r["count"] for r in known.groupBy("step").count().collect()}
    least, taken = None, 0
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > most:
            break
        least = step
    if least is None:
        return []
    rows = known.where(F.col("step") >= least).select("key", "n").collect()
    return sorted(((bytes(r.key), r.n) for r in rows), key=lambda r: (-r[1], r[0]))


def repeated(counted):
    """A filter of the words that occur twice or more, as bits by hash; its slices are
    filled in tasks."""

    def run(batches):
        held = {}
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _FILTER)
            part, place = hashes >> np.uint64(_SLICE), hashes & np.uint64((1 << _SLICE) - 1)
            for k in np.unique(part).tolist():
                held.setdefault(k, np.zeros(1 << _SLICE, bool))[place[part == k]] = True
        bits = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(bits, pa.binary())], names=["part", "bits"])

    hashes = counted.where("n > 1").select(F.xxhash64("key").alias("hash"))
    slices_of = hashes.repartition(1 << (_FILTER - _SLICE), F.shiftrightunsigned("hash", 64 - _FILTER + _SLICE))
    out = np.zeros((1 << (_FILTER - _SLICE), (1 << _SLICE) // 8), np.uint8)
    for r in slices_of.mapInArrow(run, "part BIGINT, bits BINARY").collect():
        out[r.part] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


class Numbers(dict):
    """Numbers of words: the rank from 1, 0 if the word occurs once, else a hash, negative
    and even.  Without ``more``, the filter of words that occur twice, all are 0 but ranked ones."""

    more = None

    def __missing__(self, word):
        if self.more is None:
            return 0
        code = xxhash.xxh64_intdigest(word, 42)
        place = code >> (64 - _FILTER)
        return -2 - (code >> 2 << 1) if self.more[place >> 3] >> (place & 7) & 1 else 0

    def of(self, data):
        words = words_of(data)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def head_pairs(rows, shared, head, first):
    """How often each pair of two head words occurs, numbered from ``first`` to ``head``; at
    most (head + 1) ** 2 rows."""

    def run(batches):
        size = head + 1
        held = np.zeros(size * size, np.int64)
        for batch in slices(batches):
            for data in raw_texts(batch):
                ids = shared.value.of(data)
                a, b = ids[:-1], ids[1:]
                both = (a >= first) & (a <= head) & (b >= first) & (b <= head)
                held += np.bincount(a[both] * size + b[both], minlength=size * size)
        at = np.flatnonzero(held)
        keys = (at // size) << _SHIFT | at % size
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held[at])], names=["key", "n"])

    return rows.select("text").mapInArrow(run, "key BIGINT, n BIGINT").groupBy("key").agg(F.sum("n").alias("n"))


class Model:
    """What every task needs: counts of ranked words and of pairs of head words, as logs.
    ``first`` is the least number of a word that forms pairs."""

    def __init__(self, counts, total, pairs, head, first, alpha=ALPHA, least=LEAST):
        with np.errstate(divide="ignore"):
            self.log_count = np.log10(np.asarray(counts, float))
            self.log_total = np.log10(float(total))
        self.back = np.log10(alpha) - self.log_total
        self.head, self.first = head, first
        self.gain = np.zeros((head + 1, head + 1))
        for key, n in pairs:
            if n >= least:
                a, b = key >> _SHIFT, key & _MASK
                self.gain[a, b] = np.log10(n) - self.log_count[a] - self.log_count[b] - self.back

    def start(self, ids):
        """The score with the counts of hashed words and all pairs left out but those of
        head words; and what is left out as keys, the places below a key, and times.

        Below a hashed word stand itself (0), the word before it (its rank, or its hash
        and 1) and the word after it (its rank from ``1 << _SHIFT`` on, or its hash).
        """
        if not len(ids):
            return 0.0, ids, ids, ids
        a, b = ids[:-1], ids[1:]
        both = (a >= self.first) & (a <= self.head) & (b >= self.first) & (b <= self.head)
        base = self.log_count[ids[ids >= 0]].sum() - self.log_total + self.back * len(a)
        base += self.gain[a[both], b[both]].sum()
        rest = ~both if not self.first else ~both & (a != 0) & (b != 0)
        a, b = a[rest], b[rest]
        here, there = a < 0, b < 0
        ranked, before, after, hashed = ~here & ~there, ~here & there, here & ~there, here & there
        words = ids[ids < 0]
        none = np.zeros(ranked.sum() + len(words), np.int64)
        keys = np.concatenate([a[ranked] << _SHIFT | b[ranked], words, b[before], a[after], a[hashed], b[hashed]])
        grams = np.concatenate([none, a[before], b[after] + (1 << _SHIFT), b[hashed], a[hashed] + 1])
        order = np.lexsort((grams, keys))
        keys, grams = keys[order], grams[order]
        at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (grams[1:] != grams[:-1]))[: len(keys)])
        return float(base), keys[at], grams[at], np.diff(np.append(at, len(keys)))


#: Numbers of an entry: key, place below it, text (counted from the first of the value), times.
_FIELDS = [("key", "<i8"), ("gram", "<i8"), ("row", "<u4"), ("times", "<u4")]
#: Numbers of a sum: text, counted as above, and what is added to its score.
_SUMS = [("row", "<u4"), ("sum", "<f8")]
#: Sums of so many texts in a row (as a power of two) are brought together at once.
_BLOCK = 14


def _bytes(fields, a, b):
    """Numbers as one value.  Sorted ones share their high bytes, so all first bytes go
    together, all second ones, and so on."""
    planes = b"".join(x[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for x in fields)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed, fields):
    """The numbers of all values of a table; texts by their row."""
    kinds = [np.dtype(kind) for _, kind in fields]
    parts = [[np.empty(0, np.float64 if k.kind == "f" else np.int64)] for k in kinds]
    for value, first, n in zip(packed["data"], packed["row"].to_pylist(), packed["n"].to_pylist()):
        size = n * sum(k.itemsize for k in kinds)
        planes, at = np.frombuffer(pa.decompress(value.as_buffer(), size, codec="zstd"), np.uint8), 0
        for part, (name, _), kind in zip(parts, fields, kinds):
            numbers = planes[at:at + n * kind.itemsize].reshape(-1, n).T.copy().view(kind).ravel().astype(part[0].dtype)
            part.append(numbers + first if name == "row" else numbers)
            at += n * kind.itemsize
    return [np.concatenate(p) for p in parts]


def _parted(table):
    """The rows of texts, and those that hold a value."""
    return table.filter(pc.is_null(table["data"])), table.filter(pc.is_valid(table["data"]))


def _packed(held, buckets, kind):
    """The entries of some texts, one value for each bucket; ``n`` is their number, ``row`` the
    first text."""
    rows = np.repeat(np.array([h[0] for h in held]), [len(h[1]) for h in held])
    keys, grams, times = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    order = np.argsort(keys, kind="stable")
    mixed = keys[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    bucket = (mixed % np.uint64(buckets)).astype(np.uint16)
    dealt = np.argsort(bucket, kind="stable")
    order, bucket = order[dealt], bucket[dealt]
    first = held[0][0]
    fields = [x[order].astype(kind) for x, (_, kind) in zip((keys, grams, rows - first, times), _FIELDS)]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(at[1:], len(bucket))
    values = [_bytes(fields, a, b) for a, b in zip(at.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[at].astype(np.int64)), pa.array(values, pa.binary()), pa.array(np.full(len(at), first)),
            pa.array((ends - at).astype(np.int64)), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), kind),
        ],
        names=["bucket", "data", "row", "n", "total", "doc_id"],
    )


def _packed_sums(rows, sums, kind):
    """What a bucket adds to texts, one value for each block of texts."""
    blocks, at = np.unique(rows >> _BLOCK, return_index=True)
    ends = np.append(at[1:], len(rows)).astype(np.int64)
    firsts = blocks << _BLOCK
    fields = [(rows - np.repeat(firsts, ends - at)).astype(_SUMS[0][1]), sums.astype(_SUMS[1][1])]
    values = [_bytes(fields, a, b) for a, b in zip(at.tolist(), ends.tolist())]
    return pa.table({
        "block": pa.array(blocks), "data": pa.array(values, pa.binary()), "row": pa.array(firsts), "n": pa.array(ends - at),
        "total": pa.nulls(len(at), pa.float64()), "doc_id": pa.nulls(len(at), kind),
    })


def _gains(entries, model, least):
    """What the entries of a bucket add to the scores: texts, each once, and sums.

    A pair adds the log of its count, less those of both words and of backing off; a hashed
    word adds the log of its own.
    """
    keys, grams, rows, times = entries
    if not len(keys):
        return rows, np.empty(0)
    order = np.lexsort((grams, keys))
    keys, grams, rows, times = keys[order], grams[order], rows[order], times[order]
    new_key = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(new_key | np.append(True, grams[1:] != grams[:-1]))
    sizes = np.diff(np.append(at, len(keys)))
    key, gram, n = keys[at], grams[at], np.add.reduceat(times, at)
    # How often the hashed word of a key occurs stands at its place 0.
    of_key = np.cumsum(new_key[at]) - 1
    n_key = np.zeros(of_key[-1] + 1)
    word = (key < 0) & (gram == 0)
    n_key[of_key[word]] = n[word]
    with np.errstate(divide="ignore"):
        log_key = np.log10(n_key)[of_key]
    logs = np.where(np.isfinite(model.log_count), model.log_count, 0.0)
    gain = np.log10(n) - model.back
    ranked, before, after = key >= 0, (key < 0) & (gram > 0) & (gram <= _MASK), (key < 0) & (gram > _MASK)
    gain[ranked] -= logs[key[ranked] >> _SHIFT] + logs[key[ranked] & _MASK]
    gain[before] -= logs[gram[before]]
    gain[after] -= logs[gram[after] - (1 << _SHIFT)]
    gain[~ranked] -= log_key[~ranked]
    second = (key < 0) & (gram < 0) & (gram & 1 == 1)
    gain[second] = -log_key[second]
    gain[n < least] = 0.0
    gain[word] = log_key[word]
    texts, place = np.unique(rows, return_inverse=True)
    sums = np.bincount(place, np.repeat(gain, sizes) * times, len(texts))
    hit = np.bincount(place, np.repeat(word | (n >= least), sizes), len(texts)) > 0
    return texts[hit], sums[hit]


def score(
    docs, id_col="doc_id", text_col="text", vocabulary=None, head=HEAD, alpha=ALPHA, least=LEAST, ranked=RANKED,
):
    """``doc_id, n_words, log10_score, per_word`` of every whole text."""
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col)
    counted = written(word_counts(rows), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = frequent(counted, ranked if vocabulary is None else vocabulary)
    numbers = Numbers((word, i) for i, (word, _) in enumerate(top, 1))
    counts = np.array([1] + [n for _, n in top], float)
    if vocabulary is not None:
        counts[0] = total - counts[1:].sum()
    else:
        # Where pairs seen once count, words that occur once form pairs like any other.
        numbers.more = repeated(counted) if least > 1 else b"\xff" * (1 << _FILTER - 3)
    first, head = int(vocabulary is None), min(head, len(top))
    shared = spark.sparkContext.broadcast(numbers)
    pairs = [tuple(r) for r in head_pairs(rows, shared, head, first).collect()]
    model = spark.sparkContext.broadcast(Model(counts, total, pairs, head, first, alpha, least))
    buckets = min(max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_WORDS)), 1 << 16)

    def deal(batches):
        held, size = [], 0
        for batch in slices(batches):
            none = batch.column(0).type
            where = batch.column(batch.schema.get_field_index("row")).to_numpy()
            sizes, bases = [], []
            for row, data in zip(where.tolist(), raw_texts(batch)):
                ids = shared.value.of(data)
                base, *entries = model.value.start(ids)
                held.append((row, *entries))
                size += len(entries[0])
                sizes.append(len(ids))
                bases.append(base)
                if size >= HELD:
                    yield _packed(held, buckets, none)
                    held, size = [], 0
            # A text's own row goes along with a bucket, so that one shuffle does.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(where % buckets), pa.nulls(len(where), pa.binary()), pa.array(where),
                    pa.array(sizes, pa.int64()), pa.array(bases, pa.float64()), batch.column(0),
                ],
                names=["bucket", "data", "row", "n", "total", "doc_id"],
            )
        if size:
            yield _packed(held, buckets, none)

    def add_up(table):
        own, packed = _parted(table)
        rows_of, gains = _gains(_unpacked(packed, _FIELDS), model.value, least)
        sums = _packed_sums(rows_of, gains, table["doc_id"].type)
        own = own.append_column("block", pa.array(own["row"].to_numpy() >> _BLOCK, pa.int64()))
        return pa.concat_tables([own.select(names), sums.select(names)])

    def finish(table):
        own, packed = _parted(table)
        rows_of, sums = _unpacked(packed, _SUMS)
        order = np.argsort(own["row"].to_numpy())
        place = np.searchsorted(own["row"].to_numpy(), rows_of, sorter=order)
        added = np.bincount(order[place], sums, len(own))
        return pa.table([own["doc_id"], own["n"], pa.array(own["total"].to_numpy() + added)], names=["doc_id", "n_words", "total"])

    names = ["block", "data", "row", "n", "total", "doc_id"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"data BINARY, row BIGINT, n BIGINT, total DOUBLE, doc_id {kind}"
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.mapInArrow(deal, f"bucket BIGINT, {schema}")
    parts = dealt.groupBy("bucket").applyInArrow(add_up, f"block BIGINT, {schema}")
    summed = parts.groupBy("block").applyInArrow(finish, f"doc_id {kind}, n_words BIGINT, total DOUBLE")
    empty = F.col("n_words") == 0
    return summed.select(
        "doc_id", "n_words", F.when(~empty, F.col("total")).alias("log10_score"),
        F.when(~empty, F.col("total") / F.col("n_words")).alias("per_word"),
    )
