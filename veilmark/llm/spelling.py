"""Spelling variants: words one edit apart, and the form that each is a variant of.

1. Tasks count the words of their texts; Spark adds the counts.
2. A pair one edit apart, of longer length m, agrees before and after the edit.  A word
   is cut at the same places as the longer one of a pair would be, and for each part
   gives the key of everything outside that part, once for m its own length and once for
   one more.  The pair meets under the part that holds its first difference.
3. Words that share a key are compared densely: padded matrices of code points, block
   against block; the common prefix and the common suffix together reach the longer length
   less one for one edit.  The pair counts only under the part where its common
   prefix ends, so it counts once without being gathered.
4. A key that more than ``TILE`` words share is dealt out: its words go into blocks by hash, and
   each pair of blocks is a tile of its own, in a task of bounded memory.
5. Tasks return the number and the best of the near words of each word, not pairs.  Forms are
   followed to the last by self-joins that double the distance.

Defined results: null and empty texts have no words; a null id counts as the empty text in the
hash; repeated rows count each; of near words with equal counts the smallest in code-point order is
the form; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilmark.llm.common import pick, releasing, slices, small_side, texts, written

#: Words are runs of these letters; only A-Z are lowered.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: One in so many words of a text loses a letter, by its hash.
SLIP = 199
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Parts that a word is cut into.
PARTS = 4
#: Words of one key that are compared in one tile, and rows of a block inside it.
TILE = 1024
BLOCK = 128
#: Entries of a task's dictionary of counts, and code points compared at once.
ENTRIES = 200_000
CELLS = 4 << 20


def count_words(docs, id_col="doc_id", text_col="text", slip=SLIP):
    """``word, n`` of the words with ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""
    find = re.compile(LETTERS).findall

    def batch_of(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        total = {}
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for i, text in zip(ids, texts(batch)):
                # Lowering bytes leaves all but A-Z as they are.
                own = Counter(find(text.encode().lower().decode()))
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        total[word] = total.get(word, 0) + n
                if len(total) >= ENTRIES:
                    yield batch_of(total)
                    total = {}
        if total:
            yield batch_of(total)

    counted = pick(docs, id_col, text_col).mapInArrow(releasing(run), "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def keys_of(words, parts=PARTS):
    """Add ``m, part, key`` to words, two times ``parts`` rows each."""
    row = (
        "named_struct('m', m, 'part', part, 'key', xxhash64(m, part, left(word, part * m div {p}), "
        "right(word, m - (part + 1) * m div {p})))"
    ).format(p=parts)
    rows = f"transform(sequence(0, {parts - 1}), part -> {row})"
    both = f"flatten(transform(array(length(word), length(word) + 1), m -> {rows}))"
    return words.select("word", "n", F.inline(F.expr(both)))


def tiles_of(keyed, tile=TILE):
    """Add the tile ``i, j`` and the word's own block ``b``: (0, 0) but for large groups."""
    large = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    large = small_side(written(large, "large"))
    dealt = keyed.join(large, "key", "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    )
    dealt = dealt.withColumn("b", F.expr("cast(pmod(xxhash64(word, 7), blocks) AS int)"))
    pairs = "transform(sequence(0, blocks - 1), x -> named_struct('i', least(b, x), 'j', greatest(b, x)))"
    return dealt.select("key", "m", "part", "word", "n", "b", F.inline(F.expr(pairs)))


def _codes(words, width):
    """Code points, one row a word, zeros behind, and the same with zeros in front."""
    front = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(-1, width)
    back = np.array([w[::-1] for w in words], dtype=f"U{width}").view(np.uint32).reshape(-1, width)
    return front, back


def _agreement(one, two):
    """Length of the common start of each row of ``one`` with each of ``two``, by group."""
    differ = one[:, :, None, :] != two[:, None, :, :]
    return np.where(differ.any(axis=3), differ.argmax(axis=3), one.shape[2])


def near_pairs(words, starts, sizes, width, part, blocks, cross, parts=PARTS):
    """Row numbers of the pairs one edit apart, of longer length ``width``.

    Groups are runs of rows: their starts, sizes and parts; ``blocks`` is the block of each
    row, and in a group marked ``cross`` only rows of different blocks are compared.
    """
    front, back = _codes(words, width)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ones, twos = [], []
    classes = np.maximum(1 << np.ceil(np.log2(sizes)).astype(np.int64), 2)
    for size in np.unique(classes):
        chosen = np.flatnonzero(classes == size)
        edge = min(int(size), BLOCK)
        step = max(1, CELLS // (edge * edge * width))
        for at in range(0, len(chosen), step):
            groups = chosen[at : at + step]
            place = np.arange(size)
            held = place[None, :] < sizes[groups][:, None]
            rows = np.where(held, starts[groups][:, None] + place[None, :], starts[groups][:, None])
            low, high = part[groups] * width // parts, (part[groups] + 1) * width // parts
            for x in range(0, int(size), edge):
                for y in range(x, int(size), edge):
                    a, b = rows[:, x : x + edge], rows[:, y : y + edge]
                    ok = held[:, x : x + edge, None] & held[:, None, y : y + edge] & (a[:, :, None] < b[:, None, :])
                    ok &= np.maximum(lengths[a][:, :, None], lengths[b][:, None, :]) == width
                    ok &= ~cross[groups][:, None, None] | (blocks[a][:, :, None] != blocks[b][:, None, :])
                    if not ok.any():
                        continue
                    before = _agreement(front[a], front[b])
                    ok &= (before >= low[:, None, None]) & (before < high[:, None, None])
                    ok &= before + _agreement(back[a], back[b]) >= width - 1
                    g, i, j = np.nonzero(ok)
                    ones.append(a[g, i])
                    twos.append(b[g, j])
    return (np.concatenate(ones), np.concatenate(twos)) if ones else (np.empty(0, int), np.empty(0, int))


_NEAR = ["word", "n_near", "best_n", "best"]


def _compared(table, starts):
    """The near words of whole groups: rows of ``_NEAR`` for the words that have some."""
    ends = np.append(starts[1:], table.num_rows)
    columns = {c: table.column(c).to_numpy() for c in ("n", "m", "part", "b", "i", "j")}
    words = table.column("word").to_pylist()
    order = sorted(range(len(words)), key=lambda r: (-columns["n"][r], words[r]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    sizes = ends - starts
    for width in np.unique(columns["m"][starts]):
        groups = np.flatnonzero((columns["m"][starts] == width) & (sizes > 1))
        if not len(groups):
            continue
        rows = np.concatenate([np.arange(starts[g], ends[g]) for g in groups])
        firsts = np.concatenate([[0], np.cumsum(sizes[groups])[:-1]])
        first = starts[groups]
        one, two = near_pairs(
            [words[r] for r in rows], firsts, sizes[groups], int(width), columns["part"][first].astype(np.int64),
            columns["b"][rows], columns["i"][first] != columns["j"][first],
        )
        for a, b in ((rows[one], rows[two]), (rows[two], rows[one])):
            np.add.at(count, a, 1)
            np.minimum.at(best, a, rank[b])
    found = np.flatnonzero(count)
    near = [order[k] for k in best[found]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[r] for r in found], pa.string()), pa.array(count[found]),
            pa.array(columns["n"][near] if len(near) else [], pa.int64()), pa.array([words[r] for r in near], pa.string()),
        ],
        names=_NEAR,
    )


def _near_words(batches):
    """Compare the tiles of a sorted partition; a tile may go on in the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch])
        table = fresh if held is None else pa.concat_tables([held, fresh])
        names = [table.column(c).to_numpy() for c in ("key", "m", "part", "i", "j")]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for column in names:
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield _compared(table.slice(0, starts[-1]).combine_chunks(), starts[:-1])
    if held is not None:
        yield _compared(held.combine_chunks(), np.zeros(1, np.int64))


def near_words(words, parts=PARTS, tile=TILE):
    """``word, n_near, best_n, best`` of the words with near words."""
    tiled = tiles_of(keys_of(words, parts), tile)
    by = ["key", "m", "part", "i", "j"]
    dealt = tiled.repartition("key", "i", "j").sortWithinPartitions(*by)
    found = dealt.mapInArrow(releasing(_near_words), "word STRING, n_near BIGINT, best_n BIGINT, best STRING")
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.neg")).alias("best_n"), F.col("b.word").alias("best")
    )


def roots_of(forms):
    """``word, root`` of a table of ``word, form``: forms followed to the last."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = small_side(links).select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = links.join(further, links["root"] == further["at"], "left")
        moved = written(moved.select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if moved.where("next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variants(docs, ratio=RATIO, id_col="doc_id", text_col="text", slip=SLIP):
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = written(count_words(docs, id_col, text_col, slip), "words")
    near = words.join(near_words(words), "word", "left").withColumn("fits", F.col("best_n") >= ratio * F.col("n"))
    near = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("fits"), F.col("best")).alias("form"), F.when(F.col("fits"), F.col("best_n")).alias("form_n"),
        ),
        "near",
    )
    roots = small_side(roots_of(near.where("form IS NOT NULL")))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
