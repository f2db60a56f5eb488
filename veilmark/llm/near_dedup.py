"""Near-duplicates: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text becomes its set of five-word shingles (64-bit hashes), a MinHash signature
   and one key per band.  Texts with equal sets are one node from here on.
2. Nodes that share a band key are candidates.  A bucket of two is one pair.  A larger
   bucket is never turned into all of its pairs: one member is its pivot, the one with
   the smallest share of shingles that nobody else has, and every member is compared with
   the pivot exactly.
3. What the pivots leave open is settled by bounds.  Let u be the shingles that only x
   has and m the rest of its symmetric difference to the pivot.  For two members
   |x ^ y| >= u(x) + u(y) + |m(x) - m(y)|, so members too far out can link with nobody,
   and only pairs in different components that the bound allows are compared.
4. Pairs are compared signature batch by signature batch and dropped as soon as the
   posterior probability of the threshold falls below a chosen miss probability; the rest
   is confirmed on the full sets.
5. Components are found by passing minima along links, with shortcuts, as joins.

Links can be lost only by the bands (at most ``MISS`` for a pair at the threshold, less
above it) or the posterior bound (``MISS`` a batch).  Nothing is capped.

Defined results: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text of fewer than five words has its whole sequence as its one
shingle; repeated rows share a class; a row with a null id is compared like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from veilmark.llm.common import fresh, per_text, pick, raw_texts, releasing, small_side, written

SHINGLE = 5
ROWS = 5
MISS = 1e-6
BATCH = 20
MEMO = 100_000


def bands_for(percent, rows=ROWS, miss=MISS):
    """Bands that a pair at the threshold escapes with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)
_HALF = np.uint64(32)


def shingle_set(data, size=SHINGLE):
    """Sorted distinct hashes of the shingles of UTF-8 bytes, A-Z lowered."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=n)], np.uint64)
    out = hashes[: n - size + 1].copy()
    for k in range(1, size):
        out ^= out >> _FOLD
        out *= _MIX
        out += hashes[k : n - size + 1 + k]
    out ^= out >> _HALF
    out *= _MIX
    out ^= out >> _FOLD
    return np.unique(out)


def _factors(count, seed=2024):
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles, factors, block=1024):
    """The smallest 32-bit product with each factor."""
    best = None
    for i in range(0, len(shingles), block):
        low = (shingles[i : i + block, None] * factors[None, :]).min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return (best >> _HALF).astype(np.uint32)


def band_keys(sketch, rows=ROWS):
    """One 64-bit key per band."""
    parts = sketch.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64) * _MIX
    for k in range(rows):
        keys = (keys ^ (keys >> _FOLD)) * _MIX + parts[:, k]
    keys ^= keys >> _HALF
    return (keys * _MIX).view(np.int64)


def sketches(docs, percent, size):
    """Per row: size and hash of its set, signature and band keys."""
    factors = _factors(bands_for(percent) * ROWS)

    def run(batch):
        n, keys, signs, bands = [], [], [], []
        for data in raw_texts(batch):
            shingles = shingle_set(data, size)
            n.append(len(shingles))
            keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            sketch = signature(shingles, factors) if len(shingles) else None
            signs.append(None if sketch is None else sketch.tobytes())
            bands.append(None if sketch is None else band_keys(sketch))
        return [
            pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()),
            pa.array(bands, pa.list_(pa.int64())),
        ]

    return per_text(docs, run, "n BIGINT, set_key BINARY, sketch BINARY, bands ARRAY<BIGINT>")


def sets_of(docs, size):
    """Per row: the hash of its set and the set itself."""

    def run(batch):
        sets = [shingle_set(data, size) for data in raw_texts(batch)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return [pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

    return per_text(docs, run, "set_key BINARY, shingles ARRAY<BIGINT>")


# ---- verification ----------------------------------------------------------
def least_matches(compared, percent, miss=MISS):
    """Fewest matches among ``compared`` with P(similarity >= threshold) >= miss, for a
    uniform prior; that posterior is a binomial tail."""
    t, n, total = percent / 100, compared + 1, 0.0
    for m in range(n):
        total += math.comb(n, m) * t**m * (1 - t) ** (n - m)
        if total >= miss:
            return m
    return compared


def plausible(pairs, percent):
    """Pairs (a, b, sketch_a, sketch_b) that no batch of signatures has ruled out."""
    width = bands_for(percent) * ROWS
    steps = [(k, least_matches(k, percent)) for k in [*range(BATCH, width, BATCH), width]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, width) for c in (2, 3)
            )
            left, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for upto, least in steps:
                matches = matches + (one[left, done:upto] == two[left, done:upto]).sum(axis=1)
                ok = matches >= least
                left, matches, done = left[ok], matches[ok], upto
            yield batch.select([0, 1]).take(pa.array(left))

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(releasing(run), "a BIGINT, b BIGINT")


def with_nodes(pairs, nodes, columns):
    """Put columns of the nodes beside both ends of pairs (a, b)."""
    for end in "ab":
        side = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def intersections(pairs, sets):
    """``a, b, common``: how many shingles the two ends share."""
    both = with_nodes(pairs.select("a", "b"), sets, ["shingles"])
    return both.select("a", "b", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long").alias("common"))


def _linked(percent, common="common", one="n_a", two="n_b"):
    return F.expr(f"100 * {common} >= {percent} * ({one} + {two} - {common})")


def components(links):
    """``node, label`` of every node with a link; the label is the least node reached."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    both = written(both.unionByName(both.select(F.col("near").alias("node"), F.col("node").alias("near"))), "links")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label"))
    labels = written(labels, "labels")
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("seen"))
        best = both.join(seen, "near").groupBy("node").agg(F.min("seen").alias("seen"))
        moved = labels.join(best, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = moved.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        moved = written(moved, "labels")
        if moved.where("label < old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def near_duplicates(docs, percent=80, shingle=SHINGLE, id_col="doc_id", text_col="text"):
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows are linked if 100 * |common| >= percent * |union| of their shingle sets.
    ``component_id`` is the smallest id that links reach; ``kept`` marks that row.
    """
    rows = pick(docs, id_col, text_col)
    sketched = written(sketches(rows, percent, shingle), "sketches")

    # Equal sets are one node.
    nodes = (
        sketched.where("n > 0")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("n").alias("n"),
            F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = written(nodes, "nodes")

    # Buckets of two and more.
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(banded.join(small_side(shared), "bucket"), "members")
    candidates = members.groupBy("node").agg(F.max("size").alias("size"))
    candidates = written(candidates.join(nodes.select("node", "n", "first_id", "set_key"), "node"), "candidates")

    # The sets of candidates, from their texts.
    ids = small_side(candidates.select(F.col("first_id").alias("id")).distinct())
    again = rows.join(ids, rows.doc_id.eqNullSafe(ids.id), "left_semi")
    keys = candidates.select("node", "set_key")
    sets = sets_of(again, shingle).drop("doc_id").join(small_side(keys), "set_key")
    sets = written(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")

    # Shingles that only one candidate has.  A node with too many links with nobody.
    bound = (100 - percent) / (100 + percent)
    own = (
        sets.select("node", F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("holders"), F.min("node").alias("node"))
        .where("holders = 1")
        .groupBy("node")
        .agg(F.count("*").alias("u"))
    )
    known = candidates.select("node", "n").join(own, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    alive = written(known.where(F.col("u") <= F.col("n") * (bound * (1 + 100 / percent)) + 1e-6), "alive")
    members = members.select("bucket", "node").join(alive, "node")
    pivots = members.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min(F.struct(F.col("u") / F.col("n"), "node")).getField("node").alias("pivot")
    )
    pivots = written(pivots.where("size > 1"), "pivots")
    starred = written(
        members.join(small_side(pivots), "bucket").where("node <> pivot"), "starred"
    )  # node, bucket, n, u, size, pivot

    stars = starred.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("size").alias("size"))
    stars = written(with_nodes(stars, alive, ["n"]), "stars")
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    lone = plausible(with_nodes(stars.where("size = 2").where(fits).select("a", "b"), nodes, ["sketch"]), percent)
    todo = lone.unionByName(stars.where("size > 2").select("a", "b"))
    compared = written(intersections(todo, sets).join(stars.select("a", "b", "n_a", "n_b"), ["a", "b"]), "compared")
    links = compared.where(_linked(percent)).select("a", "b")

    # What the pivots of larger buckets did not settle.  Many buckets of a group have one
    # pivot, so members are put together by pivot, each pair once.
    labels = components(links)
    far = (
        compared.join(stars.where("size > 2").select("a", "b"), ["a", "b"])
        .select(F.col("a").alias("node"), F.col("b").alias("pivot"), "common", F.col("n_a").alias("n"), F.col("n_b").alias("n_pivot"))
        .join(alive.select("node", "u"), "node")
        .join(labels, "node", "left")
        .select(
            "pivot", "node", "n", F.coalesce("label", "node").alias("label"),
            (F.col("n") + F.col("n_pivot") - 2 * F.col("common") - F.col("n") * bound).alias("high"),
            (2 * F.col("u") - F.col("n") - F.col("n_pivot") + 2 * F.col("common") - F.col("n") * bound).alias("low"),
        )
    )
    far = _open(_open(written(far, "far"), first=True))
    far = written(far, "open")
    x = far.select("pivot", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "high", "low")])
    y = far.select("pivot", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "high", "low")])
    rest = (
        x.join(y, "pivot")
        .where("node_a < node_b and label_a <> label_b and high_a + low_b <= 1e-6 and high_b + low_a <= 1e-6")
        .where(fits)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    rest = plausible(with_nodes(rest, nodes, ["sketch"]), percent)
    more = with_nodes(intersections(rest, sets), nodes.select("node", "n"), ["n"])
    more = written(more.where(_linked(percent)).select("a", "b"), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    # Classes back to rows.
    joined = nodes.select("node", "set_key", "first_id", "copies").join(labels, "node", "left")
    least = joined.where("label is not null").groupBy("label").agg(F.min("first_id").alias("least"))
    classes = (
        joined.where("copies > 1 or label is not null")
        .join(least, "label", "left")
        .select("set_key", F.coalesce("least", "first_id").alias("component_id"))
    )
    classes = small_side(written(classes, "classes"))
    return (
        sketched.select("doc_id", "n", "set_key")
        .join(classes, "set_key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _open(far, first=False):
    """Groups of a pivot with more than one component, without members that can link with
    nobody."""
    by = far.groupBy("pivot").agg(F.min("low").alias("least"), F.min("label").alias("one"), F.max("label").alias("two"))
    kept = far.join(by.where("one <> two"), "pivot")
    if first:
        kept = kept.where("high + least <= 1e-6")
    return kept.select("pivot", "node", "n", "label", "high", "low")


def keep_first(docs, percent=80, id_col="doc_id", text_col="text"):
    """The documents with all their columns, one row of each class: the one with the smallest
    id, a null id last; of rows with equal ids, copies or not, any one.

    Where an id is missing or not the only one of its kind, rows are numbered and written first,
    so that the decision is on rows; else an id is as good as a number.
    """
    ids = docs.groupBy(F.col(id_col).alias("own")).agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR own IS NULL").isEmpty():
        found = written(near_duplicates(docs, percent, id_col=id_col, text_col=text_col), "classes")
        gone = small_side(written(found.where("not kept").select(F.col("doc_id").alias("gone")), "gone"))
        return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    row = fresh(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, percent, id_col=row, text_col=text_col).select("doc_id", "component_id")
    ids = rows.select(F.col(row).alias("doc_id"), F.col(id_col).alias("own"))
    many = written(found.join(ids, "doc_id"), "classes")
    first = F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).getField("doc_id")
    best = many.groupBy("component_id").agg(F.count("*").alias("n"), first.alias("best")).where("n > 1")
    best = small_side(written(best, "best"))
    gone = many.join(best, "component_id").where("doc_id <> best").select(F.col("doc_id").alias("gone"))
    gone = small_side(written(gone, "gone"))
    return rows.join(gone, rows[row] == gone["gone"], "left_anti").select(*docs.columns)
