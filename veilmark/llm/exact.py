"""Exact duplicates through an extendible-hash index on shared files.

1. Each text, with runs of white space as one space, gets a 64-bit key.  Keys are counted,
   map-side first, so a text that a third of all rows hold is one entry.
2. The directory starts with one bucket.  While a bucket holds more than ``capacity`` keys
   the directory doubles: each slot becomes two, a full bucket becomes two buckets told
   apart by one more leading bit, all others are only pointed to twice.
3. A bucket is a range of keys.  Owners are runs of neighbouring slots; each owner's task
   sorts its key range and writes it to the shared folder: the index.
4. Keys that several rows hold are chains.  Their texts are compared byte by byte inside
   the buckets; equal texts meet map-side first, so copies of one text reach the owner
   once a task.  Texts that share a key without being equal stay apart in their chain.
5. Rows look up their chain by key; the rows of a chain with several texts by key and text.

Everything is a DataFrame expression.  What is broadcast is a written table whose files
are within a limit; beyond it Spark shuffles, with chains of very many rows split off.

Defined results: a null text counts as empty; repeated rows, with the same id too, are
copies of each other and all rows with the smallest id stay; a null id is larger than
any other, and in a group without ids all rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import pick, small_side, table_bytes, written

#: Keys that a bucket holds before it is split.
CAPACITY = 2048
#: Bits of a key; fewer make collisions, for tests.
KEY_BITS = 64
#: Leading bits of the histogram that the first doublings are decided on.
CELL_BITS = 20
#: Rows from which a chain is looked up apart from the others, where tables are large.
HOT = 10_000
#: Size up to which a table of keys or chains is broadcast.
BROADCAST = 16 << 20

# Single spaces are left as they are: replacing them would change nothing.
_BLANKS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text):
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " ")


def key_of(text, bits=KEY_BITS):
    """The leading ``bits`` of a 64-bit hash."""
    key = F.xxhash64(text)
    return key if bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def slot_of(key, depth):
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class Index:
    """``directory``: slot, bucket, depth, n, one row a slot; ``entries``: owner, bucket,
    key, n, first, sorted by key within an owner's files; ``depth``: bits of a slot."""

    directory: DataFrame
    entries: DataFrame
    depth: int

    def bucketed(self, frame):
        """Put the bucket beside rows that have a key."""
        slots = small_side(self.directory.select("slot", "bucket"), BROADCAST)
        return frame.withColumn("slot", slot_of(F.col("key"), self.depth)).join(slots, "slot").drop("slot")


def directory_of(keys, capacity=CAPACITY, bits=KEY_BITS):
    """The directory of a table of distinct keys, and the bits of its slots.

    A bucket is named by its first slot.  Buckets that hold one key value alone, and so
    have used up all ``bits``, are not split any further.
    """
    cells = keys.groupBy(slot_of(F.col("key"), CELL_BITS).alias("cell")).agg(F.count("*").alias("n"))
    cells = written(cells, "cells")
    slots = cells.agg(
        F.lit(0).cast("long").alias("slot"), F.lit(0).alias("depth"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    slots, depth = written(slots, "directory"), 0
    while depth < min(bits, 62) and not slots.where(F.col("n") > capacity).isEmpty():
        depth += 1
        if depth <= CELL_BITS:
            found = cells.select(F.shiftrightunsigned("cell", CELL_BITS - depth).alias("half"), "n")
        else:
            found = keys.select(slot_of(F.col("key"), depth).alias("half"), F.lit(1).alias("n"))
            full = slots.where(F.col("n") > capacity).select(F.col("slot").alias("of"))
            found = found.join(full, F.shiftright("half", 1) == F.col("of"), "left_semi")
        found = found.groupBy("half").agg(F.sum("n").alias("held"))
        full = F.col("n") > capacity
        halves = slots.select(
            F.explode(F.array(2 * F.col("slot"), 2 * F.col("slot") + 1)).alias("slot"),
            F.when(full, F.lit(depth)).otherwise(F.col("depth")).alias("depth"),
            F.when(~full, F.col("n")).alias("n"),
        )
        halves = halves.join(found, halves["slot"] == found["half"], "left")
        slots = halves.select("slot", "depth", F.coalesce("n", "held", F.lit(0).cast("long")).alias("n"))
        slots = written(slots, "directory")
    unused = F.lit(depth) - F.col("depth")
    bucket = F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)")
    return slots.select("slot", bucket.alias("bucket"), (F.lit(depth) - unused).alias("depth"), "n"), depth


def build_index(records, capacity=CAPACITY, bits=KEY_BITS):
    """The index of a table of ``doc_id, key``, written by its owner tasks."""
    keys = records.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    keys = written(keys, "keys")
    directory, depth = directory_of(keys, capacity, bits)
    directory = written(directory, "directory")
    owners = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = min(owners, 1 << depth) if depth < 31 else owners
    owner = F.floor(F.col("slot").cast("double") * owners / float(1 << depth)).cast("int")
    slots = small_side(directory.select("slot", "bucket", owner.alias("owner")), BROADCAST)
    entries = keys.withColumn("slot", slot_of(F.col("key"), depth)).join(slots, "slot").drop("slot")
    entries = entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key")
    return Index(directory, written(entries.select("owner", "bucket", "key", "n", "first"), "index"), depth)


def _chains(keyed, index):
    """Chains of the keys that several rows hold: ``bucket, key, texts, n, first``."""
    shared = written(index.entries.where("n > 1").select("key", "bucket"), "shared")
    if table_bytes(shared) <= BROADCAST:
        held = keyed.join(F.broadcast(shared), "key")
    else:  # without the filter: one shuffle of distinct texts rather than of all rows
        held = index.bucketed(keyed)
    texts = held.groupBy("bucket", "key", "norm").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    chains = texts.groupBy("bucket", "key").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first")
    )
    return written(chains.where("n > 1"), "chains")


def _looked_up(records, chains):
    """Put the chain beside each row, by key alone."""
    if table_bytes(chains) <= BROADCAST:
        return records.join(F.broadcast(chains), "key", "left")
    hot = small_side(written(chains.where(F.col("n") >= HOT), "hot"), BROADCAST)
    rest = chains.where(F.col("n") < HOT)
    other = records.join(hot.select("key"), "key", "left_anti").join(rest, "key", "left")
    return records.join(hot, "key").unionByName(other)


def exact_duplicates(docs, capacity=CAPACITY, bits=KEY_BITS, id_col="doc_id", text_col="text"):
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Rows are equal if their normalised texts are, byte for byte; the one with the smallest
    id stays.  ``text_sha256`` is that of the normalised text.
    """
    rows = pick(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = rows.select("doc_id", "norm", key_of("norm", bits).alias("key"))
    records = written(keyed.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "records")
    index = build_index(records, capacity, bits)
    chains = _chains(keyed, index)

    one = written(chains.where("texts = 1").select("key", "n", "first"), "chains")
    mixed = written(chains.where("texts > 1").select("key"), "collisions")
    if mixed.isEmpty():
        found = _looked_up(records, one)
    else:
        again = keyed.join(small_side(mixed, BROADCAST), "key", "left_semi")
        texts = again.groupBy("key", "norm").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        told = again.join(texts, ["key", "norm"])
        told = told.select("key", "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), "n", "first")
        others = records.join(small_side(mixed, BROADCAST), "key", "left_anti")
        found = _looked_up(others, one).unionByName(told)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
