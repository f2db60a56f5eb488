"""A bit filter of keys (a Bloom filter), built and read by Spark.

The filter is the result of a query: an array of longs that reaches the tasks as a
constant, so rows are tested where they are.  A key that was put in always passes; of
others about one in a hundred does, more beyond ``MOST_BITS``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 4
#: Largest filter, 8 MB: beyond about 6.7 million keys more rows pass than need to.
MOST_BITS = 1 << 26
_WORD = 64


def filter_bits(keys):
    """Bits of the filter of so many keys: a power of two."""
    return min(MOST_BITS, max(1 << 10, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def _places(column, bits):
    return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _bit(place):
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % _WORD).cast("int"))


def filter_of(keys, column, count):
    """The filter of the values of a column, for about ``count`` of them, as a scalar query."""
    bits = filter_bits(count)
    put = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(column, bits))).alias("place"))
    words = put.groupBy(F.floor(F.col("place") / _WORD).alias("word")).agg(F.bit_or(_bit(F.col("place"))).alias("set"))
    every = keys.sparkSession.range(bits // _WORD).join(words, F.col("id") == F.col("word"), "left")
    gathered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    return every.agg(gathered.alias("words")).select(F.col("words.set"))


def may_hold(filter_table, column, count):
    """Whether a value passes the filter; a null does not."""
    words = filter_table.scalar()

    def is_set(place):
        word = F.get(words, F.floor(place / _WORD).cast("int"))
        return F.call_function("shiftrightunsigned", word, (place % _WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    held = F.col(column).isNotNull()
    for place in _places(column, filter_bits(count)):
        held &= is_set(place)
    return held
