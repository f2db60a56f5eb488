"""Helpers of the operators: batches, shared tables, checked broadcasts.

Every operator takes a table, the names of its id and text columns and its own
parameters.  It reads those two columns only, so further columns of any name do not
matter.  A null text counts as the empty text, a null id is kept as it is, repeated
rows give repeated results, and an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import uuid
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veilmark.session import shared_folder

#: Rows and bytes of text handled at once inside a task.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def pick(docs, id_col, text_col, extra=()):
    """Id and text alone, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)


def fresh(docs, name):
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def boxed(docs, text_col):
    """The text under the name ``text`` beside all other columns as one struct, so that their
    names can't clash, and the function that puts the columns back."""
    names = docs.columns
    others = [F.col(c) for c in names if c != text_col] or [F.lit(0).alias("none")]

    def back(frame):
        return frame.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in names])

    return docs.select(F.col(text_col).alias("text"), F.struct(*others).alias("rest")), back


def slices(batches):
    """Cut Arrow batches so that long texts do not pile up in a worker."""
    for batch in batches:
        start, size = 0, batch.num_rows
        if not size:
            continue
        lengths = batch.column(batch.schema.get_field_index("text"))
        lengths = [0 if n is None else n for n in pc.binary_length(lengths).to_pylist()]
        while start < size:
            stop, total = start, 0
            while stop < size and stop - start < SLICE_ROWS and (stop == start or total + lengths[stop] <= SLICE_BYTES):
                total += lengths[stop]
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch):
    """The texts of a batch as str, null as the empty text."""
    column = batch.column(batch.schema.get_field_index("text"))
    return ["" if t is None else t for t in column.to_pylist()]


def raw_texts(batch):
    """The texts of a batch as UTF-8 bytes, null as empty bytes."""
    column = batch.column(batch.schema.get_field_index("text"))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def _released():
    """Give freed memory back to the system: Arrow's own, and that of the C library."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run):
    """A function of batches that gives its memory back when its task ends, so that the worker
    is small when it goes on to other work."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _released()

    return whole


class Spans:
    """Spans (start, end), to be asked in logarithmic time what touches or covers a stretch."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.furthest = list(accumulate((b for _, b in spans), max))

    def touch(self, start, end):
        """Whether a span and the stretch have a place in common."""
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.furthest[at] > start

    def cover(self, start, end):
        """Whether the stretch lies inside one span."""
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.furthest[at] >= end


def per_text(docs, per_slice, columns, keep=("doc_id",), reads=()):
    """Append ``columns`` (a DDL string) computed per text to the kept columns.

    ``per_slice`` is a function of a batch that returns one Arrow array for each of the
    new columns; it runs inside Spark's tasks on slices of bounded size.  ``reads`` names further
    columns that it needs.
    """
    added = StructType.fromDDL(columns)
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + added.fields)
    names, kept = [f.name for f in schema], list(keep)

    def run(batches):
        for batch in slices(batches):
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(arrays + list(per_slice(batch)), names=names)

    needed = list(dict.fromkeys([*kept, "text", *reads]))
    return docs.select(*needed).mapInArrow(releasing(run), schema)


def new_folder(spark, name):
    """A fresh place in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame, name):
    """Write a table to the shared folder and read it again: lineage ends there, and a
    lost executor costs nothing that was written."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table_bytes(frame):
    """Spark's own estimate of a table's size; for a written table, that of its files."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def small_side(frame, limit=16 << 20):
    """A written table with the broadcast hint if its files are within ``limit`` bytes;
    beyond it Spark joins by shuffle."""
    return F.broadcast(frame) if table_bytes(frame) <= limit else frame
