"""The scan as a stream: stateless, so no watermark and no state store.

The running summary of a stream is kept as one small table per batch (see
``operators.summaries``).  It has no time limit, so a late document counts like any other, and a
batch that is run again after a restart replaces what it wrote before.
"""

from __future__ import annotations

from veilmark import schemas
from veilmark.operators.findings import detect
from veilmark.operators.summaries import write_partial


def read_stream(spark, folder, glob="*.parquet", files_per_batch=1000):
    """Documents from parquet files arriving in a folder."""
    return (
        spark.readStream.schema(schemas.DOCS)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def scan_stream(stream, out, checkpoint, recognizers=None, transform=lambda df: df):
    """Write the findings of every new document; ends when the input is used up.

    The overlap scan works on the row's own array, so a document is done as soon
    as it is read.  File sink and checkpoint give every finding exactly once, also
    after a lost executor or a restart.
    """
    query = (
        detect(transform(stream), recognizers)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def summary_stream(stream, folder, checkpoint, recognizers=None, name="stream"):
    """Write a partial summary of every batch of new documents to ``folder``; ends when the
    input is used up.  ``name`` tells streams apart that share a folder."""

    def one(batch, number):
        write_partial(detect(batch, recognizers), folder, f"{name}-{number:09d}")

    query = (
        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
