"""Session settings, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master=None, **settings):
    """A session with the settings the scan relies on; ``settings`` override."""
    builder = SparkSession.builder.appName("veilmark")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without; it gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="veilmark-")


def stored(frame, name):
    """A table written to the shared folder and read again: it is computed once, and its
    size is known."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def estimated_bytes(frame):
    """Spark's estimate of a table's size; of a stored one, that of its files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(frame):
    """Whether Spark would broadcast a table of this size by itself."""
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(frame) <= limit
