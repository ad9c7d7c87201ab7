"""Small helpers shared by the operators: tables of a folder, temporary tables, session-wide settings."""

from __future__ import annotations

import contextlib

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raresift.sources.storage import materialize  # noqa: F401  (shared folder of spark.checkpoint.dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Tables written inside reach Python in batches of at most ``rows`` rows: for rows of many KB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most ``BATCH_BYTES``, or less where the user asks for less: ten thousand whole texts
    are many times that, and a batch is held by the JVM and by Python, on the way in and out. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


PACKAGE = __name__.partition(".")[0]


def _plain(value):
    """``value`` without the package's classes: their objects are given by name and attributes."""
    if type(value).__module__.partition(".")[0] == PACKAGE:
        return {"class of the package": type(value).__name__, "attributes": {k: _plain(v) for k, v in vars(value).items()}}
    return type(value)(_plain(v) for v in value) if type(value) in (list, tuple) else value


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast of an object of this package's classes as plain data: executors need no installed copy, and the tasks of a
    worker share one copy of its arrays. Read it by ``shared_value``."""
    return spark.sparkContext.broadcast(_plain(value))


def shared_value(shared: Broadcast, *classes: type):
    """The object again; ``classes`` are those it holds, which travel with the task."""
    known = {c.__name__: c for c in classes}

    def made(value):
        if type(value) is dict and "class of the package" in value:
            cls = known[value["class of the package"]]
            out = cls.__new__(cls)
            out.__dict__.update({k: made(v) for k, v in value["attributes"].items()})
            return out
        return type(value)(made(v) for v in value) if type(value) in (list, tuple) else value

    return made(shared.value)


def spread(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
