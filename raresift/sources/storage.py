"""Shared folder for intermediate tables that must outlive executors."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="raresift-")


def work_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside are deleted at the end; what is read later must have been written elsewhere."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield
    finally:
        _OPEN.remove(written)
        for path in written:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write the table to the shared folder and read it back: short lineage, column pruning."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
