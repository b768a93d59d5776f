"""Tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"

_written: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder. Without one, a local session has its own and a cluster's is an error: executors would write where others can't read."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_root(spark)}/lumenrank-{tag}-{uuid.uuid4().hex}"
    for paths in _written[-1:]:
        paths.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, a lost executor costs nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All that is written to fresh paths inside is deleted at the end: what outlives it must be written elsewhere by then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            remove(spark, path)
