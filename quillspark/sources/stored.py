"""Tables that a job keeps between its steps, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[list[str]] = []


#: A table of fewer splits than this, and than the cores, is small: splits beyond the cores have 4 MB each (spark.sql.files.openCostInBytes), so it has 128 MB at most.
SMALL_SPLITS = 32


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of Parquet files. A small one is often one row group and so one task, however it is split; the columns taken from it are
    dealt over the cores, at most 128 MB. Larger ones stay as they lie."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS) else df


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, whose tasks share one disk, may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: later steps read the columns they need, and survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end: what is to outlive it has to be written to a path of its own."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)
