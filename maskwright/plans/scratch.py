"""Where intermediate tables go, and how small tables are dealt over all cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL = 64 << 20  #: bytes up to which a table is dealt anew: it may be one row group, which one task would read


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a local one, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="maskwright-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = "file://" + made
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE: list[str] = []  #: what this process has written to the shared folder


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all that this process has written to the shared folder, once no DataFrame that reads it is needed any more; how many folders went."""
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps survive lost executors without recomputing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of at most ``SMALL`` bytes over all cores, larger ones as their files are split.  The size is the plan's estimate; rows are the same either way."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
