"""Where intermediate tables go: a folder every executor can reach."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


@functools.lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="mailsift-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose executor is the driver itself, as in tests, may go without it and
    gets a temporary folder; executors of their own would not see that one, so it is refused.
    """
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    return _local_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the session's part of the shared folder that nothing else uses."""
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mailsift/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete everything this session has landed; its tables cannot be read after that."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def land(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table once and read it back: lineage is cut, and columns can be pruned.

    Worth it in front of operators that read their input several times; a lost executor
    then costs a re-read instead of another parse and clean.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
