"""Session helpers: where intermediate tables go, and how they are written.

Lineage is cut by writing a parquet table to the folder all executors share
(`spark.checkpoint.dir`), so a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. A machine-local one is made only for a
    single-JVM master, where nothing was configured (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    where = spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="seqloom-")
    spark.sparkContext.setCheckpointDir(where)
    atexit.register(shutil.rmtree, where, True)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/seqloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes one path of `scratch`, which nothing may read any more."""
    _written[:] = [x for x in _written if x[1] != path]
    _delete(spark, path)


def sweep(spark: SparkSession) -> None:
    """Has the driver find out which shuffles are over, so that their files are
    deleted now and not when it happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release() -> int:
    """Deletes the intermediate tables of this process; results that still
    read them must have been written before. Returns how many."""
    n = 0
    while _written:
        _delete(*_written.pop())
        n += 1
    return n


@atexit.register
def _drop_local() -> None:
    for _, path in _written:
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
