"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it, and give checkpoints a folder.

    On a cluster ``spark.checkpoint.dir`` names a folder that driver and executors share and is left as
    it is; it is set here only where the session has none (local runs and tests).
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir``, or one under /tmp in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/keelstone-checkpoints-{os.getpid()}"
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/keelstone-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in this application's part of :func:`shared_dir` that no other call gets."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application has stored; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return a reader of it.

    Cuts lineage: a lost executor costs a re-read of the file, never a recomputation of what made it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, share: int) -> int:
    """Tasks for work that grows with a table read from files: one for each ``share`` bytes of them, two for each core at least, as many as shuffles have at most.

    Smaller tasks cost more to start than they do. Sizes come from the files' lengths: no job is run for them.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // share))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
