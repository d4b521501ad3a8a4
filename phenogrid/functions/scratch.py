"""The shared folder of a session, and cuts of growing plans that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir. Where it is unset on one machine (tests) a folder of our own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phenogrid-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: later plans read it, whatever becomes of the executors."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: a small table whose size is then known, so that a join with it need not shuffle the other side first."""
    path = f"{scratch_dir(df.sparkSession)}/phenogrid-kept-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
