"""Reading tables, and where jobs keep theirs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SMALL_SHARE = 8 << 20


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table. One that is too small for its splits to fill the cores (by the size that the plan estimates) is
    dealt out to all of them; larger ones are read as they are, without a shuffle."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < SMALL_SHARE * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, as in tests, may leave it unset and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or os.path.join(tempfile.gettempdir(), "checkpoints")
