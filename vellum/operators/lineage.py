"""Cutting a plan's lineage in the folder that the session shares with its executors."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that the session names.

    Where none is named (tests, a single machine), one beside the warehouse is used, with a warning: on a
    cluster it must be a folder that all executors and the driver share.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
        warnings.warn(f"spark.checkpoint.dir isn't set; using {named}, which all executors must share", stacklevel=2)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: written once, so whatever is computed from it sees the same rows in the same partitions."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where its input has fewer pieces than there are cores: for a small table whose rows cost more to compute than to move. A large input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
