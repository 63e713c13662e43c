"""Intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine a temporary one where it names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return named or sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df, stored partition by partition: later jobs read the same rows in the same partitions, whatever machines are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
