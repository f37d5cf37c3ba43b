"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to a table in the shared folder, which survives lost executors.

    A written table, not a checkpoint: a checkpoint keeps its plan's size estimate, which every join multiplies, so
    that over the rounds of an iteration the estimates grow until planning takes longer than the work, and no small
    side is seen as one. The size of a table is that of its files.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "cut", uuid.uuid4().hex)
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
