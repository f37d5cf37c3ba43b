"""Small helpers shared by the training-data operators.

Conventions used by every operator of this subpackage:

* an operator takes a DataFrame plus the names of its id and text columns and
  returns only the id and its own result columns, so extra input columns, also
  ones named like a result, can never clash;
* a null text counts as an empty text;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that one Arrow slice hands to Python code at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the same thing for texts of ASCII only and several times faster than
    ``translate``, which is left for the others.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    Cuts the lineage and survives lost executors; used where a costly result is read more
    than once.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made. Only for those that no later plan reads, so that a lost executor needs none."""
    for df in tables:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``size`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * size / max(1, batch.column(text_at).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    return [x or "" for x in batch.column(at).to_pylist()]
