"""Structured Streaming over part files as they arrive: ingestion with resume, running outcomes, complete runs, blind waves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_parts(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of part files below path; the schema is fixed."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def ingest_run_parts(parts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append new parts to a Parquet table and stop; the checkpoint remembers what was taken, so a restart goes on."""
    return parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_aggregates(rows: DataFrame, keys: Sequence[str], gain: str) -> DataFrame:
    """n, mean, positive share per key, for batches and streams alike."""
    g = F.col(gain)
    return rows.groupBy(*keys).agg(F.count(g).alias("n"), F.avg(g).alias("gain_mean"), F.avg((g > 0).cast("double")).alias("positive_fraction"))


def streaming_graph_outcomes(parts: DataFrame, keys: Sequence[str], gain: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet table of outcome aggregates current: each batch replaces it (complete mode)."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(sink)

    q = outcome_aggregates(parts, keys, gain).writeStream.outputMode("complete").foreachBatch(put)
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_runs(parts: DataFrame, run: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Runs of which a part of every kind is there, for batches and streams (complete or update mode) alike. Kinds are bits
    of a mask (63 at most), not counted parts, so late repetitions change nothing.
    """
    if len(kinds) > 63:
        raise ValueError("at most 63 kinds")
    bit = F.lit(None).cast("long")
    for k, name in enumerate(kinds):
        bit = F.when(F.col(kind) == name, F.lit(1 << k).cast("long")).otherwise(bit)
    wanted = parts.withColumn("__bit", bit).filter("__bit is not null").groupBy(run).agg(F.bit_or("__bit").alias("__mask"), F.count("*").alias("n_parts"))
    return wanted.filter(F.col("__mask") == (1 << len(kinds)) - 1).select(run, F.bit_count("__mask").cast("long").alias("n_kinds"), "n_parts")


def windowed_events(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of value by kind in event-time windows; rows later than the watermark are dropped in streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), kind, "n", "total"
    )


def blind_wave_stream(waves: DataFrame, knowledge: DataFrame, truth: DataFrame, metrics: Sequence[str], sink: str, checkpoint: str, id_col: str = "graph_id", seed: int = 0) -> StreamingQuery:
    """Each batch is a wave: predict with what is known, reveal, extend. Revealed rows go to folder sink/revealed and the
    knowledge to sink/knowledge-<epoch>, so that a restarted batch reads what the one before it left.
    """
    from topoeval.operators.blind import blind_predict, blind_reveal

    spark = waves.sparkSession
    knowledge.write.mode("overwrite").parquet(f"{sink}/knowledge--1")

    def wave(df: DataFrame, epoch: int) -> None:
        known = spark.read.parquet(f"{sink}/knowledge-{epoch - 1}")
        if df.isEmpty():
            known.write.mode("overwrite").parquet(f"{sink}/knowledge-{epoch}")
            return
        predictions, _ = blind_predict(known, df, metrics, id_col, seed)
        revealed, more = blind_reveal(predictions, truth.join(df.select(id_col), id_col, "left_semi"), known, id_col)
        revealed.withColumn("wave", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/revealed/part-{epoch}")
        more.write.mode("overwrite").parquet(f"{sink}/knowledge-{epoch}")

    return waves.writeStream.foreachBatch(wave).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(start: Callable[[], StreamingQuery]) -> None:
    """Run a stream until it has taken all there is."""
    q = start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
