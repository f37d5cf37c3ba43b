"""Stratified splits and group folds, by hash order within classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.ranges import ranked, with_count
from topoeval.functions.scalars import stable_uniform


def quota_split(df: DataFrame, parts: dict[str, float], keys: Sequence[str] = ("graph_id",), label: str = "label", id_col: str = "id", seed: int = 0) -> DataFrame:
    """``split`` of every row: within a class, rows in hash order fill the parts; a part but the last gets
    max(1, round(n f)) rows, the last what is left. Disjoint and exhaustive; classes of null label are a class.
    """
    numbered = ranked(df, [*keys, label], [stable_uniform(F.lit(seed), id_col), F.col(id_col)], "__r")
    numbered = with_count(numbered, [*keys, label], "__n")
    names = list(parts)
    out, upto = F.lit(names[-1]), F.lit(0)
    cases = []
    for name in names[:-1]:
        upto = upto + F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(float(parts[name])) + 0.5))
        cases.append((upto, name))
    for bound, name in reversed(cases):
        out = F.when(F.col("__r") <= bound, name).otherwise(out)
    return numbered.withColumn("split", out).drop("__r", "__n")


def stratified_split(df: DataFrame, keys: Sequence[str] = ("graph_id",), label: str = "label", id_col: str = "id", seed: int = 0, least: int = 3) -> DataFrame:
    """60/20/20 within classes; classes of fewer than ``least`` rows are pooled into one stratum."""
    pooled = with_count(df, [*keys, label], "__n").withColumn("__label", F.when(F.col("__n") >= least, F.col(label).cast("string")).otherwise("rare")).drop("__n")
    return quota_split(pooled, {"train": 0.6, "val": 0.2, "test": 0.2}, keys, "__label", id_col, seed).drop("__label")


def nested_split(df: DataFrame, keys: Sequence[str] = ("graph_id",), label: str = "label", id_col: str = "id", seed: int = 0) -> DataFrame:
    """60/10/10/20: train, inner_val, topology_val, test."""
    return quota_split(df, {"train": 0.6, "inner_val": 0.1, "topology_val": 0.1, "test": 0.2}, keys, label, id_col, seed)


def group_folds(df: DataFrame, group: str, folds: int, label: str | None = None) -> DataFrame:
    """group, fold: groups in order of (majority label, size, name) dealt in a snake over the folds."""
    agg = [F.count("*").alias("n")] + ([F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("y")] if label else [F.lit(0).alias("y")])
    groups = df.groupBy(group).agg(*agg)
    r = F.row_number().over(Window.orderBy("y", F.col("n").desc(), group)) - 1  # one row per group
    k = F.pmod(F.col("__r"), F.lit(2 * folds))
    return groups.withColumn("__r", r).select(group, F.when(k < folds, k).otherwise(2 * folds - 1 - k).cast("int").alias("fold"))


def logo_folds(df: DataFrame, group: str) -> DataFrame:
    """Leave one group out: fold 0, 1, ... by name."""
    return df.select(group).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(group)) - 1).cast("int"))
