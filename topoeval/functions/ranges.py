"""Ranks, running sums and quantiles of keys whose rows don't fit one task.

Rows are dealt by range of (keys, order) and written; each range of a key is ordered by itself, and only the ranges'
totals, a row for each key and range, are added up in order. Ties never straddle two ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut

Name = str | Column


def _with_offsets(df: DataFrame, keys: Sequence[str], order: Sequence[Name], columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with each name of ``columns``: the first expression totalled over the key's earlier ranges, and the second one over
    the own range in order, added.
    """
    parts = cut(df.repartitionByRange(*keys, *order).withColumn("__range_part", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "__range_part").agg(*[total.alias(f"__range_t{i}") for i, (total, _) in enumerate(columns.values())])
    before = Window.partitionBy(*keys).orderBy("__range_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"__range_t{i}").over(before), F.lit(0)).alias(f"__range_b{i}") for i in range(len(columns))]
    offsets = sums.select(*[F.col(k).alias(f"__range_k{i}") for i, k in enumerate(keys)], F.col("__range_part").alias("__range_other"), *earlier)
    same = F.col("__range_part") == F.col("__range_other")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__range_k{i}"))
    own = Window.partitionBy(*keys, "__range_part").orderBy(*order)
    out = parts.withColumns({f"__range_i{i}": inside.over(own) for i, (_, inside) in enumerate(columns.values())}).join(offsets, same)
    out = out.withColumns({name: F.col(f"__range_b{i}") + F.col(f"__range_i{i}") for i, name in enumerate(columns)})
    return out.drop("__range_part", "__range_other", *[f"__range_k{i}" for i in range(len(keys))], *[f"__range_{x}{i}" for x in "bi" for i in range(len(columns))])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Name], name: str = "rank") -> DataFrame:
    """df with its rows' numbers 1, 2, ... within the keys; the order should be unique there. Null keys are a key."""
    return _with_offsets(df, keys, order, {name: (F.count("*"), F.row_number())})


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Name], **values: str) -> DataFrame:
    """df with name = sum of a column over the key's rows up to this one (rows that tie in the order count together)."""
    return _with_offsets(df, keys, order, {name: (F.sum(value), F.sum(value)) for name, value in values.items()})


#: Numbers that one row is exploded to at a time.
CHUNK = 1 << 14


def numbers(df: DataFrame, n: Column, name: str) -> DataFrame:
    """df with each row once for every number 1, 2, ... n: chunks of numbers are dealt over the tasks before they are exploded."""
    chunks = df.withColumn("__n", n.cast("long")).filter("__n > 0")
    chunks = chunks.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))))
    chunks = chunks.repartition(*df.columns, "__c")
    first = F.col("__c") * CHUNK + 1
    return chunks.withColumn(name, F.explode(F.sequence(first, F.least(F.col("__n"), first + CHUNK - 1)))).drop("__n", "__c")


def with_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with the number of rows of its keys, counted before it is joined; null keys are a key."""
    names = [f"__k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias(name))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    return df.join(sizes, same).drop(*names)


def quantiles(df: DataFrame, x: str, probabilities: Sequence[float], keys: Sequence[str] = (), name: str = "cuts") -> DataFrame:
    """keys, name: exact quantiles (array, in the order of the probabilities) of x within the keys by lookup of ranks, between
    two values in proportion. NULLs don't count; a key without a value has no row.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    upto = running_sum(counts, keys, ["__x"], __c="__n")
    sizes = counts.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("__n").alias("__size"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = (upto.join(sizes, same) if keys else upto.crossJoin(F.broadcast(sizes))).drop(*[f"__k{i}" for i in range(len(keys))])
    places = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__size") - 1)
        lower = F.floor(at)
        for side, place, weight in ((0, lower, lower + 1 - at), (1, F.ceil(at), at - lower)):
            places.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), place.alias("place"), weight.alias("weight")))
    mine = F.filter(F.array(*places), lambda s: (s["place"] < F.col("__c")) & (s["place"] >= F.col("__c") - F.col("__n")))
    held = both.select(*keys, "__x", F.explode(mine).alias("s"))
    # between two equal values that value to the last bit, which a weighted sum may miss
    low, high = (F.max(F.when(F.col("s.side") == side, F.col("__x"))) for side in (0, 1))
    value = F.when(low == high, low).otherwise(low + (high - low) * F.max(F.when(F.col("s.side") == 1, F.col("s.weight"))))
    each = held.groupBy(*keys, "s.i").agg(value.alias("q"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias(name)).filter(F.size(name) > 0)
