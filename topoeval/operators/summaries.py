"""Filters, joins with contracts, aggregations, windows and set operations on experiment tables.

Long tables hold one row per execution: dataset, backbone, seed, candidate or ratio (NULL: original) and metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoeval.functions.joins import shuffled
from topoeval.functions.lineage import cut
from topoeval.functions.ranges import running_sum
from topoeval.functions.scalars import fixed_bin, quantile_bin


# --- rows and columns ---------------------------------------------------------------------


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in columns]
    for g in good:
        df = df.filter(g)
    return df


def usable_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least max(4, n/2) values; one aggregate over all of them."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] >= max(4, row["n"] / 2)]


def assert_no_leakage(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    if bad := sorted(set(columns) & set(forbidden)):
        raise ValueError(f"columns that would leak the outcome: {bad}")


def prefix_columns(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def numeric_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]


def shard_filter(df: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(key), F.lit(shards)) == shard)


def with_label(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


# --- joins --------------------------------------------------------------------------------


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", contract: str = "one_to_one") -> DataFrame:
    """A join that stops when a side on which keys must be unique has one twice."""
    sides = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False), "many_to_many": (False, False)}[contract]

    def unique(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*on)
        ok = F.when(F.count("*").over(w) == 1, True).otherwise(F.raise_error(F.lit("a key is not unique")).cast("boolean"))
        return df.withColumn("__ok", ok).filter("__ok").drop("__ok")

    return (unique(left) if sides[0] else left).join(unique(right) if sides[1] else right, list(on), how)


def with_baseline_gain(runs: DataFrame, keys: Sequence[str], is_baseline: Column, metric: str, gain: str = "gain", base: str = "baseline") -> DataFrame:
    """Every row with its key's baseline metric and the difference, in one pass without a join."""
    w = Window.partitionBy(*keys)
    return runs.withColumn(base, F.max(F.when(is_baseline, F.col(metric))).over(w)).withColumn(gain, F.col(metric) - F.col(base))


def metric_deltas(df: DataFrame, keys: Sequence[str], is_original: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that are not original with delta_m = m - original m for every numeric column."""
    columns = list(columns) if columns else numeric_columns(df, keys)
    first = df.filter(is_original).select(*keys, *[F.col(c).alias(f"original_{c}") for c in columns])
    out = df.filter(~is_original).join(first, list(keys))
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"original_{c}") for c in columns})


def compare_correlations(old: DataFrame, new: DataFrame, keys: Sequence[str], r: str = "r", p: str = "p") -> DataFrame:
    """Full join of two correlation tables: is the direction the same, are both significant (NULL: false)?"""
    a = old.select(*keys, F.col(r).alias("r_old"), F.col(p).alias("p_old"))
    b = new.select(*keys, F.col(r).alias("r_new"), F.col(p).alias("p_new"))
    false = F.lit(False)
    return a.join(b, list(keys), "full").withColumns(
        {
            "same_direction": F.coalesce(F.signum("r_old") == F.signum("r_new"), false),
            "both_significant": F.coalesce((F.col("p_old") < 0.05) & (F.col("p_new") < 0.05), false),
        }
    )


def assert_disjoint_keys(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, after a check that none of its keys is known."""
    if not df.join(known.select(*keys).distinct(), list(keys), "left_semi").isEmpty():
        raise ValueError("some keys are known already")
    return df


def remaining_work(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def design_grid(base: DataFrame | SparkSession, factors: dict[str, Sequence], keep: Column | None = None) -> DataFrame:
    """All combinations of the factors' levels with each distinct row of base (whose columns are factors too; a session has
    none), with their parameters as JSON and config_id; ``keep`` drops branches.
    """
    from topoeval.functions.scalars import config_id

    out = base.distinct() if isinstance(base, DataFrame) else base.range(1).select()
    names = sorted([*out.columns, *factors])
    for name, levels in factors.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in levels])))
    if keep is not None:
        out = out.filter(keep)
    text = F.to_json(F.struct(*names))
    return out.withColumn("parameters", text).withColumn("config_id", config_id(F.lit("grid"), text)).dropDuplicates(["config_id"])


def design_summary(grid: DataFrame, graphs_per_config: int, tasks: int, seeds: int, fits_per_run: int) -> DataFrame:
    n = F.count_distinct("config_id")
    graphs = n * graphs_per_config
    runs = graphs * tasks * seeds
    return grid.agg(n.alias("configurations"), graphs.alias("graphs"), (graphs * tasks).alias("tasks"), runs.alias("runs"), (runs * fits_per_run).alias("fits"))


# --- aggregations -------------------------------------------------------------------------


def dataset_level_gain(selected: DataFrame) -> DataFrame:
    """selected(dataset, backbone, baseline, test, ratio): means per (dataset, backbone), then per dataset, with the best and
    worst backbone's gain and the most frequent ratio (ties: the least).
    """
    by_backbone = selected.groupBy("dataset", "backbone").agg(F.avg("baseline").alias("baseline"), F.avg("test").alias("test"), F.avg(F.col("test") - F.col("baseline")).alias("gain"))
    ratio = selected.groupBy("dataset", "ratio").agg(F.count("*").alias("n")).groupBy("dataset").agg(F.max_by("ratio", F.struct("n", -F.col("ratio"))).alias("mode_ratio"))
    out = by_backbone.groupBy("dataset").agg(
        F.avg("baseline").alias("baseline"), F.avg("test").alias("test"), F.avg("gain").alias("gain"),
        F.max("gain").alias("best_backbone_gain"), F.min("gain").alias("worst_backbone_gain"),
    )
    return out.join(ratio, "dataset")


def graph_outcomes(runs: DataFrame, keys: Sequence[str], gain: str = "gain") -> DataFrame:
    g = F.col(gain)
    return runs.groupBy(*keys).agg(
        F.avg(g).alias("gain_mean"), F.stddev_samp(g).alias("gain_std"), F.count(g).alias("n"), F.avg((g > 0).cast("double")).alias("positive_fraction")
    )


def multi_agg(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """c_mean, c_std, c_count for every column."""
    parts = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count"))]
    return df.groupBy(*keys).agg(*parts)


def regime_outcomes(runs: DataFrame, regime: str = "feature_regime", gain: str = "gain") -> DataFrame:
    return graph_outcomes(runs, [regime], gain)


def constructor_summary(runs: DataFrame, keys: Sequence[str] = ("constructor", "ratio"), gain: str = "gain", timings: Sequence[str] = ()) -> DataFrame:
    """NULL ratios are a group of their own."""
    g = F.col(gain)
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(g).alias("gain_mean"), F.expr(f"percentile({gain}, 0.5)").alias("gain_median"),
        F.avg((g > 0).cast("double")).alias("positive_fraction"), *[F.avg(t).alias(f"{t}_mean") for t in timings],
    )


def family_summary(runs: DataFrame, family: str, unit: str, gain: str = "gain") -> DataFrame:
    """Per family: units, rows, share of all rows, mean gain."""
    out = runs.groupBy(family).agg(F.count_distinct(unit).alias("n_units"), F.count("*").alias("n"), F.avg(gain).alias("gain_mean"))
    total = out.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def ratio_share(runs: DataFrame, ratio: str = "ratio") -> DataFrame:
    return family_summary(runs.withColumn("__g", F.lit(0.0)), ratio, ratio, "__g").select(ratio, "n", "share")


def method_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def metric_summary(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Mean, population deviation, 1.96 sigma / sqrt(n); zeros where there is no value."""
    n, s = F.count(metric), F.coalesce(F.stddev_pop(metric), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(metric), F.lit(0.0)).alias("mean"), s.alias("std"), F.when(n > 0, 1.96 * s / F.sqrt(n)).otherwise(0.0).alias("ci95"), n.alias("n")
    )


def candidate_summary(runs: DataFrame, metric: str, **tags: str) -> DataFrame:
    """Every candidate without selection, with literal tags."""
    return metric_summary(runs.withColumns({k: F.lit(v) for k, v in tags.items()}), [*tags, "backbone", "candidate"], metric)


def stratified_summary(df: DataFrame, dimensions: Sequence[str], value: str) -> DataFrame:
    """One table over many dimensions: dimension, level, n, mean, median, positive share."""
    long = df.select(F.col(value).alias("__v"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions])).alias("s"))
    return long.groupBy("s.dimension", "s.level").agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.expr("percentile(__v, 0.5)").alias("median"), F.avg((F.col("__v") > 0).cast("double")).alias("positive_fraction")
    )


def factor_combinations(df: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*factors).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive_fraction"))


def choice_frequency(df: DataFrame, regime: str, choice: str) -> DataFrame:
    n = df.groupBy(regime, choice).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(regime)))


def effect_summary(df: DataFrame, keys: Sequence[str], gain_pp: str) -> DataFrame:
    g = F.col(gain_pp)
    q = lambda p: F.expr(f"percentile({gain_pp}, {p})")
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*keys).agg(
        F.count(g).alias("n"), F.avg(g).alias("mean"), q(0.5).alias("median"), q(0.025).alias("q025"), q(0.975).alias("q975"),
        share(g > 0).alias("positive"), share(g > 0.5).alias("above_05"), share(g > 1.0).alias("above_10"),
    )


def binned_pivot(df: DataFrame, x: str, y: str, value: str, bins: int = 8) -> DataFrame:
    """Mean of value by quantile bins of x (rows) and y (columns b0, b1, ...)."""
    binned = quantile_bin(quantile_bin(df, x, bins, name="x_bin"), y, bins, name="y_bin")
    names = binned.withColumn("y_bin", F.concat(F.lit("b"), F.col("y_bin")))
    return names.groupBy("x_bin").pivot("y_bin", [f"b{k}" for k in range(bins)]).agg(F.avg(value))


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return quantile_bin(df, p, bins).groupBy("bin").agg(F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed_rate"), F.count("*").alias("n"))


def domain_overlap(known: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, low, high of the known table and how many rows of the other lie inside."""
    rows = known.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns])
    spans = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high")) for c in columns])).alias("s")).select("s.*")
    long = other.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return long.join(F.broadcast(spans), "metric").groupBy("metric", "low", "high").agg(
        F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("inside"), F.count("*").alias("n")
    )


def integrity_report(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, repeated rows of a key, nulls of each column."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])
    return by_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_repeated"), *[F.sum(f"{c}_nulls").alias(f"{c}_nulls") for c in columns])


# --- windows and order --------------------------------------------------------------------


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order that ends in a tie-break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1).drop("__rank")


def avg_rank(df: DataFrame, x: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average ranks: values are counted first, and only distinct values are ordered, by ranges within a key.

    Rows are written first: ranks find their rows by value, and a sum that is computed twice may differ in its last digits.
    """
    df = cut(df)
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("__n"))
    upto = running_sum(counts, keys, [x], __c="__n")
    ranks = upto.withColumn(name, F.col("__c") - F.col("__n") + (F.col("__n") + 1) / 2).drop("__n", "__c")
    return df.join(shuffled(ranks), [*keys, x])


def holm_adjust(df: DataFrame, p: str = "p", keys: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Running maximum of (m - rank + 1) p in order of p, at most 1. For tables of tests, one row each."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(p)
    step = F.col(p) * (F.count(p).over(w) - F.row_number().over(order) + 1)
    return df.withColumn("__s", step).withColumn(name, F.least(F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__s")


def leaderboard(df: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def ratio_bin(df: DataFrame, x: str, edges: Sequence[float], name: str = "bin") -> DataFrame:
    return df.withColumn(name, fixed_bin(x, edges))


def prefix_sum(df: DataFrame, order: str, value: str, name: str = "prefix", keys: Sequence[str] = ()) -> DataFrame:
    """Running sum of value in the order of a column, within the keys: partitions are ranges, and only their totals meet."""
    return running_sum(df, keys, [order], **{name: value})


# --- sets ---------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_knowledge(known: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union that keeps the first row of a key, the known one before the new."""
    both = known.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__s")]
    return best_per_key(both, keys, "__s", F.xxhash64(*rest) if rest else "__s").drop("__s")
