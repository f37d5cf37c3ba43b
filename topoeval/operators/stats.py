"""Paired tests, correlations and sensitivity tables. p-values come from Arrow functions on one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.functions.scalars import safe_corr
from topoeval.functions.tails import norm_sf, t_sf, wilcoxon_exact_p
from topoeval.operators.summaries import avg_rank, holm_adjust


def wilcoxon_stat(df: DataFrame, keys: Sequence[str], d: str, zeros: str = "wilcox", digits: int = 10) -> DataFrame:
    """Per key: n (non-zero differences), w_plus, w_minus and the tie and zero sums. zeros: "wilcox" drops them before ranking,
    "pratt" ranks them and drops their ranks. Differences are rounded first, so that ties are ties.
    """
    x = df.select(*keys, F.round(F.col(d), digits).alias("__d")).filter("__d is not null").withColumn("__a", F.abs("__d"))
    if zeros == "wilcox":
        ranked = avg_rank(x.filter("__d != 0"), "__a", keys)
    elif zeros == "pratt":
        ranked = avg_rank(x, "__a", keys)
    else:
        raise ValueError("zeros is wilcox or pratt")
    ties = ranked.filter("__d != 0").groupBy(*keys, "__a").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.expr("t * t * t - t")).alias("ties"))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0))
    out = ranked.groupBy(*keys).agg(
        F.count_if(F.col("__d") != 0).alias("n"), F.count_if(F.col("__d") == 0).alias("n_zero"), s(F.col("__d") > 0).alias("w_plus"), s(F.col("__d") < 0).alias("w_minus")
    )
    everyone = df.select(*keys).distinct()
    out = out.join(ties, list(keys), "left") if keys else out.crossJoin(ties)
    out = everyone.join(out, list(keys), "left") if keys else out
    return out.na.fill(0, ["n", "n_zero", "w_plus", "w_minus", "ties"])


def wilcoxon_signed_rank(df: DataFrame, keys: Sequence[str], d: str, zeros: str = "wilcox") -> DataFrame:
    """Per key: n, statistic min(W+, W-), p. Exact for at most 50 differences without ties and zeros, else the tie-corrected
    normal approximation; no difference at all gives (0, 1).
    """
    w = wilcoxon_stat(df, keys, d, zeros)
    n, z = F.col("n"), F.col("n_zero")
    full = n + z if zeros == "pratt" else n
    mean = full * (full + 1) / 4 - (z * (z + 1) / 4 if zeros == "pratt" else 0)
    var = full * (full + 1) * (2 * full + 1) / 24 - (z * (z + 1) * (2 * z + 1) / 24 if zeros == "pratt" else 0) - F.col("ties") / 48
    stat = F.least("w_plus", "w_minus")
    score = F.when(var > 0, (stat - mean) / F.sqrt(var))
    exact = (n <= 50) & (F.col("ties") == 0) & ((z == 0) | F.lit(zeros == "wilcox"))
    p = F.when(n == 0, 1.0).when(exact, wilcoxon_exact_p(n.cast("double"), stat.cast("double"))).otherwise(norm_sf(score))
    return w.select(*keys, "n", stat.alias("statistic"), p.alias("p"))


def paired_moments(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Per key: n, means, mean difference b - a, its sample deviation, normal CI95, t and Cohen's dz."""
    d = F.col(b) - F.col(a)
    m = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff")
    )
    half = 1.96 * F.col("std_diff") / F.sqrt("n")
    return m.withColumns(
        {
            "ci_low": F.col("mean_diff") - half, "ci_high": F.col("mean_diff") + half,
            "t": F.when(F.col("std_diff") > 0, F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n"))), "dz": F.when(F.col("std_diff") > 0, F.col("mean_diff") / F.col("std_diff")),
        }
    )


def paired_tests(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """paired_moments with p_t and the signed-rank statistic and p of b - a."""
    m = paired_moments(df, keys, a, b).withColumn("p_t", t_sf(F.col("t"), (F.col("n") - 1).cast("double")))
    w = wilcoxon_signed_rank(df.withColumn("__diff", F.col(b) - F.col(a)), keys, "__diff")
    return m.join(w.select(*keys, F.col("statistic").alias("w"), F.col("p").alias("p_w")), list(keys))


def safe_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key: n, pearson, p_pearson, spearman, p_spearman over finite pairs; NULL under three pairs or two distinct values."""
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ranked = avg_rank(avg_rank(rows, "x", keys, "rx"), "y", keys, "ry")
    r = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("x").alias("dx"), F.count_distinct("y").alias("dy"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman")
    )
    ok = (F.col("n") >= 3) & (F.col("dx") > 1) & (F.col("dy") > 1)
    for c in ("pearson", "spearman"):
        r = r.withColumn(c, F.when(ok & ~F.isnan(c), F.col(c)))
        t = F.col(c) * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col(c) * F.col(c), F.lit(1e-300)))
        r = r.withColumn(f"p_{c}", t_sf(t, (F.col("n") - 2).cast("double")))
    return r.drop("dx", "dy")


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """ids, metric, value: one row per metric."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select(*ids, "s.*")


def correlation_table(df: DataFrame, metrics: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """metric x target: n, pearson, spearman and their p."""
    long = long_metrics(df, targets, metrics)
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("goal")) for c in targets])).alias("t")
    return safe_correlation(long.select("metric", "value", t).select("metric", "value", "t.*"), ["metric", "target"], "value", "goal")


def loo_correlations(df: DataFrame, unit: str, metrics: Sequence[str], target: str, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The same with each unit (and each named group of units) left out: excluded, metric, ..."""
    long = long_metrics(df, [unit, target], metrics)
    units = df.select(F.col(unit).cast("string").alias("excluded"), F.array(F.col(unit).cast("string")).alias("out")).distinct()
    for name, members in (groups or {}).items():
        units = units.union(df.sparkSession.range(1).select(F.lit(name), F.array(*[F.lit(str(m)) for m in members])))
    cases = long.join(F.broadcast(units), ~F.array_contains("out", F.col(unit).cast("string")))  # units x metrics, both few
    return safe_correlation(cases, ["excluded", "metric"], "value", target)


def partial_correlation(df: DataFrame, metrics: Sequence[str], target: str, control: str) -> DataFrame:
    """Correlation of the residuals of metric and target after least squares on the control."""
    long = long_metrics(df, [target, control], metrics).filter(f"value is not null and {target} is not null and {control} is not null")
    fits = long.groupBy("metric").agg(
        F.regr_slope("value", control).alias("sm"), F.regr_intercept("value", control).alias("im"), F.regr_slope(target, control).alias("st"), F.regr_intercept(target, control).alias("it")
    )
    res = long.join(F.broadcast(fits), "metric").select(
        "metric", F.round(F.col("value") - F.col("sm") * F.col(control) - F.col("im"), 10).alias("rm"), F.round(F.col(target) - F.col("st") * F.col(control) - F.col("it"), 10).alias("rt")
    )
    return safe_correlation(res, ["metric"], "rm", "rt")


def baseline_saturation(df: DataFrame, baseline: str, gain: str) -> DataFrame:
    return safe_correlation(df, [], baseline, gain)


def delta_correlations(before_after: DataFrame, keys: Sequence[str], is_original: Column, metrics: Sequence[str], gain: str) -> DataFrame:
    """Correlations of structural changes with the gain."""
    from topoeval.operators.summaries import metric_deltas

    d = metric_deltas(before_after, [*keys, gain], is_original, metrics) if gain in keys else metric_deltas(before_after, keys, is_original, metrics)
    return correlation_table(d, [f"delta_{m}" for m in metrics], [gain])


def metric_suitability(df: DataFrame, metrics: Sequence[str], gain: str, success: str) -> DataFrame:
    """metric, spearman with the gain, AUC of success oriented to be at least 0.5, direction."""
    from topoeval.operators.evaluate import rank_auc

    long = long_metrics(df, [gain, success], metrics)
    auc = rank_auc(long.filter("value is not null"), success, "value", ["metric"])
    rho = safe_correlation(long, ["metric"], "value", gain).select("metric", "n", "spearman", "p_spearman")
    a = F.col("auc")
    return rho.join(auc, "metric").select("*", F.greatest(a, 1 - a).alias("oriented_auc"), F.when(a >= 0.5, "higher").otherwise("lower").alias("direction"))


def leave_one_out_means(df: DataFrame, unit: str, value: str, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """removed, n, mean, median, positive share of the unit means without that unit or group; 'none' removes nothing."""
    units = df.groupBy(unit).agg(F.avg(value).alias("v"))
    cases = units.select(F.col(unit).cast("string").alias("removed"), F.array(F.col(unit).cast("string")).alias("out"))
    spark = df.sparkSession
    for name, members in {"none": (), **(groups or {})}.items():
        cases = cases.union(spark.range(1).select(F.lit(name), F.array(*[F.lit(str(m)) for m in members]).cast("array<string>")))
    kept = units.join(F.broadcast(cases), ~F.array_contains("out", F.col(unit).cast("string")))
    return kept.groupBy("removed").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.avg((F.col("v") > 0).cast("double")).alias("positive"))


def recovery_comparisons(df: DataFrame, keys: Sequence[str], unit: str, gain: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Per key over unit means: n, mean, median, bootstrap interval, positive share, signed-rank p and its Holm adjustment."""
    from topoeval.operators.resample import bootstrap_mean

    units = df.groupBy(*keys, unit).agg(F.avg(gain).alias("g"))
    base = units.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.expr("percentile(g, 0.5)").alias("median"), F.avg((F.col("g") > 0).cast("double")).alias("positive"))
    w = wilcoxon_signed_rank(units, keys, "g").select(*keys, "statistic", "p")
    ci = bootstrap_mean(units, keys, unit, "g", replicates, seed).select(*keys, "ci_low", "ci_high")
    return holm_adjust(base.join(ci, list(keys)).join(w, list(keys)))


def gain_summary(df: DataFrame, keys: Sequence[str], unit: str, gain: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """recovery_comparisons without the adjustment, with the deviation."""
    std = df.groupBy(*keys, unit).agg(F.avg(gain).alias("g")).groupBy(*keys).agg(F.stddev_samp("g").alias("std"))
    return recovery_comparisons(df, keys, unit, gain, replicates, seed).drop("p_holm").join(std, list(keys))


def two_level_summary(df: DataFrame, unit: str, gain: str) -> DataFrame:
    """level (execution or unit), n, mean, deviation, median, positive share, signed-rank p."""
    rows = df.select(F.lit("execution").alias("level"), F.col(gain).alias("g")).union(
        df.groupBy(unit).agg(F.avg(gain).alias("g")).select(F.lit("unit"), "g")
    )
    base = rows.groupBy("level").agg(
        F.count("*").alias("n"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("std"), F.expr("percentile(g, 0.5)").alias("median"), F.avg((F.col("g") > 0).cast("double")).alias("positive")
    )
    return base.join(wilcoxon_signed_rank(rows, ["level"], "g").select("level", "statistic", "p"), "level")


def confidence_intervals(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tests.select(*keys, "n", "mean_diff", "ci_low", "ci_high")
