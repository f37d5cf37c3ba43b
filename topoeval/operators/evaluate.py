"""Evaluation of labels, scores and regressions; thresholds; evaluation of a topology by a classifier on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.scalars import safe_corr
from topoeval.functions.ranges import quantiles, running_sum
from topoeval.operators.summaries import avg_rank


def macro_f1(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """accuracy and macro_f1 over the classes that occur in y or pred (0 where precision and recall are)."""
    cells = df.groupBy(*keys, y, pred).agg(F.count("*").alias("n"))
    both = cells.select(*keys, F.col(y).alias("c"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("of_y"), F.lit(0).alias("of_pred")).union(
        cells.select(*keys, F.col(pred), F.lit(0), F.lit(0), F.col("n"))
    )
    by_class = both.groupBy(*keys, "c").agg(F.sum("tp").alias("tp"), F.sum("of_y").alias("of_y"), F.sum("of_pred").alias("of_pred"))
    return by_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("of_y")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("of_y") + F.col("of_pred"))).alias("macro_f1"), F.sum("of_y").alias("n")
    )


def rank_auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUC from average ranks; NULL with one class only."""
    ranked = avg_rank(df.select(*keys, F.col(y).alias("__y"), F.col(p).alias("__p")), "__p", keys)
    n1, n0 = F.count_if(F.col("__y") == 1), F.count_if(F.col("__y") == 0)
    s = F.sum(F.when(F.col("__y") == 1, F.col("rank")))
    return ranked.groupBy(*keys).agg(F.when((n1 > 0) & (n0 > 0), (s - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, keys: Sequence[str] = (), brier: bool = False) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1, specificity, AUC, counts, share of bad recommendations; with
    brier the mean squared error of p. Undefined ratios are 0.
    """
    t, r = F.col(y) == 1, F.col(p) >= threshold
    counts = df.groupBy(*keys).agg(
        F.count_if(t & r).alias("tp"), F.count_if(~t & r).alias("fp"), F.count_if(~t & ~r).alias("tn"), F.count_if(t & ~r).alias("fn"),
        *([F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")] if brier else []),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, precision, spec = safe(tp, tp + fn), safe(tp, tp + fp), safe(tn, tn + fp)
    out = counts.withColumns(
        {
            "accuracy": safe(tp + tn, tp + fp + tn + fn), "balanced_accuracy": (recall + spec) / 2, "precision": precision, "recall": recall,
            "f1": safe(2 * tp, 2 * tp + fp + fn), "specificity": spec, "bad_recommendation": safe(fp, tp + fp),
        }
    )
    auc = rank_auc(df, y, p, keys)
    return out.join(auc, list(keys)) if keys else out.crossJoin(auc)


def roc_points(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """threshold, tp, fp, tpr, fpr for every distinct score, from the highest: scores are counted first."""
    by_score = df.groupBy(*keys, F.col(p).alias("threshold")).agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
    upto = running_sum(by_score, keys, [F.col("threshold").desc()], tp="n1", fp="n0")
    total = by_score.groupBy(*keys).agg(F.sum("n1").alias("p"), F.sum("n0").alias("n"))
    both = upto.join(total, list(keys)) if keys else upto.crossJoin(F.broadcast(total))
    return both.select(*keys, "threshold", "tp", "fp", "p", "n").withColumns({"tpr": F.col("tp") / F.greatest("p", F.lit(1)), "fpr": F.col("fp") / F.greatest("n", F.lit(1))})


def youden_threshold(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """The threshold of largest tpr - fpr (ties: the highest)."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    return roc_points(df, y, p, keys).groupBy(*keys).agg(F.max_by("threshold", F.struct(j, "threshold")).alias("threshold"), F.max(j).alias("youden"))


def cost_threshold(df: DataFrame, y: str, p: str, fp_cost: float = 2.0, fn_cost: float = 1.0) -> DataFrame:
    """Least cost, then highest precision, then least threshold, over the distinct scores, .01 and .99; decisions are p >= t."""
    points = df.select(F.col(p).alias("t")).union(df.sparkSession.createDataFrame([(0.01,), (0.99,)], "t double")).distinct()
    counts = df.groupBy(F.col(p).alias("t")).agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
    met = points.join(counts, "t", "left").na.fill(0, ["n1", "n0"])
    upto = running_sum(met, [], [F.col("t").desc()], tp="n1", fp="n0")
    c = upto.select("t", "tp", "fp").crossJoin(F.broadcast(counts.agg(F.sum("n1").alias("n1"))))
    cost = F.col("fp") * fp_cost + (F.col("n1") - F.col("tp")) * fn_cost
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    c = c.withColumns({"cost": cost, "precision": precision})
    return c.agg(F.min(F.struct(F.col("cost").alias("cost"), (-F.col("precision")).alias("np"), F.col("t").alias("t"))).alias("b")).select(
        F.col("b.t").alias("threshold"), F.col("b.cost").alias("cost"), (-F.col("b.np")).alias("precision")
    )


def avoid_threshold(df: DataFrame, y: str, p: str, recommend: float | None = None) -> DataFrame:
    """The largest t such that p <= t covers at least max(5, 5 %) rows of which at most 10 % are positive; else the first
    quartile of the negatives' scores. Never at or above ``recommend``.
    """
    counts = df.groupBy(F.col(p).alias("t")).agg(F.count_if(F.col(y) == 1).alias("n1"), F.count("*").alias("n"))
    upto = running_sum(counts, [], ["t"], missed="n1", covered="n").select("t", "missed", "covered")
    c = upto.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    good = (F.col("covered") >= F.greatest(F.lit(5), F.col("total") * 0.05)) & (F.col("missed") <= 0.1 * F.col("covered"))
    if recommend is not None:
        good = good & (F.col("t") < recommend)
    first = c.agg(F.max(F.when(good, F.col("t"))).alias("a"))
    other = quantiles(df.filter(F.col(y) == 0), p, [0.25]).select(F.element_at("cuts", 1).alias("b"))
    b = F.col("b") if recommend is None else F.least("b", F.lit(recommend - 1e-9))
    return first.join(other, F.lit(True), "left").select(F.coalesce("a", b).alias("threshold"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and Spearman."""
    e = F.col(y) - F.col(pred)
    base = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.count("*").alias("n")
    )
    ranked = avg_rank(avg_rank(df, y, keys, "__ry"), pred, keys, "__rp")
    rho = ranked.groupBy(*keys).agg(safe_corr("__ry", "__rp").alias("spearman"))
    return base.join(rho, list(keys)) if keys else base.crossJoin(rho)


def evaluate_topology(canonical: DataFrame, nodes: DataFrame, width: int, hops: int = 2, regs: Sequence[float] = (0.01, 0.1), seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Node classification on a topology (one graph): propagated features, logistic regression on the training part, the
    regularisation with the best validation macro-F1, and scores of every part for it. Of one regularisation nothing could be
    chosen, which is an error.
    """
    if len(set(regs)) < 2:
        raise ValueError("a choice takes two regularisations at least")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from topoeval.functions.lineage import cut
    from topoeval.operators.linalg import propagate_features
    from topoeval.operators.splits import stratified_split

    split = stratified_split(nodes.select("graph_id", "id", "label"), seed=seed)
    x = propagate_features(canonical, nodes, width, hops)
    data = cut(x.join(split, ["graph_id", "id"]).select("graph_id", "id", F.col("label").cast("double").alias("y"), "split", array_to_vector("features").alias("features")))
    train = data.filter("split = 'train'")
    out = None
    for reg in regs:
        model = LogisticRegression(labelCol="y", maxIter=max_iter, regParam=reg).fit(train)
        scored = model.transform(data).select("graph_id", "split", "y", F.col("prediction").alias("pred"))
        one = macro_f1(scored, ["graph_id", "split"]).withColumn("reg", F.lit(float(reg)))
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    best = out.filter("split = 'val'").groupBy("graph_id").agg(F.max_by("reg", F.struct("macro_f1", "reg")).alias("reg"))
    return out.join(best, ["graph_id", "reg"])
