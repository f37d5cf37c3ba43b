"""Small predictive models over metric tables: grouped cross-validation, frozen manifests, importances, rule search.

Fits run on pyspark.ml; a frozen model is a JSON manifest that scores by a plain SQL expression.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.functions.ranges import quantiles, ranked
from topoeval.functions.scalars import stable_uniform
from topoeval.operators.evaluate import avoid_threshold, binary_metrics, cost_threshold, rank_auc, regression_metrics, youden_threshold
from topoeval.operators.splits import group_folds, logo_folds
from topoeval.operators.summaries import assert_no_leakage, usable_features


def metric_pipeline(features: Sequence[str], model, scale: bool = True) -> Pipeline:
    """Median imputation, assembly, standardisation, model."""
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=[f"{f}__f" for f in features])]
    stages.append(VectorAssembler(inputCols=[f"{f}__f" for f in features], outputCol="raw" if scale else "features"))
    if scale:
        stages.append(StandardScaler(withMean=True, inputCol="raw", outputCol="features"))
    return Pipeline(stages=[*stages, model])


def candidate_models(features: Sequence[str], target: str, fp_cost: float = 2.0, pairs: bool = True, seed: int = 0) -> list[tuple[str, int, list[str], Pipeline]]:
    """(name, complexity, features, pipeline): stumps, logistic regressions on pairs, a shallow tree, all features."""
    lr = lambda: LogisticRegression(labelCol=target, weightCol="weight", maxIter=50, regParam=0.01)
    tree = lambda depth: DecisionTreeClassifier(labelCol=target, weightCol="weight", maxDepth=depth, seed=seed)
    out = [(f"stump:{f}", 1, [f], metric_pipeline([f], tree(1), False)) for f in features]
    if pairs:
        out += [(f"logistic:{a}+{b}", 2, [a, b], metric_pipeline([a, b], lr())) for i, a in enumerate(features) for b in features[i + 1 :]]
    out.append(("tree", 3, list(features), metric_pipeline(features, tree(2), False)))
    out.append(("logistic:all", len(features), list(features), metric_pipeline(features, lr())))
    return out


def _weighted(df: DataFrame, target: str, fp_cost: float) -> DataFrame:
    return df.withColumn(target, F.col(target).cast("double")).withColumn("weight", F.when(F.col(target) == 0, fp_cost).otherwise(1.0))


def oof_predict(df: DataFrame, pipeline: Pipeline, target: str, ids: Sequence[str], folds: DataFrame, group: str) -> DataFrame:
    """ids, y, p of every row from the model that has not seen its fold."""
    rows = cut(df.join(F.broadcast(folds), group))
    out = None
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # a handful of folds
        model = pipeline.fit(rows.filter(F.col("fold") != fold))
        one = model.transform(rows.filter(F.col("fold") == fold)).select(*ids, F.col(target).alias("y"), vector_to_array("probability")[1].alias("p"))
        out = one if out is None else out.unionByName(one)
    return cut(out)


def fit_indicator(
    df: DataFrame, features: Sequence[str], target: str, group: str, ids: Sequence[str], forbidden: Sequence[str] = (), folds: int = 4, fp_cost: float = 2.0, pairs: bool = False, seed: int = 0
) -> tuple[DataFrame, DataFrame, dict]:
    """Leaderboard, out-of-fold table of the winner, and the frozen manifest of a logistic model on the winner's features.

    Candidates are compared by out-of-fold cost, complexity and precision; features need enough values and may not leak.
    """
    assert_no_leakage(features, forbidden)
    use = usable_features(df, features)
    data = _weighted(df, target, fp_cost)
    fold = group_folds(df, group, folds, target)
    board, kept = [], {}
    for name, complexity, own, pipe in candidate_models(use, target, fp_cost, pairs, seed):
        p = oof_predict(data, pipe, target, ids, fold, group)
        best = cost_threshold(p, "y", "p", fp_cost).first()
        board.append((name, complexity, float(best["cost"]), float(best["precision"]), float(best["threshold"])))
        kept[name] = (own, p)
    spark = df.sparkSession
    table = spark.createDataFrame(board, "model string, complexity int, cost double, precision double, threshold double")
    won = min(board, key=lambda r: (r[2], r[1], -r[3], r[0]))
    own, p = kept[won[0]]
    recommend = won[4]
    avoid = avoid_threshold(p, "y", "p", recommend).first()[0]
    manifest = freeze_logistic(data, own, target) | {"model": won[0], "recommend": recommend, "avoid": float(avoid) if avoid is not None else 0.0}
    return table.orderBy("cost", "complexity", F.col("precision").desc(), "model"), p, manifest


def freeze_logistic(df: DataFrame, features: Sequence[str], target: str) -> dict:
    """Features, medians, means, deviations, coefficients and intercept of a logistic fit; plain numbers."""
    model = metric_pipeline(features, LogisticRegression(labelCol=target, weightCol="weight", maxIter=50, regParam=0.01)).fit(df)
    medians = model.stages[0].surrogateDF.first()
    scaler, lr = model.stages[2], model.stages[3]
    return {
        "features": list(features), "medians": [float(medians[f]) for f in features], "means": [float(x) for x in scaler.mean], "stds": [float(x) or 1.0 for x in scaler.std],
        "coefficients": [float(x) for x in lr.coefficients], "intercept": float(lr.intercept),
    }


def score_frozen(manifest: dict | str) -> Column:
    """Probability of a frozen logistic model as a column expression."""
    m = json.loads(manifest) if isinstance(manifest, str) else manifest
    z = F.lit(m["intercept"])
    for f, med, mean, std, w in zip(m["features"], m["medians"], m["means"], m["stds"], m["coefficients"], strict=True):
        z = z + (F.coalesce(F.col(f).cast("double"), F.lit(med)) - mean) / std * w
    return 1 / (1 + F.exp(-z))


def family_holdout(df: DataFrame, features: Sequence[str], target: str, family: str, ids: Sequence[str], fp_cost: float = 2.0) -> DataFrame:
    """binary_metrics of leave-one-family-out predictions."""
    pipe = metric_pipeline(features, LogisticRegression(labelCol=target, weightCol="weight", maxIter=50, regParam=0.01))
    p = oof_predict(_weighted(df, target, fp_cost), pipe, target, ids, logo_folds(df, family), family)
    return binary_metrics(p, "y", "p")


def fit_gain_regression(df: DataFrame, features: Sequence[str], gain: str, group: str, ids: Sequence[str], folds: int = 4, seed: int = 0) -> DataFrame:
    """model, mae, rmse, r2, spearman of out-of-fold ridge and forest predictions of a gain."""
    rows = cut(df.join(F.broadcast(group_folds(df, group, folds)), group).withColumn(gain, F.col(gain).cast("double")))
    models = {"ridge": (LinearRegression(labelCol=gain, regParam=0.1), True), "forest": (RandomForestRegressor(labelCol=gain, numTrees=20, maxDepth=4, seed=seed), False)}
    out = None
    for name, (model, scale) in models.items():
        for fold in range(folds):
            fitted = metric_pipeline(features, model, scale).fit(rows.filter(F.col("fold") != fold))
            one = fitted.transform(rows.filter(F.col("fold") == fold)).select(F.lit(name).alias("model"), *ids, F.col(gain).alias("y"), F.col("prediction").alias("pred"))
            out = one if out is None else out.unionByName(one)
    return regression_metrics(cut(out), "y", "pred", ["model"])


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, order: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, drop (mean) and its deviation in balanced accuracy of a forest when the feature is shuffled among rows: the
    value of the row whose number is drawn by hash comes in. All repeats are scored as one table.
    """
    data = _weighted(df, target, 1.0)
    model = metric_pipeline(features, RandomForestClassifier(labelCol=target, numTrees=20, maxDepth=4, seed=seed), False).fit(data)
    rows = cut(data.select(order, target, *features))
    base = binary_metrics(model.transform(rows).select(F.col(target).alias("y"), vector_to_array("probability")[1].alias("p"))).select("balanced_accuracy").first()[0]
    numbered, cases = ranked(rows.select(order), [], [order], "__k"), None
    reps = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    for f in features:
        a = numbered.join(reps, order)
        drawn = ranked(reps.select("rep", order, F.col(f).alias("__v")), ["rep"], [stable_uniform(F.lit(seed), F.lit(f), "rep", order), F.col(order)], "__k")
        b = drawn.select("rep", "__k", "__v")
        one = a.join(b, ["rep", "__k"]).withColumn(f, F.col("__v")).select(F.lit(f).alias("feature"), "rep", target, *features)
        cases = one if cases is None else cases.unionByName(one)
    scored = model.transform(cases).select("feature", "rep", F.col(target).alias("y"), vector_to_array("probability")[1].alias("p"))
    m = binary_metrics(cut(scored), keys=["feature", "rep"]).withColumn("drop", F.lit(base) - F.col("balanced_accuracy"))
    return m.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def ensemble_predict(train: DataFrame, other: DataFrame, features: Sequence[str], target: str, ids: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mean probability of a logistic regression and a forest for the other table (ids, p), and both models' importances."""
    data = _weighted(train, target, 1.0)
    lr = metric_pipeline(features, LogisticRegression(labelCol=target, weightCol="weight", maxIter=50, regParam=0.1)).fit(data)
    rf = metric_pipeline(features, RandomForestClassifier(labelCol=target, numTrees=30, maxDepth=4, seed=seed), False).fit(data)
    p = lambda c: vector_to_array(c)[1]
    one = lr.transform(other).select(*ids, p("probability").alias("a"))
    two = rf.transform(other).select(*ids, p("probability").alias("b"))
    coef = [abs(float(x)) for x in lr.stages[-1].coefficients]
    imp = [float(x) for x in rf.stages[-1].featureImportances.toArray()]
    table = train.sparkSession.createDataFrame([(f, c, i) for f, c, i in zip(features, coef, imp, strict=True)], "feature string, coefficient double, importance double")
    return one.join(two, list(ids)).select(*ids, ((F.col("a") + F.col("b")) / 2).alias("p")), combined_importance(table)


def combined_importance(table: DataFrame) -> DataFrame:
    """combined: mean of both importances, each normalised by its sum."""
    total = table.agg(F.greatest(F.sum("coefficient"), F.lit(1e-12)).alias("c"), F.greatest(F.sum("importance"), F.lit(1e-12)).alias("i"))
    return table.crossJoin(total).select("feature", "coefficient", "importance", ((F.col("coefficient") / F.col("c") + F.col("importance") / F.col("i")) / 2).alias("combined"))


def feature_set_auc(df: DataFrame, sets: dict[str, Sequence[str]], target: str, group: str, ids: Sequence[str], folds: int = 4) -> DataFrame:
    """feature_set, auc of out-of-fold predictions for each named set of features."""
    out = None
    for name, features in sets.items():
        pipe = metric_pipeline(features, LogisticRegression(labelCol=target, weightCol="weight", maxIter=50, regParam=0.01))
        p = oof_predict(_weighted(df, target, 1.0), pipe, target, ids, group_folds(df, group, folds, target), group)
        one = rank_auc(p, "y", "p").select(F.lit(name).alias("feature_set"), "auc")
        out = one if out is None else out.unionByName(one)
    return out


def single_metric_indicators(train: DataFrame, blind: DataFrame, metrics: Sequence[str], y: str) -> DataFrame:
    """Per metric: median imputation and orientation from the training rows, Youden threshold, binary metrics on the blind rows."""
    from topoeval.operators.stats import long_metrics

    med = long_metrics(train, [y], metrics).groupBy("metric").agg(F.expr("percentile(value, 0.5)").alias("med"))

    def filled(df: DataFrame) -> DataFrame:
        return long_metrics(df, [y], metrics).join(F.broadcast(med), "metric").select("metric", F.col(y).alias("y"), F.coalesce("value", "med").alias("v"))

    auc = rank_auc(filled(train), "y", "v", ["metric"]).select("metric", F.when(F.col("auc") >= 0.5, 1.0).otherwise(-1.0).alias("sign"))
    turned = lambda df: filled(df).join(F.broadcast(auc), "metric").select("metric", "y", "sign", (F.col("v") * F.col("sign")).alias("s"))
    t = youden_threshold(turned(train), "y", "s", ["metric"]).select("metric", "threshold")
    scored = turned(blind).join(F.broadcast(t), "metric").select("metric", "y", (F.col("s") - F.col("threshold")).alias("p"))
    return binary_metrics(scored, "y", "p", 0.0, ["metric"]).join(auc, "metric").join(t, "metric")


#: Quantiles that are thresholds of atoms; least and largest share of rows that a rule may hold for.
CUTS, SUPPORT = (0.1, 0.25, 0.5, 0.75, 0.9), (0.08, 0.80)


def _rule_counts(df: DataFrame, y: str, metrics: Sequence[str], atoms: list[tuple], rules: list[tuple]) -> list[tuple[int, int, int]]:
    """(rows, positives, negatives) that each rule holds for, by one scan. A rule is (op, left, right) over rules before it, or
    (atom, k) for atoms (metric, op, threshold); what a batch's rows say to an atom is a bitmap, and rules are
    combined and counted as bitmaps. Both lists have as many entries as the search's widths allow, whatever the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(rules), 3), np.int64)
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(float)
            one, none = np.packbits(label == 1), np.packbits(label == 0)
            columns = {m: b.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k, m in enumerate(metrics)}
            with np.errstate(invalid="ignore"):
                held = [np.packbits(columns[m] >= t if op == ">=" else columns[m] < t) for m, op, t in atoms]
            made: list[np.ndarray] = []
            for k, rule in enumerate(rules):
                if rule[0] == "atom":
                    bits = held[rule[1]]
                else:
                    bits = made[rule[1]] & made[rule[2]] if rule[0] == "AND" else made[rule[1]] | made[rule[2]]
                made.append(bits)
                total[k] += [int(np.bitwise_count(x).sum()) for x in (bits, bits & one, bits & none)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], ["rule", "k", "tp", "fp"])

    wide = df.select(F.col(y).cast("double"), *[F.col(m).cast("double") for m in metrics])
    parts = wide.mapInArrow(run, "rule int, k long, tp long, fp long").groupBy("rule").agg(F.sum("k"), F.sum("tp"), F.sum("fp"))
    found = {r[0]: tuple(r[1:]) for r in parts.collect()}
    return [found.get(k, (0, 0, 0)) for k in range(len(rules))]


def mine_rules(df: DataFrame, row: str, metrics: Sequence[str], y: str, top_atoms: int = 35, top_pairs: int = 60, triple_atoms: int = 25) -> DataFrame:
    """rule, complexity, support, tp, fp, balanced_accuracy, score of threshold rules and their AND/OR pairs and triples.

    Atoms: metric >= or < one of five quantiles (to nine decimals), with support in [.08, .80]. The best atoms make pairs, the best pairs
    with the best atoms triples; score = balanced accuracy - .01 (complexity - 1), ties go by name. A rule holds for no row
    whose metric is NULL. Rows are those of df, scanned once for each complexity; ``row`` only names them.
    """
    from topoeval.operators.stats import long_metrics

    long = long_metrics(df, [row, y], metrics).filter("value is not null")
    cuts = {r["metric"]: r["cuts"] for r in quantiles(long, "value", CUTS, ["metric"]).select("metric", F.transform("cuts", lambda t: F.round(t, 9)).alias("cuts")).collect()}
    atoms = [(m, op, t) for m in metrics for t in dict.fromkeys(cuts.get(m, [])) for op in (">=", "<")]
    n, n1, n0 = df.agg(F.count("*"), F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    out: list[tuple] = []

    def rated(names: list[str], counts: list[tuple[int, int, int]], complexity: int) -> list[tuple]:
        rows = []
        for name, (k, tp, fp) in zip(names, counts, strict=True):
            balanced = (tp / max(n1, 1) + 1 - fp / max(n0, 1)) / 2
            if n and SUPPORT[0] <= k / n <= SUPPORT[1]:
                rows.append((name, complexity, k / n, tp, fp, balanced, round(balanced - 0.01 * (complexity - 1), 9)))
        out.extend(rows)
        return sorted(rows, key=lambda r: (-r[6], r[0]))

    single = [f"{m} {op} {t!r}" for m, op, t in atoms]
    rules: list[tuple] = [("atom", k) for k in range(len(atoms))]
    at = {name: k for k, name in enumerate(single)}
    best = [r[0] for r in rated(single, _rule_counts(df, y, metrics, atoms, rules), 1)]

    def combined(pairs: list[tuple[str, str]], complexity: int) -> list[str]:
        """Counts all ANDs and ORs of the named rules, and their names, best first."""
        names = []
        for a, b in pairs:
            low, high = sorted((a, b))
            for op in ("AND", "OR"):
                name = f"({low} {op} {high})"
                if name not in at:
                    at[name] = len(rules)
                    rules.append((op, at[low], at[high]))
                    names.append(name)
        counts = _rule_counts(df, y, metrics, atoms, rules) if names else []
        return [r[0] for r in rated(names, [counts[at[x]] for x in names], complexity)]

    top = best[:top_atoms]
    two = combined([(a, b) for k, a in enumerate(top) for b in top[k + 1 :]], 2)
    combined([(a, b) for a in two[:top_pairs] for b in best[:triple_atoms]], 3)
    schema = "rule string, complexity int, support double, tp long, fp long, balanced_accuracy double, score double"
    return df.sparkSession.createDataFrame(out, schema)


def tree_rules(df: DataFrame, features: Sequence[str], target: str, depth: int = 2) -> str:
    """The splits of a shallow tree as text."""
    model = metric_pipeline(features, DecisionTreeClassifier(labelCol=target, maxDepth=depth, seed=0), False).fit(df.withColumn(target, F.col(target).cast("double")))
    text = model.stages[-1].toDebugString
    for k, f in sorted(enumerate(features), reverse=True):
        text = text.replace(f"feature {k} ", f"{f} ")
    return text
