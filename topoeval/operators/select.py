"""Choosing candidates by validation: selection, fallback, gates, regret. A selector never sees test scores; these are
joined to what it has chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.operators.summaries import best_per_key

KEYS = ("dataset", "backbone", "seed")


def _outcome(chosen: DataFrame, runs: DataFrame, keys: Sequence[str], test: str) -> DataFrame:
    names = [*keys, "candidate"]
    return chosen.join(runs.select(*names, F.col(test).alias("test")), names)


def validation_select(
    runs: DataFrame, keys: Sequence[str] = KEYS, val: str = "val_f1", test: str = "test_f1", baseline: int = 1, tie: str = "candidate"
) -> DataFrame:
    """Per key: the candidate other than the baseline with the best validation score (ties: least ``tie``), its scores and the
    gains over the baseline. Keys without a baseline have NULL gains; keys without other candidates are left out.
    """
    pool = runs.filter(F.col("candidate") != baseline).select(*keys, *dict.fromkeys(["candidate", tie]), F.col(val).alias("val"))
    chosen = best_per_key(pool, keys, F.col("val").desc(), tie)
    base = runs.filter(F.col("candidate") == baseline).select(*keys, F.col(val).alias("baseline_val"), F.col(test).alias("baseline_test"))
    out = _outcome(chosen, runs, keys, test).join(base, list(keys), "left")
    return out.withColumns({"gain_val": F.col("val") - F.col("baseline_val"), "gain_test": F.col("test") - F.col("baseline_test")})


def select_with_fallback(runs: DataFrame, keys: Sequence[str] = KEYS, val: str = "val_f1", test: str = "test_f1", baseline: int = 1) -> DataFrame:
    """The baseline competes; ties go to it, then to the least candidate. Keys need a baseline row of their own."""
    own = runs.join(runs.filter(F.col("candidate") == baseline).select(*keys).distinct(), list(keys), "left_semi")
    own = own.select(*keys, "candidate", F.col(val).alias("val"), (F.col("candidate") == baseline).alias("fallback"))
    chosen = best_per_key(own, keys, F.col("val").desc(), F.col("fallback").desc(), "candidate")
    return _outcome(chosen, runs, keys, test)


def fallback_rate(chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return chosen.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"))


def margin_gate(
    runs: DataFrame, margin_pp: float | Column, keys: Sequence[str] = KEYS, val: str = "val_f1", test: str = "test_f1", baseline: int = 1, preference: Sequence[str | Column] = ("candidate",)
) -> DataFrame:
    """The best candidate if it beats the baseline by at least the margin (in points of validation), else the baseline."""
    pool = runs.filter(F.col("candidate") != baseline).withColumn("val", F.col(val))
    best = best_per_key(pool, keys, F.col("val").desc(), *preference).select(*keys, F.col("candidate").alias("best"), F.col("val").alias("best_val"))
    base = runs.filter(F.col("candidate") == baseline).select(*keys, F.col(val).alias("baseline_val"), F.col(test).alias("baseline_test"))
    margin = F.lit(margin_pp) if isinstance(margin_pp, float | int) else margin_pp
    lead = F.round(100 * (F.col("best_val") - F.col("baseline_val")), 6)
    gated = base.join(best, list(keys), "left").withColumn("adopted", F.coalesce(lead >= margin, F.lit(False)))
    gated = gated.withColumn("candidate", F.when(F.col("adopted"), F.col("best")).otherwise(F.lit(baseline)))
    out = _outcome(gated, runs, keys, test)
    return out.withColumn("gain_pp", 100 * (F.col("test") - F.col("baseline_test")))


def gate_sweep(runs: DataFrame, margins: Sequence[float] = (0.0, 0.5, 1.0, 2.0, 3.0), keys: Sequence[str] = KEYS, val: str = "val_f1", test: str = "test_f1", baseline: int = 1) -> DataFrame:
    """Per margin: decisions, share adopted, mean gain, share of positive gains. One ranking serves all margins."""
    best = best_per_key(runs.filter(F.col("candidate") != baseline), keys, F.col(val).desc(), "candidate").select(*keys, F.col(val).alias("bv"), F.col(test).alias("bt"))
    base = runs.filter(F.col("candidate") == baseline).select(*keys, F.col(val).alias("ov"), F.col(test).alias("ot"))
    cases = base.join(best, list(keys), "left").withColumn("margin", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    adopt = F.coalesce(F.round(100 * (F.col("bv") - F.col("ov")), 6) >= F.col("margin"), F.lit(False))
    cases = cases.withColumn("adopt", adopt).withColumn("gain_pp", F.when(F.col("adopt"), 100 * (F.col("bt") - F.col("ot"))).otherwise(0.0))
    return cases.groupBy("margin").agg(
        F.count("*").alias("n"), F.avg(F.col("adopt").cast("double")).alias("adopted"), F.avg("gain_pp").alias("mean_gain_pp"), F.avg((F.col("gain_pp") > 0).cast("double")).alias("positive")
    )


def two_stage_gate(runs: DataFrame, keys: Sequence[str], method: str, margin_pp: float, val: str = "val_f1", test: str = "test_f1", baseline: int = 1) -> DataFrame:
    """The best candidate within each method, then the best method, then the gate against the baseline."""
    base = runs.filter(F.col("candidate") == baseline)
    first = best_per_key(runs.filter(F.col("candidate") != baseline), [*keys, method], F.col(val).desc(), "candidate")
    winners = best_per_key(first, keys, F.col(val).desc(), method, "candidate")
    return margin_gate(winners.unionByName(base), margin_pp, keys, val, test, baseline)


def selection_regret(runs: DataFrame, chosen: DataFrame, keys: Sequence[str] = KEYS, test: str = "test_f1") -> DataFrame:
    """Per decision (chosen: keys, candidate, test): the oracle by test score (ties: least candidate), regret in points, hit."""
    oracle = best_per_key(runs, keys, F.col(test).desc(), "candidate").select(*keys, F.col("candidate").alias("oracle"), F.col(test).alias("oracle_test"))
    out = chosen.select(*keys, "candidate", "test").join(oracle, list(keys))
    regret = 100 * (F.col("oracle_test") - F.col("test"))
    return out.withColumn("regret_pp", regret).withColumn("hit", F.abs("regret_pp") < 1e-10)


def regret_summary(regret: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return regret.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("regret_pp").alias("mean"), F.expr("percentile(regret_pp, 0.5)").alias("median"), F.expr("percentile(regret_pp, 0.9)").alias("p90"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
    )


def best_candidates_wide(runs: DataFrame, keys: Sequence[str], constructor: str, names: Sequence, val: str = "val_f1") -> DataFrame:
    """Best row of each constructor, its scores in columns c<name>_val, one row per key."""
    best = best_per_key(runs, [*keys, constructor], F.col(val).desc(), "candidate")
    return best.groupBy(*keys).pivot(constructor, list(names)).agg(F.max(val)).withColumnsRenamed({str(n): f"c{n}_val" for n in names})


def gate_audit(runs: DataFrame, chosen: DataFrame, keys: Sequence[str] = KEYS, baseline: int = 1) -> DataFrame:
    """All candidates with eligible (the key has a baseline) and chosen."""
    ok = runs.filter(F.col("candidate") == baseline).select(*keys, F.lit(True).alias("__e"))
    mark = chosen.select(*keys, "candidate", F.lit(True).alias("__c"))
    out = runs.join(ok, list(keys), "left").join(mark, [*keys, "candidate"], "left")
    return out.withColumns({"eligible": F.coalesce("__e", F.lit(False)), "chosen": F.coalesce("__c", F.lit(False))}).drop("__e", "__c")


def gain_decomposition(runs: DataFrame, keys: Sequence[str] = KEYS, val: str = "val_f1", test: str = "test_f1", original: int = 1, geometry: int = 2) -> DataFrame:
    """geometry: f1(geometry) - f1(original); refinement: f1(best refined) - f1(geometry); total: f1(best of all others) - f1(original)."""
    pick = lambda where, name: best_per_key(runs.filter(where), keys, F.col(val).desc(), "candidate").select(*keys, F.col(test).alias(name))
    c = F.col("candidate")
    parts = [pick(c == original, "f_original"), pick(c == geometry, "f_geometry"), pick(c > geometry, "f_refined"), pick(c != original, "f_selected")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys), "left")
    return out.select(
        *keys, (F.col("f_geometry") - F.col("f_original")).alias("gain_geometry"), (F.col("f_refined") - F.col("f_geometry")).alias("gain_refinement"), (F.col("f_selected") - F.col("f_original")).alias("gain_total")
    )


def condition_vs_baseline(condition: DataFrame, baseline: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    base = baseline.select(*keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    return condition.join(base, list(keys), "left").withColumns({f"gain_{m}": F.col(m) - F.col(f"baseline_{m}") for m in metrics})


def nested_select(runs: DataFrame, keys: Sequence[str] = KEYS, inner: str = "inner_val_f1", topology: str = "topology_val_f1", test: str = "test_f1", baseline: int = 1) -> DataFrame:
    """Topology chosen on its own validation part; gains over the baseline on all three parts."""
    chosen = best_per_key(runs.filter(F.col("candidate") != baseline), keys, F.col(topology).desc(), "candidate")
    base = runs.filter(F.col("candidate") == baseline)
    return condition_vs_baseline(chosen, base, keys, [inner, topology, test])


def threshold_sweep(df: DataFrame, score: str, gain: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: coverage, mean and median gain and success rate at or below, success rate above."""
    cases = df.select(F.col(score).alias("s"), F.col(gain).alias("g"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    low = F.col("s") <= F.col("threshold")
    return cases.groupBy("threshold").agg(
        F.avg(low.cast("double")).alias("coverage"), F.avg(F.when(low, F.col("g"))).alias("mean_gain"), F.expr("percentile(if(s <= threshold, g, null), 0.5)").alias("median_gain"),
        F.avg(F.when(low, (F.col("g") > 0).cast("double"))).alias("success_low"), F.avg(F.when(~low, (F.col("g") > 0).cast("double"))).alias("success_high"),
    )
