"""Statistics, selection, splits, models, checks, sources and streams on small tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from topoeval.functions import scalars, tails
from topoeval.operators import blind, checks, evaluate, models, resample, select, splits, stats
from topoeval.operators import summaries as S
from topoeval.sources import tables
from topoeval.streaming import ingest


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5)
    n, w = 7, 4
    sums = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    assert tails.signed_rank_exact(n, w) == pytest.approx(2 * sum(s <= w for s in sums) / 2**n)


def test_wilcoxon(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, -2.0, 3.0, 4.0, 5.0, 0.0)] + [("z", 0.0)], "k string, d double")
    got = {r.k: r for r in stats.wilcoxon_signed_rank(df, ["k"], "d").collect()}
    assert (got["a"].n, got["a"].statistic) == (5, 2.0) and got["a"].p == pytest.approx(tails.signed_rank_exact(5, 2))
    assert (got["z"].n, got["z"].statistic, got["z"].p) == (0, 0.0, 1.0)
    pratt = stats.wilcoxon_signed_rank(df, ["k"], "d", "pratt").filter("k = 'a'").first()
    assert pratt.statistic == 3.0


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p double")
    got = {r.p: r.p_holm for r in S.holm_adjust(df).collect()}
    assert got == pytest.approx({0.01: 0.04, 0.03: 0.09, 0.04: 0.09, 0.9: 0.9})


def test_correlation_of_few(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 4.0), ("c", 3.0, 9.0), ("c", 4.0, 8.0)], "k string, x double, y double")
    got = {r.k: r for r in stats.safe_correlation(df, ["k"], "x", "y").collect()}
    assert got["a"].pearson is None and got["b"].spearman is None and got["c"].spearman == pytest.approx(0.8)


def test_seed(spark):
    assert spark.range(1).select(scalars.stable_seed(F.lit("42"), F.lit("a"), F.lit("1"))).first()[0] == 503881978


def test_bins_and_scaling(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(1, 9)], "x double, c double")
    assert [r.n for r in scalars.quantile_bin(df, "x", 4).groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()] == [2, 2, 2, 2]
    assert df.select(scalars.minmax_scale("c").alias("s")).distinct().collect()[0].s == 0.0
    assert S.prefix_sum(df, "x", "x").agg(F.max("prefix")).first()[0] == 36.0


def runs(spark):
    r = random.Random(0)
    rows = [("d", b, s, c, round(r.random(), 3), round(r.random(), 3)) for b in ("x", "y") for s in range(5) for c in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "dataset string, backbone string, seed int, candidate int, val_f1 double, test_f1 double"), rows


def test_selection(spark):
    df, rows = runs(spark)
    got = {(r.backbone, r.seed): r.candidate for r in select.validation_select(df).collect()}
    for key in got:
        own = [x for x in rows if (x[1], x[2]) == key and x[3] != 1]
        assert got[key] == min(own, key=lambda x: (-x[4], x[3]))[3]
    gate = select.margin_gate(df, 1000.0).collect()
    assert all(r.candidate == 1 and r.gain_pp == 0 for r in gate)
    free = select.select_with_fallback(df)
    regret = select.selection_regret(df, free)
    assert regret.filter("regret_pp < 0").isEmpty() and free.count() == 10
    audit = select.gate_audit(df, free)
    assert audit.filter("chosen").count() == 10 and audit.count() == 40
    two = select.two_stage_gate(df.withColumn("method", F.col("candidate") % 2), ["dataset", "backbone", "seed"], "method", 0.0)
    assert two.count() == 10


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    one = spark.createDataFrame([(1, "z")], "k int, w string")
    with pytest.raises(Exception, match="not unique"):
        S.checked_join(df, one, ["k"]).collect()
    assert S.checked_join(df, one, ["k"], contract="many_to_one").count() == 2
    with pytest.raises(ValueError):
        S.assert_disjoint_keys(df, one, ["k"])
    with pytest.raises(ValueError):
        S.assert_no_leakage(["gain"], ["gain"])
    assert S.append_knowledge(one, spark.createDataFrame([(1, "y"), (2, "y")], "k int, w string"), ["k"]).count() == 2


def test_splits(spark):
    df = spark.createDataFrame([("g", k, k % 4) for k in range(200)], "graph_id string, id long, label int")
    size = {r.split: r.n for r in splits.nested_split(df, seed=1).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert size == {"train": 120, "inner_val": 20, "topology_val": 20, "test": 40}
    a, b = splits.nested_split(df, seed=1), splits.nested_split(df, seed=2)
    assert not a.exceptAll(b).isEmpty() and a.exceptAll(splits.nested_split(df, seed=1)).isEmpty()


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "y int, p double")
    m = evaluate.binary_metrics(df, brier=True).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.auc) == (1, 0, 2, 1, 0.875)
    assert evaluate.youden_threshold(df, "y", "p").first().threshold == 0.9
    r = evaluate.regression_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.5)], "y double, pred double")).first()
    assert r.mae == pytest.approx(0.5) and r.spearman == pytest.approx(1.0)


def test_resampling(spark):
    df = spark.createDataFrame([(k, f"c{k % 4}", 2.0) for k in range(20)], "id int, c string, v double")
    for out in (resample.bootstrap_mean(df, [], "id", "v", 20), resample.hierarchical_bootstrap(df, "c", "id", "v", 20), resample.cluster_bootstrap(df, "c", "v", 20)):
        row = out.first()
        assert (row.ci_low, row.ci_high, row.replicates) == (2.0, 2.0, 20)


def outcomes(spark, n=80):
    r = random.Random(3)
    rows = []
    for k in range(n):
        a, b = r.random(), r.random()
        g = a - 0.5 + 0.1 * r.random()
        rows.append((f"g{k}", f"f{k % 4}", a, b if k % 9 else None, g / 10, int(g * 10 > 0.5)))
    return spark.createDataFrame(rows, "graph_id string, family string, m1 double, m2 double, gain double, success int")


def test_models(spark):
    df = outcomes(spark)
    board, oof, manifest = models.fit_indicator(df, ["m1", "m2"], "success", "family", ["graph_id"], ["gain"], folds=2)
    assert board.count() == 4 and oof.count() == 80 and manifest["avoid"] < manifest["recommend"]
    p = df.select(models.score_frozen(manifest).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 <= p[0] < p[1] <= 1
    imp = {r.feature: r.importance for r in models.permutation_importance(df, ["m1", "m2"], "success", "graph_id", 2).collect()}
    assert imp["m1"] > imp["m2"]
    assert {r.model for r in models.fit_gain_regression(df, ["m1", "m2"], "gain", "family", ["graph_id"], 2).collect()} == {"ridge", "forest"}
    best = models.mine_rules(df, "graph_id", ["m1", "m2"], "success", 4, 4).orderBy(F.col("score").desc()).first()
    assert "m1" in best.rule and best.balanced_accuracy > 0.8
    assert "m1" in models.tree_rules(df, ["m1", "m2"], "success")
    one = models.single_metric_indicators(df.filter("graph_id < 'g5'"), df.filter("graph_id >= 'g5'"), ["m1", "m2"], "success")
    assert one.count() == 2
    assert models.feature_set_auc(df, {"a": ["m1"], "b": ["m2"]}, "success", "family", ["graph_id"], 2).count() == 2


def test_blind(spark, tmp_path):
    df = blind.minimal_knowledge(outcomes(spark), ["m1", "m2"], "gain")
    known, wave = df.filter("graph_id < 'g5'"), df.filter("graph_id >= 'g5'")
    with pytest.raises(ValueError):
        blind.blind_predict(known, wave, ["m1", "m2"])
    p, mark = blind.blind_predict(known, wave.drop("gain_pp", "success"), ["m1", "m2"])
    assert len(mark.first().fingerprint) == 64
    shown, more = blind.blind_reveal(p, wave, known)
    assert more.count() == 80 and shown.count() == wave.count()
    assert blind.blind_summary(shown.withColumn("wave", F.lit(1))).count() == 2
    src = str(tmp_path / "waves")
    wave.drop("gain_pp", "success").coalesce(1).write.parquet(src)
    waves = ingest.read_parts(spark, src, wave.drop("gain_pp", "success").schema)
    ingest.drained(lambda: ingest.blind_wave_stream(waves, known, df, ["m1", "m2"], str(tmp_path / "sink"), str(tmp_path / "state")))
    assert spark.read.parquet(str(tmp_path / "sink/knowledge-0")).count() == 80


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    out = checks.expect_table(df, "t", 3, {"k": 2}).union(checks.expect_unique(df, ["k"])).union(checks.expect_not_null(df, ["v"]))
    out = out.union(checks.expect_close(df, df.limit(2), least=1)).union(checks.expect_group_distinct(df, "k", "v", 1))
    assert [r.passed for r in out.collect()] == [True, True, False, False, True, True]
    assert checks.expect_complete({"t": df}, {"t": 3}).first().passed


def test_sources(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("source,target,label\n0,1,5\n1,2,6\n2,2,7\n")
    e, n = tables.read_edges(spark, str(p))
    assert e.count() == 3 and {(r.id, r.label) for r in n.collect()} == {(0, 5), (1, 6), (2, 7)}
    both, named = tables.load_graph(spark, str(p))
    assert both.count() == 4 and "features" in named.columns
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_edges(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(FileNotFoundError):
        tables.load_graph(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError):
        tables.load_graph(spark, str(tmp_path / "x.gml"))
    for k in ("a", "b"):
        (tmp_path / "runs" / k).mkdir(parents=True)
        (tmp_path / "runs" / k / "res.csv").write_text("seed,v\n1,2\n")
        (tmp_path / "runs" / k / "key.csv").write_text(f"dataset\n{k}\n")
    rows = tables.collect_tables(spark, [str(tmp_path / "runs")], "res.csv")
    keys = tables.collect_tables(spark, [str(tmp_path / "runs")], "key.csv")
    assert sorted(r.dataset for r in tables.recover_key_from_sibling(rows, keys).collect()) == ["a", "b"]
    tables.write_manifest(spark, {"b": 1, "a": [2]}, str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")) == {"a": [2], "b": 1}
    calls = []
    for _ in range(2):
        tables.cached_table(spark, str(tmp_path / "c"), lambda: calls.append(1) or spark.range(3))
    assert len(calls) == 1


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "k string, g double")
    src = str(tmp_path / "src")
    for part in range(2):
        df.coalesce(1).write.mode("append").parquet(src)
        parts = ingest.read_parts(spark, src, df.schema)
        ingest.drained(lambda: ingest.ingest_run_parts(parts, str(tmp_path / "out"), str(tmp_path / "s1")))  # noqa: B023
        ingest.drained(lambda: ingest.streaming_graph_outcomes(parts, ["k"], "g", str(tmp_path / "agg"), str(tmp_path / "s2")))  # noqa: B023
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (part + 1)
    got = {r.k: (r.n, r.gain_mean) for r in spark.read.parquet(str(tmp_path / "agg")).collect()}
    assert got == {"a": (2, 1.0), "b": (2, -1.0)}
    assert math.isclose(sum(r.positive_fraction for r in ingest.outcome_aggregates(df, ["k"], "g").collect()), 1.0)


def test_collect_tables(spark, tmp_path):
    from topoeval.sources.tables import collect_tables

    for folder, text in (("a", "dataset,f1\nx,1.0\nx,1.0\n"), ("a/b", "f1,dataset\n2.0,y\n"), ("c", "dataset\nz\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "runs.csv").write_text(text)
        (tmp_path / folder / "other.csv").write_text("dataset\nno\n")
    rows = collect_tables(spark, [str(tmp_path), str(tmp_path / "a")], "runs.csv")
    assert sorted((r.dataset, r.f1) for r in rows.filter("f1 is not null").collect()) == [("x", "1.0"), ("x", "1.0"), ("y", "2.0")]
    assert [r.dataset for r in rows.filter("f1 is null").collect()] == ["z"]
    with pytest.raises(FileNotFoundError):
        collect_tables(spark, [str(tmp_path)], "none.csv")


def test_rules_by_hand(spark):
    """Every pair and triple counted row by row, NULLs holding for nothing."""
    rng = random.Random(6)
    rows = [(k, rng.choice([None, *map(float, range(6))]), rng.random(), rng.randint(0, 1)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(5)
    got = {r.rule: r for r in models.mine_rules(df, "id", ["a", "b"], "y", 4, 3, 2).collect()}
    assert {r.complexity for r in got.values()} == {1, 2, 3}

    def holds(rule, row):
        if rule.startswith("("):
            depth = 0
            for k, c in enumerate(rule):
                depth += (c == "(") - (c == ")")
                for op in (" AND ", " OR "):
                    if depth == 1 and rule.startswith(op, k):
                        sides = holds(rule[1:k], row), holds(rule[k + len(op) : -1], row)
                        return all(sides) if "AND" in op else any(sides)
        metric, op, t = rule.split(" ")
        x = row[1] if metric == "a" else row[2]
        return x is not None and (x >= float(t) if op == ">=" else x < float(t))

    for rule, r in got.items():
        held = [x for x in rows if holds(rule, x)]
        assert (r.tp, r.fp) == (sum(x[3] == 1 for x in held), sum(x[3] == 0 for x in held)), rule
        assert r.support == pytest.approx(len(held) / 300)
