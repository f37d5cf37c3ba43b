"""Ranks, sums and quantiles by ranges, and pairs chosen by histograms, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topoeval.functions import ranges
from topoeval.functions.scalars import minmax_scaled
from topoeval.operators import rewire, similarity, splits, summaries


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(20)]), float(rng.randint(0, 5))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, id long, x int, v double").repartition(7)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranked(table):
    rows, df = table
    got = {r.id: r.rank for r in ranges.ranked(df, ["k"], [F.col("v").desc(), F.col("id")]).collect()}
    for key in ("a", "b", None):
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[3], r[1]))
        assert [got[r[1]] for r in want] == [*range(1, len(want) + 1)]
    assert [r.rank for r in ranges.ranked(df, [], ["id"]).orderBy("id").collect()] == [*range(1, 601)]
    assert ranges.ranked(df.limit(0), ["k"], ["id"]).count() == 0


def test_running_sum(table):
    rows, df = table
    for r in ranges.running_sum(df, ["k"], ["v"], s="v", n="id").collect():
        before = [x for x in rows if x[0] == r.k and x[3] <= r.v]
        assert (r.s, r.n) == (sum(x[3] for x in before), sum(x[1] for x in before))


def test_quantiles(table):
    rows, df = table
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.cuts for r in ranges.quantiles(df, "x", p, ["k"]).collect()}
    for key in ("a", "b", None):
        assert got[key] == pytest.approx(np.quantile([r[2] for r in rows if r[0] == key and r[2] is not None], p))
    assert ranges.quantiles(df.filter("x < 0"), "x", p).count() == 0
    (one,) = ranges.quantiles(df.filter("id = 3").withColumn("x", F.lit(5)), "x", p).collect()
    assert one.cuts == [5.0] * 6


def test_numbers(spark, monkeypatch):
    monkeypatch.setattr(ranges, "CHUNK", 4)
    df = spark.createDataFrame([("a", 11), ("b", 0), ("c", 4)], "k string, n int")
    got = sorted((r.k, r.i) for r in ranges.numbers(df, F.col("n"), "i").collect())
    assert got == [("a", i) for i in range(1, 12)] + [("c", i) for i in range(1, 5)]


def test_counts_scales_and_splits(table):
    rows, df = table
    assert all(r.n == sum(x[0] == r.k for x in rows) for r in ranges.with_count(df, ["k"], "n").collect())
    for r in minmax_scaled(df, ["v", "x"], ["k"]).collect():
        mine = [x[2] for x in rows if x[0] == r.k and x[2] is not None]
        assert r.x_scaled == pytest.approx(0.0 if r.x is None else (r.x - min(mine)) / (max(mine) - min(mine)))
    parts = splits.nested_split(df.withColumnRenamed("x", "label"), keys=["k"]).groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 600 and len(parts) == 4
    ranks = {r.id: r.rank for r in summaries.avg_rank(df, "v").collect()}
    assert all(ranks[r[1]] == sum(x[3] < r[3] for x in rows) + (sum(x[3] == r[3] for x in rows) + 1) / 2 for r in rows)


def vectors(spark, sizes, seed=0, copies=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in sizes.items():
        base = rng.standard_normal((n, 5))
        if copies:
            base[n // 3 :] = base[0]
        rows += [(g, 10 * i, [float(v) for v in base[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "graph_id string, id long, embedding array<double>")


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_pairs(spark, monkeypatch, metric, copies):
    monkeypatch.setattr(similarity, "EXCESS", 3)
    rows, points = vectors(spark, {"g": 60, "h": 9, "one": 1}, 3, copies)
    wanted = spark.createDataFrame([("g", 100), ("h", 1000), ("one", 5)], "graph_id string, pool long")
    got = similarity.top_pairs(points, wanted, metric=metric, rows=16).collect()
    for g, pool in (("g", 100), ("h", 1000)):
        mine = [r for r in rows if r[0] == g]
        v = np.array([r[2] for r in mine])
        if metric == "cosine":
            v /= np.linalg.norm(v, axis=1)[:, None]
        pairs = []
        for i in range(len(mine)):
            for j in range(i + 1, len(mine)):
                value = float(v[i] @ v[j]) if metric == "cosine" else float(np.linalg.norm(v[i] - v[j]))
                pairs.append((round(-value if metric == "cosine" else value, 6), mine[i][1], mine[j][1]))
        pairs.sort()
        found = sorted((r.p, r.src, r.dst) for r in got if r.graph_id == g)
        assert [p for p, _, _ in found] == [*range(1, min(pool, len(pairs)) + 1)]
        if not copies or metric == "cosine":
            assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in pairs[:pool]]
    assert not [r for r in got if r.graph_id == "one"]


def test_no_group_grows_with_a_graph(spark):
    """Pairs of blocks are the groups, and no window holds a whole graph."""
    _, points = vectors(spark, {"g": 300})
    sizes = similarity._block_pairs(similarity._vectors(points, "embedding", True), 32, None).groupBy("graph_id", "low", "high").count()
    assert sizes.agg(F.max("count")).first()[0] <= 4 * 32 and sizes.count() == 55
    edges = points.select("graph_id", F.col("id").alias("src"), (F.col("id") + 10).alias("dst")).filter("dst < 3000")
    text = rewire.rewire_grid(edges, points, [0.25])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("__range_part" in line for line in windows)


def test_budgeted_knn_and_radius(spark):
    rows, points = vectors(spark, {"g": 40, "h": 25}, 5)
    edges, cutoff = similarity.radius_graph(points, 30)
    for g in ("g", "h"):
        v = np.array([r[2] for r in rows if r[0] == g])
        d = np.linalg.norm(v[:, None] - v[None], axis=2)
        short = np.sort(d[np.triu_indices(len(v), 1)])[:30]
        assert sorted(r.distance for r in edges.filter(F.col("graph_id") == g).collect()) == pytest.approx(short, abs=1e-9)
        assert cutoff.filter(F.col("graph_id") == g).first().cutoff == pytest.approx(short[-1], abs=1e-9)
    assert similarity.budgeted_knn(points, 300, False).groupBy("graph_id").count().filter("count != 300").isEmpty()
    with pytest.raises(Exception, match="fewer candidates"):
        similarity.radius_graph(points, 400)[0].collect()


def test_recall_of_sign_hashes(spark):
    """At least nine tenths of planted pairs of cosine 0.9 and more are found, and few others are compared."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.standard_normal((300, 32))
    away -= (away * base).sum(1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    s = rng.uniform(0.9, 0.95, 300)[:, None]
    both = np.concatenate((base, s * base + np.sqrt(1 - s * s) * away))
    rows = [("g", k, [float(x) for x in v]) for k, v in enumerate(both)]
    got = {(r.src, r.dst) for r in similarity.cosine_candidates(spark.createDataFrame(rows, "graph_id string, id long, embedding array<double>")).collect()}
    assert sum((k, k + 300) in got for k in range(300)) >= 270
    assert len(got) < 0.05 * 600 * 599 / 2


def test_trustworthiness_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS", 16)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((70, 6))
    rows = [("g", 3 * i, [float(x) for x in a], [float(x) for x in a[:2]]) for i, a in enumerate(v)]
    points = spark.createDataFrame(rows, "graph_id string, id long, embedding array<double>, projection array<double>")
    n, k = 70, 5
    order = lambda x: np.argsort(((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * n), axis=1, kind="stable")
    high, low = order(v), order(v[:, :2])
    late = sum(max(0, int(np.flatnonzero(high[i] == j)[0]) + 1 - k) for i in range(n) for j in low[i, :k])
    got = similarity.trustworthiness(points, k).first()
    assert (got.n, got.k) == (n, k) and got.trustworthiness == pytest.approx(1 - 2 * late / (n * k * (2 * n - 3 * k - 1)))


def test_blocks_grow_with_a_graph(spark, monkeypatch):
    """A large graph has larger blocks, made in tiles: what is sent grows with n, and neighbours, pairs and ranks stay exact."""
    for name, value in (("ROWS", 16), ("MOST", 3), ("TILE", 64)):
        monkeypatch.setattr(similarity, name, value)
    rows, points = vectors(spark, {"g": 150}, 3)
    sizes = similarity._block_pairs(similarity._vectors(points, "embedding", True), 16, None).groupBy("low", "high").count()
    assert sizes.count() == 6 and sizes.agg(F.sum("count")).first()[0] == 3 * 150
    ids, v = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    d = np.linalg.norm(v[:, None] - v[None], axis=2) + np.diag([np.inf] * len(v))
    want = {(int(ids[i]), int(ids[j])) for i in range(len(v)) for j in np.lexsort((ids, np.round(d[i], 10)))[:4]}
    assert {(r.id, r.neighbor) for r in similarity.knn(points, 4).collect()} == want
    wanted = spark.createDataFrame([("g", 70)], "graph_id string, pool long")
    best = np.sort(d[np.triu_indices(len(v), 1)])[:70]
    assert sorted(r.distance for r in similarity.top_pairs(points, wanted, metric="euclidean", rows=16).collect()) == pytest.approx(best, abs=1e-9)


def test_best_pairs_make_no_other_pairs(spark):
    from topoeval.plans import catalogue

    text = catalogue.queries()["top_candidate_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pool" in text


def test_quantiles_between_equal_values(spark):
    """A cut between two equal values is that value: a weighted sum misses some by a bit, and rows change their bin."""
    held = [round(0.01 + 0.0137 * k, 6) for k in range(60)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(held) for _ in range(7)], "key long, x double")
    cuts = {r.key: r.q for r in ranges.quantiles(df, "x", [0.1, 0.3, 0.7, 0.9], ["key"], "q").collect()}
    assert all(cuts[k] == [x] * 4 for k, x in enumerate(held))


def test_bootstrap_auc_over_ranges(spark, monkeypatch):
    """Over several ranges of scores and blocks, no draw becomes a row; intervals are those of all draws by hand."""
    from topoeval.operators import resample

    for name, value in (("SCORES", 8), ("PIECE", 5), ("BLOCKS", 3)):
        monkeypatch.setattr(resample, name, value)
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 2)), round(float(rng.random()), 1)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    sides = [np.array([p for _, y, p in rows if y == s]) for s in (0, 1)]
    auc = []
    for rep in range(1, 21):
        neg, pos = (v[resample.mixed(2 + s, rep, np.arange(len(v))) % len(v)] for s, v in enumerate(sides))
        auc.append(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
    got = resample.bootstrap_auc(df, "y", "p", "id", 20, 2).first()
    assert got.boot_mean == pytest.approx(np.mean(auc)) and got.replicates == 20
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.quantile(auc, [0.025, 0.975])))
    assert resample.bootstrap_auc(df.filter("y = 1"), "y", "p", "id", 20, 2).first().boot_mean is None


def test_average_ranks_of_values_that_differ_when_computed_again(spark):
    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    ranked = summaries.avg_rank(spark.range(200).withColumn("v", drawn()), "v").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 201))


def test_radius_graph_meets_only_crowded_points_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = np.concatenate([rng.normal(size=(150, 3)), 9 + 1e-3 * rng.normal(size=(30, 3)), np.zeros((12, 3))])
    points = spark.createDataFrame([("g", k, v.tolist()) for k, v in enumerate(at)], "graph_id string, id long, embedding array<double>")
    near, met, meet = (8, similarity.knn(points, 8)), [], similarity.top_pairs
    monkeypatch.setattr(similarity, "top_pairs", lambda points, *rest: met.append(points.count()) or meet(points, *rest))
    order = sorted((round(float(np.sqrt(((at[i] - at[j]) ** 2).sum())), 10), i, j) for i in range(len(at)) for j in range(i + 1, len(at)))
    for budget in (40, 700):
        edges, cutoff = similarity.radius_graph(points, budget, near=near)
        assert {(r.src, r.dst) for r in edges.collect()} == {(i, j) for _, i, j in order[:budget]}
        assert cutoff.first()["cutoff"] == pytest.approx(order[budget - 1][0], abs=1e-9)
    assert len(met) == 2 and met[0] == 12 and met[1] < 150


def test_constructor_controls_find_neighbours_once(spark, monkeypatch):
    from topoeval.operators import bundles

    rng = np.random.default_rng(3)
    rows = [("g", k, v.tolist(), float(v[0]), float(v[1])) for k, v in enumerate(rng.normal(size=(60, 4)))]
    points = spark.createDataFrame(rows, "graph_id string, id long, embedding array<double>, x double, y double")
    base = spark.createDataFrame([("g", k, k + j) for k in range(60) for j in (1, 2) if k + j < 60], "graph_id string, src long, dst long")
    calls, knn = [], similarity.knn
    monkeypatch.setattr(similarity, "knn", lambda *a, **b: calls.append(a[1]) or knn(*a, **b))
    made = {r["constructor"]: r["count"] for r in bundles.constructor_controls(points, base).groupBy("constructor").count().collect()}
    assert set(made.values()) == {base.count()} and len(made) == 6
    assert len(calls) == 1
