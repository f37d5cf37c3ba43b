"""Work that has to stay bounded where graphs and tables grow: rounds, broadcasts, shuffled rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from topoeval.operators import components, graph, rewire, summaries


def ring(spark, n, graph="ring"):
    e = spark.range(n).select(F.lit(graph).alias("graph_id"), F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    return e.select("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), spark.range(n).select(F.lit(graph).alias("graph_id"), "id")


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_distances_of_long_rings(spark, monkeypatch, small):
    tables = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: tables.append(1) or cut(df))
    monkeypatch.setattr(components, "SMALL", small)
    n = 24 if small == 0 else 21_001  # more than 10 000 hops to the other side
    e, v = ring(spark, n)
    d = components.bfs_distances(e, v.filter("id in (0, 5)").union(spark.range(1).select(F.lit("alone"), F.lit(7).cast("long"))))
    got = {(r.graph_id, r.source): (r.n, r.m, r.s) for r in d.groupBy("graph_id", "source").agg(F.count("*").alias("n"), F.max("hops").alias("m"), F.sum("hops").alias("s")).collect()}
    want = (n, n // 2, n * n // 4)
    assert got == {("ring", 0): want, ("ring", 5): want, ("alone", 7): (1, 0, 0)}
    assert small == 0 or len(tables) < 10  # no round for every hop
    near = components.bfs_distances(e, v.filter("id = 3"), 2)
    assert sorted((r.id, r.hops) for r in near.collect()) == [(1, 2), (2, 1), (3, 0), (4, 1), (5, 2)]


def test_ties_of_curvature_leave_many_edges_a_round(spark):
    n = 200
    e = spark.range(n).select(F.lit("all").alias("graph_id"), F.col("id").alias("src"), F.explode(F.array(*[F.col("id") + k for k in (1, 2, 3, 4)])).alias("dst")).filter(F.col("dst") < n)
    shots = rewire.curvature_rewire(e, spark.range(n).select(F.lit("all").alias("graph_id"), "id"), 0.04, batch=16, remove_above=0.5)
    sizes = {r["round"]: r["count"] for r in shots.groupBy("round").count().collect()}
    assert max(sizes) <= 3  # 8 edges come; one a round where edges in a row win
    assert set(sizes.values()) == {e.count()} and shots.filter("src >= dst").isEmpty()


def test_the_choice_of_a_regularisation_is_one(spark, monkeypatch):
    from topoeval.operators import evaluate
    from topoeval.plans import catalogue

    asked = []
    monkeypatch.setattr(evaluate, "evaluate_topology", lambda *args, **options: asked.append((args, options)) or spark.range(1).select(F.lit(0.5).alias("accuracy"), F.lit(0.5).alias("macro_f1")))
    points = spark.range(12).select(F.lit("all").alias("graph_id"), "id", F.array(*[F.rand(k) for k in range(3)]).alias("embedding"), F.lit(0).alias("label"))
    monkeypatch.setattr(catalogue.V, "vectors", lambda s, d: points)
    catalogue.queries()["evaluate_topology"](spark, "")
    (args, options), = asked
    assert len(args) < 5 and "regs" not in options  # the default grid
    monkeypatch.undo()
    assert len(set(evaluate.evaluate_topology.__defaults__[1])) > 1
    with pytest.raises(ValueError, match="two"):
        evaluate.evaluate_topology(points, points, 3, regs=(0.1,))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_node_tables_are_shuffled(spark):
    e, v = ring(spark, 40)
    v = v.withColumns({"label": F.lit(1), "part": F.col("id") % 3})
    for df in (graph.normalize_graph(e, v)[1], graph.cut_metrics(e, v), graph.modularity(e, v), graph.edge_homophily(e, v), graph.normalized_edges(e, v)):
        assert not re.search(r"BroadcastHashJoin \[[^\]]*\b(id|src|dst)#", plan(df)), plan(df)


def test_replicates_are_not_broadcast(spark):
    rows = spark.range(60).select((F.col("id") % 5).alias("c"), (F.col("id") * 7 % 60).cast("double").alias("m"), (F.col("id") % 2).cast("double").alias("y"))
    df = summaries.avg_rank(rows, "m", ["c"])
    assert re.search(r"SortMergeJoin \[c#\w+, [^\]]*m#", plan(df)) and df.count() == 60


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_products_are_made_once_for_both_blocks(spark, monkeypatch, metric):
    from topoeval.operators import similarity

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    v[60:75] = v[3]  # copies: ties go by id
    points = spark.createDataFrame([("g", k, x.tolist()) for k, x in enumerate(v)], "graph_id string, id long, embedding array<double>")
    if metric == "cosine":
        v = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.round(1 - v @ v.T if metric == "cosine" else np.sqrt(((v[:, None] - v) ** 2).sum(-1)), 6)
    for k in (4, 40):  # 40: more than a block holds
        got = {}
        for r in similarity.knn(points, k, metric=metric, rows=20).collect():
            got.setdefault(r.id, {})[r["rank"]] = (abs(round(r.distance, 6)), r.neighbor)
        for i in range(90):
            want = sorted((abs(d[i, j]), j) for j in range(90) if j != i)[:k]
            assert [got[i][n + 1][0] for n in range(k)] == pytest.approx([w for w, _ in want], abs=2e-6)
    made = []
    monkeypatch.setattr(similarity, "_meet", lambda *a, meet=similarity._meet, **o: made.append(o) or meet(*a, **o))
    similarity.knn(points, 4, rows=20)
    assert made and not made[0].get("both")


def test_neighbours_in_the_plane_take_no_pairs(spark, monkeypatch):
    from topoeval.operators import similarity

    monkeypatch.setattr(similarity, "knn", None)
    points = spark.range(40).select(F.lit("g").alias("graph_id"), "id", F.array(*[F.rand(s) for s in range(4)]).alias("embedding"), F.array(F.rand(8), F.rand(9)).alias("projection"))
    assert similarity.trustworthiness(points, 3).count() == 1


def test_swaps_draw_what_they_need(spark, monkeypatch):
    from topoeval.functions.scalars import stable_uniform
    from topoeval.operators import perturb

    monkeypatch.setattr(perturb, "FEW", 8, raising=False)
    e, v = ring(spark, 300)
    e = e.cache()
    out = perturb.degree_preserving_swap(e, 0.05, 3)
    assert out.distinct().count() == 300 and graph.same_degree_sequence(e, out, v).first().same
    gone = e.join(out, ["graph_id", "src", "dst"], "left_anti").withColumn("u", stable_uniform(F.lit(3), F.lit(1), "src", "dst"))
    n, drawn = gone.agg(F.count("*"), F.count_if(F.col("u") < 0.075)).first()
    assert n >= 15 and drawn >= n / 2  # of the edges that the first round draws; of all edges it would be one in thirteen


def test_wedges_are_shuffled_as_arrays(spark):
    from topoeval.operators import motifs

    text = plan(motifs.all_four_cycles(*ring(spark, 12)))
    assert re.search(r"slice\(near", text) and "REPARTITION_BY_COL" in text
    assert not re.search(r"SortMergeJoin \[graph_id#\d+, u#\w+\], \[graph_id#\d+, u#\w+\]", text)  # no wedge is made before it is dealt
