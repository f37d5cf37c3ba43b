"""Descriptor rows and bundles that join many operators by graph_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.operators import components as C
from topoeval.operators import graph as G
from topoeval.operators import linalg as L
from topoeval.operators import motifs as M
from topoeval.operators import proximity as P
from topoeval.operators import similarity as S
from topoeval.operators.perturb import degree_preserving_swap, perturb, random_edges
from topoeval.operators.summaries import assert_no_leakage

#: Columns that describe outcomes and may not enter a descriptor taken before rewiring.
OUTCOMES = ("val_f1", "test_f1", "val_acc", "test_acc", "gain", "gain_pp", "success", "selected_ratio")


def structural_metrics(canonical: DataFrame, nodes: DataFrame, sources: int = 16, pairs: int = 8, seed: int = 0, spectral_rounds: int = 60) -> DataFrame:
    """One row per graph: basic metrics, components, homophily, lambda2 and bounds, distances and resistances of samples."""
    e, v = cut(canonical), cut(nodes)
    parts = C.connected_components(e, v)
    inside = cut(C.largest_component(parts))
    some = C.sampled_nodes(inside, sources, seed)
    near = C.distance_metrics(C.bfs_distances(e, some))
    ends = C.sampled_nodes(inside, 2 * pairs, seed + 1)
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("graph_id").orderBy("id"))
    ends = ends.withColumn("k", k)
    two = ends.filter("k % 2 = 1").select("graph_id", F.floor("k").alias("j"), F.col("id").alias("u")).withColumn("j", F.expr("(j + 1) div 2"))
    two = two.join(ends.filter("k % 2 = 0").select("graph_id", F.expr("k div 2").alias("j"), F.col("id").alias("v")), ["graph_id", "j"]).drop("j")
    res = L.resistance_summary(L.effective_resistance(e, v, two))
    out = G.basic_metrics(e, v).join(C.component_summary(parts), "graph_id").join(G.edge_homophily(e, v), "graph_id", "left")
    return out.join(L.lambda2(e, v, max_rounds=spectral_rounds), "graph_id", "left").join(near, "graph_id", "left").join(res, "graph_id", "left")


def prerewiring_metrics(canonical: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """structural_metrics with clustering, assortativity, connectivity, conductance and the modularity of propagated labels;
    stops if an outcome is among the columns.
    """
    e, v = cut(canonical), cut(nodes)
    parts = cut(C.label_propagation(e, v, 5))
    out = (
        structural_metrics(e, v, **options)
        .join(M.clustering(e, v), "graph_id", "left")
        .join(M.degree_assortativity(e, v), "graph_id", "left")
        .join(L.algebraic_connectivity(e, v), "graph_id", "left")
        .join(L.sweep_conductance(e, v), "graph_id", "left")
        .join(G.modularity(e, parts), "graph_id", "left")
    )
    assert_no_leakage(out.columns, OUTCOMES)
    return out


def graph_catalog(metrics: DataFrame, design: DataFrame, key: str = "graph_id") -> DataFrame:
    """Descriptors with each graph's design parameters."""
    return metrics.join(design, key)


def mechanism_rows(conditions: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """Descriptors of one graph under several conditions, with graph_id = the condition."""
    edges = vertices = None
    for name, e in conditions.items():
        one, v = e.select(F.lit(name).alias("graph_id"), "src", "dst"), nodes.withColumn("graph_id", F.lit(name))
        edges, vertices = (one, v) if edges is None else (edges.union(one), vertices.unionByName(v))
    return G.basic_metrics(edges, vertices).join(G.edge_homophily(edges, vertices), "graph_id").join(M.clustering(edges, vertices), "graph_id")


def constructor_controls(points: DataFrame, base: DataFrame, column: str = "embedding", seed: int = 0) -> DataFrame:
    """constructor, src, dst of one graph: mutual and plain kNN, radius, MST + kNN, random, degree-preserving, each with exactly
    the base's number of edges (checked). Neighbours are found once for all of them.
    """
    budget, n = base.count(), points.count()
    few = max(8, -(-4 * budget // n))
    k = max(few, *S.budget_steps(n, budget)[:3])
    near = (k, cut(S.knn(points, k, column)))
    made = {
        "mutual_knn": S.budgeted_knn(points, budget, True, column, near),
        "knn": S.budgeted_knn(points, budget, False, column, near),
        "radius": S.radius_graph(points, budget, column, near)[0],
        "mst_knn": P.mst_knn(points, budget, near[1].filter(F.col("rank") <= few)),
        "random": random_edges(points, budget, seed),
        "degree_preserving": degree_preserving_swap(base, 0.9, seed),
    }
    out = None
    for name, e in made.items():
        one = e.select("graph_id", F.lit(name).alias("constructor"), "src", "dst")
        out = one if out is None else out.union(one)
    out = cut(out)
    if bad := [r["constructor"] for r in out.groupBy("constructor").count().collect() if r["count"] != budget]:
        raise ValueError(f"not at the budget: {bad}")
    return out


def topology_factorial(canonical: DataFrame, nodes: DataFrame, points: DataFrame, modes: Sequence[str], fractions: Sequence[float], ratios: Sequence[float], width: int, seed: int = 0) -> DataFrame:
    """mode, fraction, ratio, split, accuracy, macro_f1 of one graph: every perturbation, then every rewiring ratio on it, then
    a classifier on that topology.
    """
    from topoeval.operators.evaluate import evaluate_topology
    from topoeval.operators.rewire import rewire_grid

    out = None
    for mode in modes:
        for fraction in fractions:
            seen = cut(perturb(canonical, nodes, mode, fraction, seed))
            grid = cut(rewire_grid(seen, points, list(ratios)))
            for r in ratios:
                scores = evaluate_topology(grid.filter(F.col("ratio") == float(r)), nodes, width, seed=seed)
                one = scores.select(F.lit(mode).alias("mode"), F.lit(float(fraction)).alias("fraction"), F.lit(float(r)).alias("ratio"), "split", "accuracy", "macro_f1")
                out = one if out is None else out.union(one)
    return out
