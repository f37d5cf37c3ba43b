"""Closed forms and invariants on small graphs; many graphs in one table."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topoeval.operators import bundles, components, graph, linalg, motifs, perturb, proximity, rewire, similarity


def edges_of(spark, **graphs):
    rows = [(g, min(a, b), max(a, b)) for g, es in graphs.items() for a, b in es]
    return spark.createDataFrame(rows, "graph_id string, src long, dst long")


def nodes_of(spark, **sizes):
    return spark.createDataFrame([(g, k, k % 2, f"p{k // 3}") for g, n in sizes.items() for k in range(n)], "graph_id string, id long, label int, part string")


CYCLE = [(k, (k + 1) % 8) for k in range(8)]
CLIQUE = [(a, b) for a in range(5) for b in range(a)]
BRIDGE = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]


@pytest.fixture(scope="module")
def three(spark):
    return edges_of(spark, cycle=CYCLE, clique=CLIQUE, bridge=BRIDGE), nodes_of(spark, cycle=8, clique=5, bridge=7)


def as_dict(df, *cols):
    return {r.graph_id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_canonical(spark):
    raw = spark.createDataFrame([("g", 2, 1), ("g", 1, 2), ("g", 1, 1), ("g", 5, 9), ("g", None, 1)], "graph_id string, src long, dst long")
    assert [tuple(r) for r in graph.canonical_edges(raw, nodes_of(spark, g=4)).collect()] == [("g", 1, 2)]
    assert graph.symmetrize(raw.filter("src = 2")).count() == 2


def test_metrics(three):
    m = as_dict(graph.basic_metrics(*three), "n_nodes", "n_edges", "n_isolated", "density")
    assert m == {"cycle": (8, 8, 0, 2 / 7), "clique": (5, 10, 0, 1.0), "bridge": (7, 7, 1, 1 / 3)}
    assert as_dict(motifs.clustering(*three), "n_triangles", "transitivity") == {"cycle": (0, 0.0), "clique": (10, 1.0), "bridge": (2, 0.6)}
    assert as_dict(graph.edge_homophily(*three), "homophily")["cycle"] == 0.0
    assert as_dict(motifs.degree_assortativity(*three), "assortativity")["clique"] is None
    whole = three[1].withColumn("part", F.lit("one"))
    assert as_dict(graph.modularity(three[0], whole), "modularity") == pytest.approx({"cycle": 0, "clique": 0, "bridge": 0})


def test_components_and_distances(three):
    c = components.connected_components(*three)
    assert as_dict(components.component_summary(c), "n_components", "largest") == {"cycle": (1, 8), "clique": (1, 5), "bridge": (2, 6)}
    d = components.bfs_distances(three[0], three[1].filter("id = 0"))
    assert as_dict(components.distance_metrics(d), "approx_diameter") == {"cycle": 4, "clique": 1, "bridge": 3}
    parts = components.label_propagation(*three)
    assert {r.part for r in parts.filter("graph_id = 'clique'").collect()} == {next(r.part for r in parts.filter("graph_id = 'clique'").collect())}


def test_curvature(three):
    k = motifs.balanced_forman(*three).filter("graph_id = 'bridge'").collect()
    assert min(k, key=lambda r: r.curvature)[1:3] == (2, 3)


def dense(edges, n, normalized):
    """Second eigenvalue and its vector by a dense solver; isolates count as degree 1 in the normalised Laplacian."""
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    d = a.sum(1)
    safe = np.where(d > 0, d, 1)
    lap = np.eye(n) - a / np.sqrt(np.outer(safe, safe)) if normalized else np.diag(d) - a
    values, vectors = np.linalg.eigh(lap)
    return values[1], vectors[:, 1]


def test_spectra_by_steps(spark, monkeypatch):
    monkeypatch.setattr(linalg, "SMALL", 0)
    path = [(k, k + 1) for k in range(7)]
    e, n = edges_of(spark, path=path, cycle=CYCLE), nodes_of(spark, path=8, cycle=8)
    assert as_dict(linalg.lambda2(e, n), "lambda2")["cycle"] == pytest.approx(1 - math.cos(2 * math.pi / 8), abs=1e-6)
    found = {(r.graph_id, r.id): r.x for r in linalg.fiedler_vector(e, n).collect()}
    assert abs(np.array([found["path", k] for k in range(8)]) @ dense(path, 8, True)[1]) == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("basis", [1 << 25, 30 * 12])
def test_spectra(spark, three, basis, monkeypatch):
    monkeypatch.setattr(linalg, "BASIS", basis)
    e, n = three
    # a path, two cliques joined by one edge (a small gap), and two pieces
    length = 30
    path = [(k, k + 1) for k in range(length - 1)]
    barbell = [(a, b) for a in range(8) for b in range(a)] + [(a + 8, b + 8) for a in range(8) for b in range(a)] + [(0, 8)]
    pieces = [(0, 1), (1, 2), (3, 4), (4, 5)]
    e = e.union(edges_of(spark, path=path, barbell=barbell, pieces=pieces))
    n = n.union(nodes_of(spark, path=length, barbell=16, pieces=6, none=4))
    l2 = as_dict(linalg.lambda2(e, n), "lambda2")
    for name, (edges, size) in {"cycle": (CYCLE, 8), "clique": (CLIQUE, 5), "path": (path, length), "barbell": (barbell, 16)}.items():
        assert l2[name] == pytest.approx(dense(edges, size, True)[0], abs=1e-6), name
    assert l2["bridge"] == pytest.approx(dense(BRIDGE, 6, True)[0], abs=1e-6)  # its seventh node is alone
    assert l2["pieces"] == 0.0 and l2["none"] is None
    assert l2["cycle"] == pytest.approx(1 - math.cos(2 * math.pi / 8), abs=1e-6)
    some = F.col("graph_id").isin("path", "barbell", "bridge")
    ac = as_dict(linalg.algebraic_connectivity(e.filter(some), n.filter(some)), "algebraic_connectivity")
    assert ac["path"] == pytest.approx(dense(path, length, False)[0], abs=1e-6) and ac["barbell"] == pytest.approx(dense(barbell, 16, False)[0], abs=1e-6)
    assert ac["bridge"] == 0.0
    early = linalg.lambda2(e.filter("graph_id = 'path'"), n.filter("graph_id = 'path'"), max_rounds=3)
    assert early.first().lambda2 is None  # not converged is not a value
    x = linalg.fiedler_vector(e.filter("graph_id = 'path'"), n.filter("graph_id = 'path'"))
    found = np.array([r.x for r in x.orderBy("id").collect()])
    assert abs(found @ dense(path, length, True)[1]) == pytest.approx(1.0, abs=1e-6)
    assert as_dict(linalg.sweep_conductance(e.filter("graph_id = 'path'"), n.filter("graph_id = 'path'"), x), "conductance")["path"] == pytest.approx(1 / (2 * (length // 2) - 1))


def test_resistances(three):
    e, n = three
    pairs = e.filter("graph_id = 'bridge'").select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    r = linalg.effective_resistance(e.filter("graph_id = 'bridge'"), n.filter("graph_id = 'bridge'"), pairs, 1e-9, 30)
    assert r.agg(F.sum("resistance")).first()[0] == pytest.approx(5.0)  # six nodes connected
    assert r.filter("u = 2 and v = 3").first().resistance == pytest.approx(1.0)


def forman(u, v, edges):
    near = lambda x: {b for a, b in edges if a == x} | {a for a, b in edges if b == x}
    nu, nv = near(u), near(v)
    if min(len(nu), len(nv)) <= 1:
        return 0.0
    left, right, t, high = nu - {v} - nv, nv - {u} - nu, len(nu & nv), max(len(nu), len(nv))
    through = [sum(b in near(a) for b in right) for a in left] + [sum(a in near(b) for a in left) for b in right]
    last = sum(x > 0 for x in through) / (max(through) * high) if any(through) else 0.0
    return 2 / len(nu) + 2 / len(nv) - 2 + 2 * t / high + t / min(len(nu), len(nv)) + last


def test_curvature_gains(spark):
    import random

    from topoeval.functions.lineage import cut
    from topoeval.operators.graph import both_ways

    r = random.Random(3)
    edges = {(min(a, b), max(a, b)) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(40)) if a != b}
    near = lambda x: {b for a, b in edges if a == x} | {a for a, b in edges if b == x}
    want = {}
    for u, v in edges:
        for a in near(u):
            for b in near(v):
                x = (min(a, b), max(a, b))
                if a != b and x not in edges:
                    want[u, v, *x] = forman(u, v, edges | {x}) - forman(u, v, edges)
    e = edges_of(spark, g=sorted(edges))
    worst = cut(e.select("graph_id", F.monotonically_increasing_id().alias("r"), F.col("src").alias("u"), F.col("dst").alias("v")))
    pairs = both_ways(e)
    degree = pairs.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("d"))
    got = rewire._curvature_gains(worst, pairs, degree).join(worst, ["graph_id", "r"]).collect()
    assert {(x.u, x.v, x.src, x.dst): x.gain for x in got} == pytest.approx(want)
    assert as_dict_edges(motifs.balanced_forman(e, nodes_of(spark, g=14))) == pytest.approx({k: forman(*k, edges) for k in edges})


def as_dict_edges(df):
    return {(x.src, x.dst): x.curvature for x in df.collect()}


def test_swaps(spark):
    cycle = [(k, (k + 1) % 60) for k in range(60)]
    e, n = edges_of(spark, g=cycle, h=cycle[:20]), nodes_of(spark, g=60, h=60)
    out = perturb.degree_preserving_swap(e, 0.9, 1)
    assert as_dict(graph.same_degree_sequence(e, out, n), "same") == {"g": True, "h": True}
    assert {r.graph_id: r["count"] for r in out.groupBy("graph_id").count().collect()} == {"g": 60, "h": 20}
    diff = graph.edge_set_diff(graph.canonical_edges(e), out)
    assert all(r.n_clean - r.n_both >= 0.9 * r.n_clean for r in diff.collect())
    with pytest.raises(ValueError):
        perturb.degree_preserving_swap(edges_of(spark, g=CLIQUE), 0.5, max_idle=2)  # a clique has no swap


def test_points(spark):
    import random

    r = random.Random(42)
    pts = spark.createDataFrame([("g", k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(30)], "graph_id string, id long, x double, y double")
    sets = {n: {(e.src, e.dst) for e in f(pts).collect()} for n, f in proximity.CONSTRUCTORS.items()}
    assert sets["mst"] <= sets["rng"] <= sets["gabriel"] <= sets["delaunay"] and len(sets["mst"]) == 29
    near = {(e.src, e.dst) for e in proximity.gabriel_graph(pts, 10.0).collect()}
    assert near == sets["gabriel"]
    with pytest.raises(ValueError):
        proximity.proximity_graphs(pts, ("other",))


@pytest.fixture(scope="module")
def points(spark):
    import random

    r = random.Random(1)
    return spark.createDataFrame([("g", k, [r.gauss(0, 1) for _ in range(4)]) for k in range(24)], "graph_id string, id long, embedding array<double>")


def test_similarity_graphs(spark, points):
    base = similarity.knn_edges(similarity.knn(points, 3)).select("graph_id", "src", "dst")
    assert similarity.pairwise_cosine(points).count() == 24 * 23 // 2
    for mutual in (True, False):
        assert similarity.budgeted_knn(points, 20, mutual).count() == 20
    with pytest.raises(ValueError):
        similarity.budgeted_knn(points, 1000)
    controls = bundles.constructor_controls(points.withColumns({"x": F.col("embedding")[0], "y": F.col("embedding")[1]}), base)
    assert controls.select("constructor").distinct().count() == 6
    exact = {(r.src, r.dst) for r in similarity.pairwise_cosine(points, 0.9).collect()}
    found = {(r.src, r.dst) for r in similarity.cosine_candidates(points, 3, 12).filter("sim >= 0.9").collect()}
    assert found <= exact and len(found) >= 0.8 * len(exact)


def test_rewiring(spark, points):
    base = similarity.knn_edges(similarity.knn(points, 3)).select("graph_id", "src", "dst")
    m = base.count()
    out = rewire.rewire_by_similarity(base, points, 0.25)
    assert out.count() == m and out.filter("added").count() == m // 4 and out.select("src", "dst").distinct().count() == m
    assert rewire.rewire_by_similarity(base, points, 0.0).exceptAll(base.withColumn("added", F.lit(False))).isEmpty()
    with pytest.raises(ValueError):
        rewire.rewire_by_similarity(base, points, 1.5)
    c = linalg.resistance_coordinates(base, points, 8, rounds=20)
    hybrid = rewire.rewire_hybrid(base, points, c, 0.25)
    assert hybrid.count() == m
    shots = rewire.curvature_rewire(base, points, 0.2, batch=2)
    last = shots.agg(F.max("round")).first()[0]
    assert shots.filter(F.col("round") == last).count() == m + round(24 * 0.2)


def test_perturbation(spark):
    cycle = [(k, (k + 1) % 20) for k in range(20)] + [(k, k + 2) for k in range(18)]
    e = edges_of(spark, g=cycle)
    n = spark.createDataFrame([("g", k, int(k >= 10)) for k in range(20)], "graph_id string, id long, label int")
    for mode in ("degree_preserving", "homophily", "random"):
        out = perturb.perturb(e, n, mode, 0.25, 7)
        r = perturb.perturbation_report(e, out, n).first()
        assert r.n_clean == r.n_observed == 38 and r.changed_fraction > 0
        if mode == "degree_preserving":
            assert r.same_degrees
        if mode == "homophily":
            assert r.homophily_after < r.homophily_before
    with pytest.raises(ValueError):
        perturb.perturb(e, n, "other", 0.1)
    with pytest.raises(ValueError):
        perturb.random_edges(n, 1000)


def test_descriptor(three):
    m = bundles.structural_metrics(*three, sources=4, pairs=2)
    assert {r.graph_id for r in m.collect()} == {"cycle", "clique", "bridge"}


def test_anchors_and_blends(spark, points):
    w = similarity.anchor_similarity(points, 6, 3)
    total = [r[0] for r in w.groupBy("id").agg(F.round(F.sum("weight"), 9)).select(F.col("round(sum(weight), 9)")).collect()]
    assert set(total) <= {0.0, 1.0}
    ones = points.select("graph_id", "id", F.lit(1.0).alias("value"))
    assert all(0 <= r.value <= 1.000001 for r in similarity.anchor_propagate(w, ones).collect())
    a = spark.createDataFrame([("g", 1, 2, 1.0)], "graph_id string, src long, dst long, weight double")
    b = spark.createDataFrame([("g", 1, 2, 0.5), ("g", 2, 3, 1.0)], a.schema)
    assert {(r.src, r.dst): r.weight for r in similarity.blend_edges(a, b, 0.8).collect()} == pytest.approx({(1, 2): 0.9, (2, 3): 0.2})


def test_long_rings(spark):
    """Rings of 500 nodes in closed form: gaps of some 1e-4 need more than steps with the matrix, and every edge is a pair."""
    n = 500
    e, v = edges_of(spark, ring=[(k, k + 1) for k in range(n - 1)] + [(0, n - 1)]), nodes_of(spark, ring=n)
    assert as_dict(linalg.lambda2(e, v, max_rounds=60), "lambda2")["ring"] == pytest.approx(1 - math.cos(2 * math.pi / n), rel=1e-8)
    assert as_dict(linalg.algebraic_connectivity(e, v), "algebraic_connectivity")["ring"] == pytest.approx(2 - 2 * math.cos(2 * math.pi / n), rel=1e-8)
    assert as_dict(linalg.sweep_conductance(e, v), "conductance")["ring"] == pytest.approx(2 / n)
    r = linalg.effective_resistance(e, v, e.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")))
    assert [x.resistance for x in r.collect()] == pytest.approx([(n - 1) / n] * n, rel=1e-9)


def test_spectra_of_pieces(spark):
    """Components are told apart without a step; the sweep over their vector cuts nothing. Dense graphs go by gradients."""
    pieces = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (6, 7)]
    e, v = edges_of(spark, pieces=pieces), nodes_of(spark, pieces=9)
    x = {r.id: r.x for r in linalg.fiedler_vector(e, v, max_rounds=1).collect()}
    degree = np.array([2, 2, 2, 1, 2, 1, 1, 1, 0])
    at = np.array([x[k] for k in range(9)])
    assert at @ at == pytest.approx(1.0) and at @ np.sqrt(degree) == pytest.approx(0.0, abs=1e-12) and x[8] == 0
    assert as_dict(linalg.sweep_conductance(e, v, linalg.fiedler_vector(e, v, max_rounds=1)), "conductance")["pieces"] == 0.0
    size = 40
    e, v = edges_of(spark, clique=[(a, b) for a in range(size) for b in range(a)]), nodes_of(spark, clique=size)
    r = linalg.effective_resistance(e, v, e.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")))
    assert [x.resistance for x in r.collect()] == pytest.approx([2 / size] * (size * (size - 1) // 2), rel=1e-6)


def test_squares_of_all_edges(spark):
    """Counted from pairs with common neighbours, no path of three edges is made; the same ends as edge by edge."""
    rng = np.random.default_rng(3)
    edges = sorted({tuple(sorted(map(int, rng.choice(14, 2, replace=False)))) for _ in range(40)})
    e, v = edges_of(spark, g=edges, cycle=CYCLE, clique=CLIQUE), nodes_of(spark, g=14, cycle=8, clique=5)
    pairs = e.union(e.select("graph_id", "dst", "src"))
    want = motifs.four_cycles(pairs.toDF("graph_id", "u", "v"), pairs).select("graph_id", "u", "v", "a", "through")
    assert sorted(map(tuple, motifs.all_four_cycles(e, v).collect())) == sorted(map(tuple, want.collect()))


def test_components_contract(spark, monkeypatch):
    """Edges within a component are not met again: a long chain and a star are done in one round, numbers falling or not."""
    made = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(df) or real(df))
    chain = [(k, k + 1) for k in range(40)]
    e, v = edges_of(spark, chain=chain, star=[(0, k) for k in range(1, 30)], two=[(0, 5), (1, 3), (3, 5), (2, 4)]), nodes_of(spark, chain=41, star=30, two=7)
    got = {(r.graph_id, r.id): r.component for r in components.connected_components(e, v).collect()}
    assert all(got["chain", k] == 0 for k in range(41)) and all(got["star", k] == 0 for k in range(30))
    assert [got["two", k] for k in range(7)] == [0, 0, 2, 0, 2, 0, 6]
    assert sum({"src", "dst"} <= set(df.columns) for df in made) <= 3


def test_swaps_start_from_written_edges(spark):
    """What comes out no longer hangs on the tables that the edges are made of, which would be joined again for each use."""
    from topoeval.plans import catalogue

    for name in ("degree_preserving_swap", "swap_invariants", "random_rewire_counts"):
        out = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert out.inputFiles() and not [f for f in out.inputFiles() if "lineitem" in f]


def test_no_node_or_edge_table_goes_through_the_driver(spark, three):
    """Joins by node or edge are shuffled even where both sides look small: a round of them would send each through the driver."""
    edges, nodes = three
    weighted = graph.both_ways(edges).withColumn("weight", F.lit(1.0))
    for out in (motifs.balanced_forman(edges, nodes), linalg.spmv(weighted, nodes.select("graph_id", "id", F.lit(1.0).alias("x"))), graph.degrees(edges, nodes)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Broadcast" not in text


def test_knn_of_the_plane(spark):
    """Every neighbour is that of all pairs, in skewed sets over several tiles, with copies and outliers, and few pairs are looked at."""
    rng = np.random.default_rng(5)
    sets = {"even": rng.uniform(0, 1, (900, 2)), "skewed": np.exp(rng.normal(0, 2, (700, 2))), "copies": np.repeat(rng.normal(0, 1, (110, 2)), 5, axis=0), "two": np.array([[0.0, 0.0], [3.0, 4.0]])}
    rows = [(g, 10 * i, float(x), float(y)) for g, v in sets.items() for i, (x, y) in enumerate(v)]
    got = similarity.knn_plane(spark.createDataFrame(rows, "graph_id string, id long, x double, y double"), 3).collect()
    for g, v in sets.items():
        d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 10)
        np.fill_diagonal(d, np.inf)
        want = {(10 * i, r + 1): (10 * int(j), d[i, j]) for i in range(len(v)) for r, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[: min(3, len(v) - 1)])}
        assert {(r.id, r["rank"]): (r.neighbor, r.distance) for r in got if r.graph_id == g} == want
