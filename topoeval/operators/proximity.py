"""Proximity graphs of points in the plane: points(graph_id, id, x, y).

Gabriel and relative-neighbourhood graphs are subgraphs of the Delaunay triangulation, an edge of which has an empty
circle; the pairs whose Voronoi cells touch are the candidates for all of them. Emptiness tests are equi-joins on cells of
a grid with a residual predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.operators.voronoi import candidate_pairs

EPS = 2.220446049250313e-16


def _scaled(points: DataFrame, per_cell: float) -> DataFrame:
    """points with tol (64 eps times the range, at least 64 eps) and the width of a grid cell."""
    size = points.groupBy("graph_id").agg(
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n")
    )
    size = size.select(
        "graph_id",
        (F.lit(64 * EPS) * F.greatest("span", F.lit(1.0))).alias("tol"),
        F.when(F.col("span") > 0, F.col("span") * F.sqrt(F.lit(per_cell) / F.col("n"))).otherwise(1.0).alias("cell"),
    )
    return points.select("graph_id", "id", "x", "y").join(size, "graph_id")


def near_pairs(points: DataFrame, max_radius: float | None = None) -> DataFrame:
    """graph_id, u < v with coordinates and distance d of the pairs of points whose Voronoi cells touch, no longer than
    max_radius if that is given.
    """
    p = _scaled(points, 4.0)
    a = p.select("graph_id", "tol", "cell", F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = p.select("graph_id", F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    d = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    pairs = candidate_pairs(points).join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"]).withColumn("d", d)
    return cut(pairs if max_radius is None else pairs.filter(F.col("d") <= max_radius))


def _without_point(pairs: DataFrame, points: DataFrame, x: Column, y: Column, radius: Column, inside: Column) -> DataFrame:
    """Pairs with no third point (w, wx, wy) for which ``inside`` holds; such points are within radius of (x, y).

    A disk that spans a few cells is looked up cell by cell; a larger one could touch most cells, so it is
    first tested against a coarser grid in which it spans a few.
    """
    box = pairs.withColumns({"__x": x, "__y": y, "__r": radius})
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("__r") / F.col("cell"), F.lit(1e-9))))).cast("int")
    box = box.withColumn("level", level).withColumn("side", F.col("cell") * F.pow(F.lit(2.0), F.col("level")))
    levels = box.select("graph_id", "level").distinct()
    sites = _scaled(points, 4.0).select("graph_id", "cell", F.col("id").alias("w"), F.col("x").alias("wx"), F.col("y").alias("wy"))
    sites = sites.join(levels, "graph_id").withColumn("wside", F.col("cell") * F.pow(F.lit(2.0), F.col("level"))).withColumns(
        {"cx": F.floor(F.col("wx") / F.col("wside")), "cy": F.floor(F.col("wy") / F.col("wside"))}
    )
    cells = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("__r")) / F.col("side")), F.floor((F.col(c) + F.col("__r")) / F.col("side"))))
    asked = box.withColumn("cx", cells("__x")).withColumn("cy", cells("__y"))
    hit = asked.join(sites.drop("cell", "wside"), ["graph_id", "level", "cx", "cy"]).filter((F.col("w") != F.col("u")) & (F.col("w") != F.col("v")) & inside)
    return pairs.join(hit.select("graph_id", "u", "v").distinct(), ["graph_id", "u", "v"], "left_anti")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"), F.col("d").alias("weight"))


def gabriel_graph(points: DataFrame, max_radius: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Edges whose diametral disk holds no other point (strictly, beyond the tolerance)."""
    pairs = near_pairs(points, max_radius) if pairs is None else pairs
    mx, my = (F.col("ux") + F.col("vx")) / 2, (F.col("uy") + F.col("vy")) / 2
    away = F.sqrt(F.pow(F.col("wx") - mx, 2) + F.pow(F.col("wy") - my, 2))
    return _edges(_without_point(pairs, points, mx, my, F.col("d") / 2, away < F.col("d") / 2 - F.col("tol")))


def rng_graph(points: DataFrame, max_radius: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Edges for which no other point is nearer to both ends than they are to each other."""
    pairs = near_pairs(points, max_radius) if pairs is None else pairs
    mx, my = (F.col("ux") + F.col("vx")) / 2, (F.col("uy") + F.col("vy")) / 2
    du = F.sqrt(F.pow(F.col("wx") - F.col("ux"), 2) + F.pow(F.col("wy") - F.col("uy"), 2))
    dv = F.sqrt(F.pow(F.col("wx") - F.col("vx"), 2) + F.pow(F.col("wy") - F.col("vy"), 2))
    return _edges(_without_point(pairs, points, mx, my, F.col("d") * 0.87, F.greatest(du, dv) < F.col("d") - F.col("tol")))


def delaunay_edges(points: DataFrame, max_radius: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Edges with an empty circle through both ends. Every third point bounds the circle's centre on the bisector from one
    side; the edge is Delaunay if the bounds leave room, and the ends' own partners are all the points that can bound it.
    Cocircular points keep all their edges (a triangulation would pick some).
    """
    every = near_pairs(points) if pairs is None else pairs
    pairs = every if max_radius is None else every.filter(F.col("d") <= max_radius)
    partner = every.select("graph_id", "u", F.col("v").alias("w"), F.col("vx").alias("wx"), F.col("vy").alias("wy"))
    partner = partner.union(every.select("graph_id", "v", "u", "ux", "uy"))
    third = pairs.join(partner, ["graph_id", "u"]).unionByName(pairs.join(partner.withColumnRenamed("u", "v"), ["graph_id", "v"])).filter("w != u and w != v")
    ex, ey = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    mx, my = (F.col("ux") + F.col("vx")) / 2, (F.col("uy") + F.col("vy")) / 2
    # centre m + t * n with n the left normal of u -> v; w is outside iff t * side <= power / 2 ...
    wx, wy = F.col("wx") - mx, F.col("wy") - my
    side = wy * ex - wx * ey
    power = wx * wx + wy * wy - F.col("d") * F.col("d") / 4
    bound = power / (2 * side)
    eps = F.lit(1e-12) * F.col("d") * F.col("d")
    limits = third.groupBy("graph_id", "u", "v", "d").agg(
        F.min(F.when(side > eps, bound)).alias("high"),
        F.max(F.when(side < -eps, bound)).alias("low"),
        F.bool_or((F.abs(side) <= eps) & (power < 0)).alias("between"),
    )
    slack = F.lit(1e-12)
    good = limits.filter(~F.coalesce("between", F.lit(False)) & (F.coalesce(F.col("low") <= F.col("high") + slack, F.lit(True))))
    alone = pairs.join(third.select("graph_id", "u", "v").distinct(), ["graph_id", "u", "v"], "left_anti")
    return _edges(good.select("graph_id", "u", "v", "d").union(alone.select("graph_id", "u", "v", "d")))


def minimum_spanning_forest(weighted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Boruvka rounds over edges (graph_id, src, dst, weight): each component takes its least edge by (weight, src, dst) and
    points to the component at its other end; of two that point to each other the lesser is the root, and pointers jump to
    roots. The order of edges is total, so there are no other cycles and the forest is unique.
    """
    open_ = cut(weighted.select("graph_id", "src", "dst", "weight", F.col("src").alias("cs"), F.col("dst").alias("cd")).filter("src != dst"))
    taken = None
    key = ["graph_id", "c"]
    while not open_.isEmpty():
        e = F.struct("weight", "src", "dst")
        ends = open_.select("graph_id", F.col("cs").alias("c"), F.col("cd").alias("up"), e.alias("e"))
        ends = ends.union(open_.select("graph_id", "cd", "cs", e))
        best = cut(ends.groupBy(key).agg(F.min(F.struct("e", "up")).alias("m")).select(*key, F.col("m.up").alias("up"), "m.e"))
        won = best.select("graph_id", "e.src", "e.dst", "e.weight").distinct()
        taken = won if taken is None else taken.union(won)
        back = best.select("graph_id", F.col("c").alias("up"), F.col("up").alias("over"))
        pair = (F.col("over") == F.col("c")) & (F.col("c") < F.col("up"))
        up = cut(best.join(back, ["graph_id", "up"]).select(*key, F.when(pair, F.col("c")).otherwise(F.col("up")).alias("up")))
        while True:
            far = up.select("graph_id", F.col("c").alias("up"), F.col("up").alias("far"))
            new = cut(up.join(far, ["graph_id", "up"]).select(*key, F.col("up").alias("old"), F.col("far").alias("up")))
            up, moved = new.select(*key, "up"), not new.filter("old != up").isEmpty()
            if not moved:
                break
        named = open_.join(up.toDF("graph_id", "cs", "rs"), ["graph_id", "cs"]).join(up.toDF("graph_id", "cd", "rd"), ["graph_id", "cd"])
        open_ = cut(named.filter("rs != rd").select("graph_id", "src", "dst", "weight", F.col("rs").alias("cs"), F.col("rd").alias("cd")))
    return weighted.select("graph_id", "src", "dst", "weight").limit(0) if taken is None else taken


def euclidean_mst(points: DataFrame, max_radius: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Minimum spanning tree: a subgraph of the relative-neighbourhood graph, whose edges are its candidates."""
    return minimum_spanning_forest(rng_graph(points, max_radius, pairs), points)


def mst_knn(points: DataFrame, budget: int, neighbors: DataFrame) -> DataFrame:
    """The spanning tree's edges and then the shortest neighbour edges up to the budget."""
    from topoeval.operators.similarity import knn_edges, take_budget

    tree = euclidean_mst(points).select("graph_id", "src", "dst", F.col("weight").alias("distance"), F.lit(0).alias("kind"))
    more = knn_edges(neighbors).select("graph_id", "src", "dst", "distance", F.lit(1).alias("kind"))
    both = tree.union(more.join(tree, ["graph_id", "src", "dst"], "left_anti"))
    return take_budget(both, budget, ("kind", "distance", "src", "dst"))


CONSTRUCTORS = {"mst": euclidean_mst, "rng": rng_graph, "gabriel": gabriel_graph, "delaunay": delaunay_edges}


def proximity_graphs(points: DataFrame, constructors: tuple[str, ...] = tuple(CONSTRUCTORS)) -> DataFrame:
    """graph_id, constructor, src, dst, weight of each named constructor, all from one table of candidate pairs."""
    if unknown := set(constructors) - CONSTRUCTORS.keys():
        raise ValueError(f"unknown constructors: {sorted(unknown)}")
    out, pairs = None, near_pairs(points)
    for name in constructors:
        one = CONSTRUCTORS[name](points, pairs=pairs).select("graph_id", F.lit(name).alias("constructor"), "src", "dst", "weight")
        out = one if out is None else out.unionByName(one)
    return out


def proximity_summary(graphs: DataFrame, points: DataFrame) -> DataFrame:
    n = points.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    m = graphs.groupBy("graph_id", "constructor").agg(F.count("*").alias("n_edges"))
    size = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return m.join(n, "graph_id").withColumns({"density": F.col("n_edges") / F.greatest(size, F.lit(1)), "derived": F.col("constructor") != "delaunay"})
