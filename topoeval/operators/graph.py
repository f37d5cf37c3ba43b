"""Edge tables: edges(graph_id, src, dst), nodes(graph_id, id, ...).

Every operator works on many graphs at once, keyed by graph_id. Canonical edges have src < dst, no loops
and no repetitions; directed edges hold both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoeval.functions.joins import shuffled

KEY = ["graph_id", "src", "dst"]


def canonical_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct undirected edges, src < dst, without loops; with nodes: both ends must be nodes.

    Edges with a null end go.
    """
    out = edges.filter("src != dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    out = out.distinct()
    if nodes is not None:
        for end in ("src", "dst"):
            out = out.join(shuffled(nodes.select("graph_id", F.col("id").alias(end)).distinct()), ["graph_id", end], "left_semi")
    return out.select(KEY)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select(KEY).union(edges.select("graph_id", "dst", "src")).distinct()


def both_ways(canonical: DataFrame) -> DataFrame:
    """Both directions of canonical edges: no shuffle, as nothing can repeat."""
    return canonical.select(KEY).union(canonical.select("graph_id", F.col("dst"), F.col("src")))


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select(KEY).union(nodes.select("graph_id", "id", "id")).distinct()


def degrees(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, id, degree of every node, isolated ones included."""
    counted = both_ways(canonical).groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("graph_id", "id").distinct().join(shuffled(counted), ["graph_id", "id"], "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0)).cast("long")
    )


def degree_features(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """features: degree, log1p(degree), is isolated; for graphs that have none."""
    d = F.col("degree")
    return degrees(canonical, nodes).select(
        "graph_id", "id", F.array(d.cast("double"), F.log1p(d), (d == 0).cast("double")).alias("features")
    )


def degree_histogram(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(canonical, nodes).groupBy("graph_id", "degree").agg(F.count("*").alias("n_nodes"))


def same_degree_sequence(one: DataFrame, other: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, same: do both edge tables have equal degree sequences?"""
    a = degree_histogram(one, nodes).withColumnRenamed("n_nodes", "a")
    b = degree_histogram(other, nodes).withColumnRenamed("n_nodes", "b")
    return a.join(b, ["graph_id", "degree"], "full").groupBy("graph_id").agg(
        F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same")
    )


def normalize_graph(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directed edges without loops, and nodes with features (of degree where there are none).

    Labels must not be null: a null one stops the query that reads it.
    """
    canonical = canonical_edges(edges, nodes)
    label = F.when(F.col("label").isNotNull(), F.col("label")).otherwise(F.raise_error(F.lit("a node has no label")).cast("int"))
    out = nodes.withColumn("label", label)
    if "features" not in nodes.columns:
        out = out.join(shuffled(degree_features(canonical, nodes)), ["graph_id", "id"])
    return both_ways(canonical), out


def basic_metrics(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph: n_nodes, n_edges, density, degree average, deviation (population), variation, variance, maximum, isolates."""
    by_graph = degrees(canonical, nodes).groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.avg("degree").alias("degree_avg"),
        F.stddev_pop("degree").alias("degree_std"),
        F.var_pop("degree").alias("degree_var"),
        F.max("degree").alias("degree_max"),
        F.count_if(F.col("degree") == 0).alias("n_isolated"),
    )
    n = F.col("n_nodes")
    return by_graph.select(
        "*",
        F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
        F.when(F.col("degree_avg") > 0, F.col("degree_std") / F.col("degree_avg")).alias("degree_cv"),
    )


def labelled_edges(canonical: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """The edges with src_label and dst_label."""
    names = nodes.select("graph_id", "id", label)
    return canonical.join(shuffled(names.toDF("graph_id", "src", "src_label")), ["graph_id", "src"]).join(
        shuffled(names.toDF("graph_id", "dst", "dst_label")), ["graph_id", "dst"]
    )


def edge_homophily(canonical: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """Share of edges whose ends have equal labels; NULL for graphs without edges."""
    share = labelled_edges(canonical, nodes, label).groupBy("graph_id").agg(
        F.avg((F.col("src_label") == F.col("dst_label")).cast("double")).alias("homophily")
    )
    return nodes.select("graph_id").distinct().join(share, "graph_id", "left")


def edge_union(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.select(KEY).union(other.select(KEY)).distinct()


def edge_set_diff(clean: DataFrame, observed: DataFrame) -> DataFrame:
    """Per graph, of two canonical edge tables: n_clean, n_observed, n_both, n_any, jaccard and
    changed_fraction = |symmetric difference| / max(2 |clean|, 1).
    """
    both = clean.select(*KEY, F.lit(1).alias("c")).join(observed.select(*KEY, F.lit(1).alias("o")), KEY, "full")
    c, o = F.col("c").isNotNull(), F.col("o").isNotNull()
    out = both.groupBy("graph_id").agg(
        F.count_if(c).alias("n_clean"), F.count_if(o).alias("n_observed"), F.count_if(c & o).alias("n_both"), F.count("*").alias("n_any")
    )
    return out.withColumns(
        {
            "jaccard": F.col("n_both") / F.greatest("n_any", F.lit(1)),
            "changed_fraction": (F.col("n_any") - F.col("n_both")) / F.greatest(2 * F.col("n_clean"), F.lit(1)),
        }
    )


def cut_metrics(canonical: DataFrame, nodes: DataFrame, part: str = "part") -> DataFrame:
    """Per graph and part: volume (degree sum), inner and cut edges, and the least degree of its nodes,
    which bounds the edge connectivity from above.
    """
    ends = labelled_edges(canonical, nodes, part)
    sides = ends.select("graph_id", F.col("src_label").alias("part"), (F.col("src_label") != F.col("dst_label")).alias("cut")).union(
        ends.select("graph_id", "dst_label", F.col("src_label") != F.col("dst_label"))
    )
    edge_side = sides.groupBy("graph_id", "part").agg(
        F.count("*").alias("volume"), F.count_if("cut").alias("cut_edges"), (F.count_if(~F.col("cut")) / 2).cast("long").alias("inner_edges")
    )
    least = degrees(canonical, nodes).join(shuffled(nodes.select("graph_id", "id", F.col(part).alias("part"))), ["graph_id", "id"])
    least = least.groupBy("graph_id", "part").agg(F.min("degree").alias("min_degree"), F.count("*").alias("n_nodes"))
    return least.join(shuffled(edge_side), ["graph_id", "part"], "left").na.fill(0, ["volume", "cut_edges", "inner_edges"])


def modularity(canonical: DataFrame, nodes: DataFrame, part: str = "part") -> DataFrame:
    """Sum over parts of inner/m - (volume/2m)**2; NULL for graphs without edges."""
    m = canonical.groupBy("graph_id").agg(F.count("*").alias("m"))
    by_part = cut_metrics(canonical, nodes, part).join(m, "graph_id")
    q = F.col("inner_edges") / F.col("m") - F.pow(F.col("volume") / (2 * F.col("m")), 2)
    return by_part.groupBy("graph_id").agg(F.sum(q).alias("modularity"), F.count("*").alias("n_parts"))


def normalized_edges(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges with loops and weight 1/sqrt(d_u d_v), degrees counting the loop."""
    loops = add_self_loops(both_ways(canonical), nodes)
    d = loops.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("d"))
    return loops.join(shuffled(d.toDF("graph_id", "src", "ds")), ["graph_id", "src"]).join(shuffled(d.toDF("graph_id", "dst", "dd")), ["graph_id", "dst"]).select(
        *KEY, (1 / F.sqrt(F.col("ds") * F.col("dd"))).alias("weight")
    )
