"""Components, distances and communities: iterative rounds of joins, each cut by a checkpoint."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.joins import shuffled
from topoeval.functions.lineage import cut
from topoeval.operators.graph import both_ways

#: Directed edges of a graph that one task searches, and of all searches of a task together, at most.
SMALL, SEARCHED = 1 << 20, 1 << 24


def connected_components(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, id, component (the least node of it): nodes hook to their least neighbour, chains of hooks are followed to their
    ends by pointer jumping, and edges are contracted to these ends.

    At least half of the nodes with edges go in a round, and edges within one end are not read again.
    """
    labels = cut(nodes.select("graph_id", "id", F.col("id").alias("component")).distinct())
    there = lambda df, end: df.join(shuffled(labels.select("graph_id", F.col("id").alias(end))), ["graph_id", end], "left_semi")
    ends = canonical.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = cut(there(there(ends.filter("src < dst").distinct(), "src"), "dst"))
    while not edges.isEmpty():
        near = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("next")), F.struct(F.col("dst").alias("id"), F.col("src").alias("next"))))
        hooks = edges.select("graph_id", near.alias("s")).groupBy("graph_id", "s.id").agg(F.min("s.next").alias("next"))
        hooks = cut(hooks.select("graph_id", "id", F.least("id", "next").alias("next")))
        while True:
            far = hooks.select("graph_id", F.col("id").alias("next"), F.col("next").alias("far"))
            jumped = cut(hooks.join(shuffled(far), ["graph_id", "next"]).select("graph_id", "id", F.col("next").alias("old"), F.col("far").alias("next")))
            hooks, moved = jumped.select("graph_id", "id", "next"), not jumped.filter("old != next").isEmpty()
            if not moved:
                break
        to = hooks.withColumnRenamed("id", "component")
        labels = cut(labels.join(shuffled(to), ["graph_id", "component"], "left").select("graph_id", "id", F.coalesce("next", "component").alias("component")))
        for end in ("src", "dst"):
            edges = edges.join(shuffled(hooks.toDF("graph_id", end, f"{end}_to")), ["graph_id", end])
        one, two = F.least("src_to", "dst_to"), F.greatest("src_to", "dst_to")
        edges = cut(edges.filter("src_to != dst_to").select("graph_id", one.alias("src"), two.alias("dst")).distinct())
    return labels


def component_summary(components: DataFrame) -> DataFrame:
    """Per graph: n_components, largest, largest_ratio."""
    size = components.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    return size.groupBy("graph_id").agg(
        F.count("*").alias("n_components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("largest_ratio")
    )


def largest_component(components: DataFrame) -> DataFrame:
    """The nodes of each graph's largest component (ties: the one with the least node)."""
    size = components.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    top = size.groupBy("graph_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return components.join(top, ["graph_id", "component"]).select("graph_id", "id")


def _searches(max_hops: int | None):
    """A group function: distances from some sources (rows without ``dst``) of one graph of bounded size, whose directed edges are
    the other rows. The frontiers of all sources advance together.
    """

    def search(key: tuple, table: pa.Table) -> pa.Table:
        source = table.column("dst").is_null().to_numpy()
        names, at = np.unique(np.concatenate([table.column("src").to_numpy(), table.column("dst").drop_null().to_numpy()]), return_inverse=True)
        src, dst, n = at[: len(source)], at[len(source) :], len(names)
        starts, src = src[source], src[~source]
        order = np.argsort(src, kind="stable")
        dst, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
        hops = np.full(len(starts) * n, -1, np.int32)
        front, k = np.arange(len(starts)) * n + starts, 0
        while len(front):
            hops[front] = k
            if k == max_hops:
                break
            k += 1
            node = front % n
            size = first[node + 1] - first[node]
            edge = np.arange(size.sum()) + np.repeat(first[node] - np.cumsum(size) + size, size)
            front = np.repeat(front - node, size) + dst[edge]
            front = np.unique(front[hops[front] < 0])
        found = np.flatnonzero(hops >= 0)
        kind, graph = table.schema.field("src").type, table.schema.field("graph_id").type
        cols = [pa.array([key[0].as_py()] * len(found), graph), pa.array(names[starts[found // n]], kind), pa.array(names[found % n], kind), pa.array(hops[found])]
        return pa.table(cols, names=["graph_id", "source", "id", "hops"])

    return search


def bfs_distances(canonical: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """graph_id, source, id, hops from each source to all nodes it reaches (within max_hops, if given), the source included.

    Graphs of at most SMALL directed edges are searched in one task for as many sources as come to SEARCHED edges, whatever their
    diameter. In larger ones the frontiers of all sources advance together, a round of joins for each hop; a frontier is an
    anti-join away from what was seen.
    """
    pairs = cut(both_ways(canonical).dropna().distinct())
    start = cut(sources.select("graph_id", "id").distinct())
    sizes = start.groupBy("graph_id").agg(F.count("*").alias("n")).join(pairs.groupBy("graph_id").agg(F.count("*").alias("m")), "graph_id", "left").na.fill(0, ["m"])
    parts = F.ceil(F.col("n") * (F.col("m") + 1) / SEARCHED).cast("int")
    sizes = cut(sizes.select("graph_id", (F.col("m") <= SMALL).alias("small"), parts.alias("parts")))
    mine = lambda df, small: df.join(sizes.filter(F.col("small") == small), "graph_id").drop("small")
    asked = mine(start, True).select("graph_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("src"), F.lit(None).alias("dst"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    rows = asked.union(mine(pairs, True).select("graph_id", every, "src", "dst"))
    kinds = [f"{name} {start.schema[c].dataType.simpleString()}" for name, c in (("graph_id", "graph_id"), ("source", "id"), ("id", "id"))]
    near = cut(rows.groupBy("graph_id", "part").applyInArrow(_searches(max_hops), ", ".join(kinds) + ", hops int"))
    if sizes.filter(~F.col("small")).isEmpty():
        return near
    pairs = cut(mine(pairs, False).drop("parts"))
    seen = cut(mine(start, False).select("graph_id", F.col("id").alias("source"), "id", F.lit(0).alias("hops")))
    frontier, hops = seen, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = frontier.select("graph_id", "source", F.col("id").alias("src")).join(shuffled(pairs), ["graph_id", "src"])
        step = step.select("graph_id", "source", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(shuffled(seen), ["graph_id", "source", "id"], "left_anti").withColumn("hops", F.lit(hops)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return near.union(seen)


def distance_metrics(distances: DataFrame) -> DataFrame:
    """Per graph, from bfs_distances: sources, mean_path over pairs of distinct nodes, approx_diameter."""
    return distances.groupBy("graph_id").agg(
        F.count_distinct("source").alias("sources"),
        F.avg(F.when(F.col("hops") > 0, F.col("hops"))).alias("mean_path"),
        F.max("hops").alias("approx_diameter"),
    )


def label_propagation(canonical: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities: each node takes its neighbours' most frequent label (ties: the least), odd and even ids in
    turns so that labels don't swing. graph_id, id, part.
    """
    pairs = cut(both_ways(canonical).distinct())
    labels = cut(nodes.select("graph_id", "id", F.col("id").alias("part")).distinct())
    for k in range(2 * rounds):
        votes = pairs.join(labels.toDF("graph_id", "dst", "part"), ["graph_id", "dst"])
        votes = votes.groupBy("graph_id", F.col("src").alias("id"), "part").agg(F.count("*").alias("n"))
        best = votes.groupBy("graph_id", "id").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("won"))
        turn = F.pmod(F.col("id"), F.lit(2)) == k % 2
        new = cut(
            labels.join(best, ["graph_id", "id"], "left").select(
                "graph_id", "id", F.col("part").alias("old"), F.when(turn, F.coalesce("won", "part")).otherwise(F.col("part")).alias("part")
            )
        )
        labels = new.select("graph_id", "id", "part")
        if k % 2 and new.filter("old != part").isEmpty():
            break
    return labels


def sampled_nodes(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k nodes of each graph, those least by hash of seed and id."""
    from topoeval.functions.scalars import stable_uniform

    order = Window.partitionBy("graph_id").orderBy(stable_uniform(F.lit(seed), "id"), "id")
    return nodes.select("graph_id", "id").withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k).drop("__k")
