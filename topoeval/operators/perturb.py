"""Controlled perturbation of edge tables. All randomness is a hash of seed and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.joins import shuffled
from topoeval.functions.lineage import cut
from topoeval.functions.ranges import numbers, ranked, with_count
from topoeval.functions.scalars import stable_seed, stable_uniform
from topoeval.operators import graph as G

KEY = ["graph_id", "src", "dst"]
#: Edges that meet in one group of a round of swaps; edges drawn for each one that is missing, and of a graph at least.
BUCKET, MORE, FEW = 64, 1.5, 1024


def _numbered(nodes: DataFrame) -> DataFrame:
    """graph_id, id, k (1 ... n by id), n."""
    return with_count(ranked(nodes.select("graph_id", "id").distinct(), ["graph_id"], ["id"], "k"), ["graph_id"], "n")


def _by_hash(seed: int) -> list[Column]:
    return [stable_uniform(F.lit(seed), "src", "dst"), F.col("src"), F.col("dst")]


def _random_pairs(nodes: DataFrame, wanted: DataFrame, avoid: DataFrame, seed: int, keep=None) -> DataFrame:
    """``wanted`` (graph_id, n_wanted) distinct canonical pairs of nodes of each graph that are not in ``avoid``: rounds of
    hash-drawn pairs until the wish is met. ``keep`` filters the pairs drawn.
    """
    ids = cut(_numbered(nodes))
    size = ids.groupBy("graph_id").agg(F.max("n").alias("n"))
    got = cut(avoid.select(KEY).limit(0))
    for k in range(200):
        have = got.groupBy("graph_id").agg(F.count("*").alias("have"))
        need = wanted.join(have, "graph_id", "left").join(size, "graph_id").select(
            "graph_id", "n", (F.col("n_wanted") - F.coalesce("have", F.lit(0))).alias("need")
        )
        need = cut(need.filter("need > 0 and n > 1"))
        if need.isEmpty():
            return got
        draws = numbers(need.select("graph_id", "n", "need"), F.col("need") * 2 + 8, "i")
        pick = lambda side: F.pmod(stable_seed(F.lit(seed), F.lit(k), F.lit(side), "graph_id", "i"), F.col("n")) + 1
        draws = draws.withColumns({"ka": pick(0), "kb": pick(1)}).filter("ka != kb")
        a, b = ids.select("graph_id", F.col("k").alias("ka"), F.col("id").alias("a")), ids.select("graph_id", F.col("k").alias("kb"), F.col("id").alias("b"))
        pairs = draws.join(shuffled(a), ["graph_id", "ka"]).join(shuffled(b), ["graph_id", "kb"])
        pairs = pairs.groupBy("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "need").agg(F.min("i").alias("i"))
        pairs = pairs.join(shuffled(avoid.select(KEY)), KEY, "left_anti").join(shuffled(got), KEY, "left_anti")
        if keep is not None:
            pairs = keep(pairs)
        got = cut(got.union(ranked(pairs, ["graph_id"], ["i"], "r").filter("r <= need").select(KEY)))
    raise ValueError("not enough pairs are free")


def random_edges(nodes: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """Exactly ``budget`` random edges for each graph; an error if a graph has fewer pairs."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    if not size.filter(F.col("n") * (F.col("n") - 1) / 2 < budget).isEmpty():
        raise ValueError("the budget exceeds the number of pairs")
    none = nodes.select("graph_id", F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    return _random_pairs(nodes, size.select("graph_id", F.lit(budget).alias("n_wanted")), none, seed)


def degree_preserving_swap(canonical: DataFrame, fraction: float, seed: int = 0, max_idle: int = 8) -> DataFrame:
    """Double edge swaps until at least round(fraction * m) of a graph's edges have changed.

    A round draws edges by hash, MORE times as many as are missing and at least FEW, or all, deals them into groups of about
    BUCKET, pairs neighbours in a group, and turns a-b, c-d into a-d, c-b unless that makes a loop, an edge that exists, or one that another swap of the round makes. Of the
    swaps that are possible and change an edge that has not changed yet, as large a share is taken as is missing (by
    hash, so the last round may go past the fraction by about its square root). An error if ``max_idle`` rounds
    in a row find no swap: the graph has too few of them.
    """
    start = cut(canonical.select(KEY))
    edges = start.withColumn("old", F.lit(True))
    k = idle = 0
    while True:
        need = edges.groupBy("graph_id").agg(F.count("*").alias("m"), F.count_if(~F.col("old")).alias("changed"))
        need = need.select("graph_id", "m", (F.round(F.col("m") * fraction) - F.col("changed")).cast("long").alias("left"))
        need = need.filter("left > 0")
        if need.isEmpty():
            return edges.select(KEY)
        k += 1
        draw = lambda *parts: stable_uniform(F.lit(seed), F.lit(k), *parts)
        share = F.least(F.lit(1.0), F.greatest(MORE * F.col("left"), F.lit(float(FEW))) / F.col("m")) if idle == 0 else F.lit(1.0)
        dealt = edges.join(need, "graph_id").withColumns({"u": draw("src", "dst"), "share": share}).filter("u < share")
        dealt = dealt.withColumn("turn", draw(F.lit("turn"), "src", "dst") < 0.5).withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("m") / BUCKET)))
        order = Window.partitionBy("graph_id", "bucket").orderBy("u", "src", "dst")
        nxt = {n: F.lead(c).over(order) for n, c in (("c", "src"), ("d", "dst"), ("old2", "old"))}
        two = dealt.withColumns({"r": F.row_number().over(order), **nxt}).filter("r % 2 = 1 and c is not null and (old or old2)")
        two = two.withColumns({"a": F.when(F.col("turn"), F.col("dst")).otherwise(F.col("src")), "b": F.when(F.col("turn"), F.col("src")).otherwise(F.col("dst"))})
        two = two.filter("a != d and c != b").withColumn("gain", F.col("old").cast("int") + F.col("old2").cast("int"))
        # a swap goes with its new edges as plain numbers, so that it need not be joined to them again
        swap = ["bucket", "r", "gain", "a", "b", "c", "d"]
        ordered = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
        new = F.explode(F.array(ordered("a", "d"), ordered("c", "b"))).alias("e")
        made = two.select("graph_id", *swap, new).select("graph_id", *swap, "e.src", "e.dst")
        # an edge that stands alone is neither there already nor made twice
        alone = made.groupBy(KEY).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in swap]).filter("n = 1")
        alone = alone.join(shuffled(edges.select(KEY)), KEY, "left_anti")
        good = cut(alone.groupBy("graph_id", *swap).agg(F.count("*").alias("n")).filter("n = 2").drop("n"))
        total = good.groupBy("graph_id").agg(F.sum("gain").alias("total"))
        taken = good.join(total.join(need, "graph_id"), "graph_id").filter(draw(F.lit("take"), "graph_id", "bucket", "r") * F.col("total") < F.col("left"))
        taken = cut(taken.select("graph_id", "a", "b", "c", "d"))
        idle = idle + 1 if taken.isEmpty() else 0
        if idle >= max_idle:
            raise ValueError("no more swaps are found")
        used = taken.select("graph_id", F.explode(F.array(ordered("a", "b"), ordered("c", "d"))).alias("e")).select("graph_id", "e.src", "e.dst")
        put = taken.select("graph_id", new).select("graph_id", "e.src", "e.dst")
        put = put.join(shuffled(start.withColumn("old", F.lit(True))), KEY, "left").na.fill(False, ["old"])
        edges = cut(edges.join(shuffled(used), KEY, "left_anti").unionByName(put))


def homophily_attack(canonical: DataFrame, nodes: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """graph_id, src, dst, added: min(same-label edges, round(fraction * m)) hash-drawn same-label edges go and as many
    random pairs of different labels come that were no edges.
    """
    ends = G.labelled_edges(canonical, nodes)
    m = canonical.groupBy("graph_id").agg(F.round(F.count("*") * fraction).cast("long").alias("ask"))
    same = ranked(ends.filter("src_label = dst_label").select(KEY), ["graph_id"], _by_hash(seed), "r").join(m, "graph_id")
    gone = cut(same.filter("r <= ask").select(KEY))
    wanted = gone.groupBy("graph_id").agg(F.count("*").alias("n_wanted"))
    names = nodes.select("graph_id", "id", "label")

    def across(pairs: DataFrame) -> DataFrame:
        out = pairs.join(shuffled(names.toDF("graph_id", "src", "la")), ["graph_id", "src"]).join(shuffled(names.toDF("graph_id", "dst", "lb")), ["graph_id", "dst"])
        return out.filter("la != lb")

    new = _random_pairs(nodes, wanted, canonical, seed + 1, across)
    return canonical.select(KEY).join(shuffled(gone), KEY, "left_anti").withColumn("added", F.lit(False)).union(new.withColumn("added", F.lit(True)))


def homophily_attack_removed(canonical: DataFrame, nodes: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The edges that homophily_attack removes: a deterministic, hash-ordered sample."""
    ends = G.labelled_edges(canonical, nodes)
    m = canonical.groupBy("graph_id").agg(F.round(F.count("*") * fraction).cast("long").alias("ask"))
    same = ranked(ends.filter("src_label = dst_label").select(KEY), ["graph_id"], _by_hash(seed), "r").join(m, "graph_id")
    return same.filter("r <= ask").select(KEY)


def random_rewire(canonical: DataFrame, nodes: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """round(fraction * m) hash-drawn edges go, as many random new pairs come."""
    m = canonical.groupBy("graph_id").agg(F.round(F.count("*") * fraction).cast("long").alias("n_wanted"))
    kept = ranked(canonical.select(KEY), ["graph_id"], _by_hash(seed), "r").join(m, "graph_id").filter("r > n_wanted").select(KEY)
    return kept.union(_random_pairs(nodes, m, canonical, seed + 1))


def perturb(canonical: DataFrame, nodes: DataFrame, mode: str, fraction: float, seed: int = 0) -> DataFrame:
    """Front door: mode degree_preserving, homophily or random; the fraction lies in [0, 1]."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies in [0, 1]")
    if mode == "degree_preserving":
        return degree_preserving_swap(canonical, fraction, seed)
    if mode == "homophily":
        return homophily_attack(canonical, nodes, fraction, seed).drop("added")
    if mode == "random":
        return random_rewire(canonical, nodes, fraction, seed)
    raise ValueError(f"unknown mode: {mode}")


def perturbation_report(clean: DataFrame, observed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph: edges before and after, Jaccard, changed fraction, homophily before and after, same degree sequence."""
    return (
        G.edge_set_diff(clean, observed)
        .join(G.edge_homophily(clean, nodes).withColumnRenamed("homophily", "homophily_before"), "graph_id")
        .join(G.edge_homophily(observed, nodes).withColumnRenamed("homophily", "homophily_after"), "graph_id")
        .join(G.same_degree_sequence(clean, observed, nodes).withColumnRenamed("same", "same_degrees"), "graph_id")
    )
