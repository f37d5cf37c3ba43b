"""Rewiring edge tables by similarity, by similarity and resistance, and by curvature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.joins import shuffled
from topoeval.functions.lineage import cut
from topoeval.functions.ranges import ranked
from topoeval.functions.scalars import cosine, gumbel_key, minmax_scaled, stable_uniform
from topoeval.operators.graph import both_ways
from topoeval.operators.similarity import top_pairs

KEY = ["graph_id", "src", "dst"]


def _with_vectors(edges: DataFrame, points: DataFrame, column: str) -> DataFrame:
    v = points.select("graph_id", "id", column)
    out = edges.join(shuffled(v.toDF("graph_id", "src", "va")), ["graph_id", "src"]).join(shuffled(v.toDF("graph_id", "dst", "vb")), ["graph_id", "dst"])
    return out.withColumn("sim", F.round(cosine("va", "vb"), 10)).drop("va", "vb")


def edge_similarity(edges: DataFrame, points: DataFrame, column: str = "embedding") -> DataFrame:
    """The edges with sim, the cosine of their ends (10 decimals)."""
    return _with_vectors(edges.select(KEY), points, column)


def _sizes(edges: DataFrame, points: DataFrame) -> DataFrame:
    m = edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    n = points.groupBy("graph_id").agg(F.count("*").alias("n"))
    return n.join(m, "graph_id", "left").na.fill(0, ["m"])


def rewire_grid(canonical: DataFrame, points: DataFrame, ratios: list[float], column: str = "embedding") -> DataFrame:
    """graph_id, ratio, src, dst, added: the rewired edges for every ratio, from one ranking.

    k = floor(m * ratio) least similar edges go; the k most similar pairs come that are not among the edges that stay,
    out of a pool of the top S/2 pairs with S = min(n^2, max(10k, 3m)). A removed edge may come again; fewer than k
    come if the pool runs out. Ties go by (src, dst). A ratio outside [0, 1] is an error.
    """
    if any(not 0 <= r <= 1 for r in ratios):
        raise ValueError("ratios lie in [0, 1]")
    grid = F.explode(F.array(*[F.lit(float(r)) for r in sorted(set(ratios))])).alias("ratio")
    cases = _sizes(canonical, points).select("graph_id", "n", "m", grid)
    k = F.floor(F.col("m") * F.col("ratio")).cast("long")
    pool = F.floor(F.least(F.col("n") * F.col("n"), F.greatest(10 * F.col("k"), 3 * F.col("m"))) / 2)
    cases = cut(cases.withColumn("k", k).withColumn("pool", pool).select("graph_id", "ratio", "k", "pool"))
    kept = ranked(edge_similarity(canonical, points, column), ["graph_id"], ["sim", "src", "dst"], "r").drop("sim")
    stay = kept.join(cases, "graph_id").filter("r > k").select("ratio", *KEY)
    pairs = top_pairs(points, cases.groupBy("graph_id").agg(F.max("pool").alias("pool")), column).drop("sim")
    asked = pairs.join(cases, "graph_id").filter("p <= pool").drop("pool")
    fresh = asked.join(stay, ["ratio", *KEY], "left_anti")
    added = ranked(fresh, ["graph_id", "ratio"], ["p"], "a").filter("a <= k")
    return stay.select("graph_id", "ratio", "src", "dst", F.lit(False).alias("added")).union(added.select("graph_id", "ratio", "src", "dst", F.lit(True)))


def rewire_by_similarity(canonical: DataFrame, points: DataFrame, ratio: float, column: str = "embedding") -> DataFrame:
    """graph_id, src, dst, added for one ratio; see rewire_grid."""
    return rewire_grid(canonical, points, [ratio], column).drop("ratio")


def rewire_hybrid(canonical: DataFrame, points: DataFrame, coordinates: DataFrame, ratio: float, alpha: float = 0.7, column: str = "embedding") -> DataFrame:
    """Rewiring by two scores. Edges stay by alpha * mm(sim) + (1 - alpha) * mm(R), pairs come by alpha * mm(sim) +
    (1 - alpha) * mm(1/R), with R the resistance from coordinates and mm the scaling to [0, 1] within edges or pool. The
    pool is the top S/2 pairs by similarity, S = min(n^2, max(20k, 3m)); pairs without coordinates count as R = 0.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio lies in [0, 1]")
    size = _sizes(canonical, points).withColumn("k", F.floor(F.col("m") * ratio).cast("long"))
    size = size.withColumn("pool", F.floor(F.least(F.col("n") * F.col("n"), F.greatest(20 * F.col("k"), 3 * F.col("m"))) / 2))
    c = coordinates.select("graph_id", "id", "c")

    def resist(pairs: DataFrame) -> DataFrame:
        from topoeval.functions.scalars import sqdist

        out = pairs.join(c.toDF("graph_id", "src", "ca"), ["graph_id", "src"], "left").join(c.toDF("graph_id", "dst", "cb"), ["graph_id", "dst"], "left")
        return out.withColumn("res", F.coalesce(sqdist("ca", "cb"), F.lit(0.0))).drop("ca", "cb")

    def scored(pairs: DataFrame) -> DataFrame:
        both = minmax_scaled(pairs, ["sim", "part"], ["graph_id"])
        return both.withColumn("score", F.round(alpha * F.col("sim_scaled") + (1 - alpha) * F.col("part_scaled"), 10))

    edges = scored(resist(edge_similarity(canonical, points, column)).withColumnRenamed("res", "part"))
    stay = ranked(edges.select(*KEY, "score"), ["graph_id"], ["score", "src", "dst"], "r").join(size.select("graph_id", "k"), "graph_id").filter("r > k")
    pool = resist(top_pairs(points, size.select("graph_id", "pool"), column))
    pool = pool.withColumn("part", F.when(F.col("res") > 0, 1 / F.col("res")).otherwise(0.0))
    fresh = scored(pool.join(stay.select(KEY), KEY, "left_anti")).select(*KEY, "score")
    best = ranked(fresh, ["graph_id"], [F.col("score").desc(), F.col("src"), F.col("dst")], "a")
    added = best.join(size.select("graph_id", "k"), "graph_id").filter("a <= k")
    return stay.select(*KEY, F.lit(False).alias("added")).union(added.select(*KEY, F.lit(True)))


def _curvature_gains(worst: DataFrame, pairs: DataFrame, deg: DataFrame) -> DataFrame:
    """graph_id, r, src, dst, gain: for edges worst(graph_id, r, u, v), u < v, every pair of a neighbour a of u and a neighbour
    b of v that is no edge yet, with the change in the balanced Forman curvature of u - v that the edge a - b makes.

    Degrees and triangles of u - v stay as they are, so the change is that of the last term: if a is not beside v and
    b not beside u, a and b are on one more 4-cycle u - a - b - v.
    """
    from topoeval.operators.motifs import four_cycles, square_sides

    key = ["graph_id", "u", "v"]
    turned = worst.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))
    ends = cut(four_cycles(worst.select(*key).union(turned), pairs))
    sides = worst.join(shuffled(square_sides(ends)), key, "left").na.fill(0, ["su", "sv", "gamma"])
    sides = sides.join(shuffled(deg.toDF("graph_id", "u", "du")), ["graph_id", "u"]).join(shuffled(deg.toDF("graph_id", "v", "dv")), ["graph_id", "v"])
    out = sides.join(shuffled(pairs.toDF("graph_id", "u", "a")), ["graph_id", "u"]).join(shuffled(pairs.toDF("graph_id", "v", "b")), ["graph_id", "v"])
    out = out.filter("a != b and a != v and b != u").withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    out = out.join(shuffled(pairs), KEY, "left_anti")
    beside = lambda x, y, name: shuffled(pairs.select("graph_id", F.col("src").alias(x), F.col("dst").alias(y), F.lit(True).alias(name)))
    out = out.join(beside("v", "a", "av"), ["graph_id", "v", "a"], "left").join(beside("u", "b", "bu"), ["graph_id", "u", "b"], "left")
    out = out.join(shuffled(ends.toDF(*key, "a", "ta")), [*key, "a"], "left").join(shuffled(ends.toDF("graph_id", "v", "u", "b", "tb")), [*key, "b"], "left")
    out = out.na.fill(False, ["av", "bu"]).na.fill(0, ["ta", "tb"])
    gamma = F.greatest("gamma", F.col("ta") + 1, F.col("tb") + 1)
    s = F.col("su") + F.col("sv")
    more = s + (F.col("ta") == 0).cast("int") + (F.col("tb") == 0).cast("int")
    before = F.when(F.col("gamma") > 0, s / F.col("gamma")).otherwise(0.0)
    change = (more / gamma - before) / F.greatest("du", "dv")
    gain = F.when(F.col("av") | F.col("bu") | (F.least("du", "dv") <= 1), 0.0).otherwise(change)
    return out.withColumn("gain", gain).groupBy("graph_id", "r", "src", "dst").agg(F.max("gain").alias("gain"))


def curvature_rewire(
    canonical: DataFrame, nodes: DataFrame, ratio: float, batch: int | None = None, temperature: float = 5.0, remove_above: float | None = None, seed: int = 0
) -> DataFrame:
    """graph_id, round, src, dst: snapshots after each round. A round takes each graph's ``batch`` (a hundredth of its edges,
    8 at least, if not given) most negative edges (ties: by hash, for edges in a row would share nodes), no two of which share
    a node, and for each draws one new edge between the neighbours of its ends by a softmax of temperature * the change in that edge's curvature; edges above ``remove_above``
    go, one per added edge. Stops at round(ratio * nodes) additions, or where no edge of a batch has a free pair. Batched
    rounds follow the sequential rule's choice for each edge, but not its sequence.
    """
    from topoeval.operators.motifs import balanced_forman

    edges = cut(canonical.select(KEY))
    target = nodes.groupBy("graph_id").agg(F.round(F.count("*") * ratio).cast("long").alias("target"))
    size = edges.groupBy("graph_id").agg((F.greatest(F.ceil(F.count("*") / 100), F.lit(8)) if batch is None else F.lit(batch)).cast("long").alias("batch"))
    done = cut(target.join(size, "graph_id", "left").na.fill(0, ["batch"]).withColumn("done", F.lit(0).cast("long")))
    shots = edges.withColumn("round", F.lit(0))
    k = 0
    while not done.filter("done < target").isEmpty():
        k += 1
        curved = cut(balanced_forman(edges, nodes).join(done.filter("done < target"), "graph_id"))
        by = [F.round("curvature", 10), stable_uniform(F.lit(seed), F.lit(k), "src", "dst"), F.col("src"), F.col("dst")]
        worst = ranked(curved, ["graph_id"], by, "r").filter(F.col("r") <= F.least("batch", F.col("target") - F.col("done")))
        ends = worst.select("graph_id", "r", F.explode(F.array("src", "dst")).alias("id"))
        clash = ends.withColumn("first", F.min("r").over(Window.partitionBy("graph_id", "id"))).filter("r != first").select("graph_id", "r").distinct()
        worst = cut(worst.join(shuffled(clash), ["graph_id", "r"], "left_anti").select("graph_id", "r", F.col("src").alias("u"), F.col("dst").alias("v")))
        near = cut(both_ways(edges))
        deg = near.groupBy("graph_id", F.col("src").alias("id")).agg(F.count("*").alias("d"))
        pairs = _curvature_gains(worst, near, deg)
        draw = gumbel_key("gain", temperature, F.lit(seed), F.lit(k), "r", "src", "dst")
        new = pairs.groupBy("graph_id", "r").agg(F.max_by(F.struct("src", "dst"), draw).alias("e")).select("graph_id", "e.src", "e.dst").distinct()
        new = cut(new)
        added = new.groupBy("graph_id").agg(F.count("*").alias("more"))
        if new.isEmpty():
            break
        edges_next = edges.union(new)
        if remove_above is not None:
            top = [F.round("curvature", 10).desc(), F.col("src"), F.col("dst")]
            gone = ranked(curved.filter(F.col("curvature") > remove_above), ["graph_id"], top, "r").join(added, "graph_id").filter("r <= more")
            edges_next = edges_next.join(shuffled(gone.select(KEY)), KEY, "left_anti")
        edges = cut(edges_next)
        now = F.when(F.col("more").isNull(), F.col("target")).otherwise(F.col("done") + F.col("more")).alias("done")
        done = cut(done.join(added, "graph_id", "left").select("graph_id", "target", "batch", now))
        shots = shots.unionByName(edges.withColumn("round", F.lit(k)))
    return shots
