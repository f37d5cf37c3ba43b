"""Similarity and nearest-neighbour graphs from vectors: points(graph_id, id, embedding).

All pairs are met block by block: rows are dealt by hash into blocks of about ``rows``, and from MOST blocks on into larger
ones, of NUMBERS numbers at most, for every block goes to every other one; each pair of blocks is one group, which makes
TILE products at a time, so no N x N matrix is ever made. What is asked for is chosen inside the groups: the nearest k of a row, or the pairs of a graph up to a
threshold that histograms of the groups have fixed before (``top_pairs``). With ``cosine_candidates`` the pairs are
those that share a sign hash instead (approximate, near-linear).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.functions.ranges import ranked
from topoeval.functions.scalars import sqdist, stable_uniform, unit

#: Vectors of a block; blocks of a graph before they grow; numbers of a block, products made at a time.
ROWS, MOST, NUMBERS, TILE = 512, 32, 1 << 20, 1 << 17
#: Tasks that pairs of blocks are dealt to.
TASKS = 128
#: Pairs beyond the wanted ones that are sent on rather than looked at in another round of histograms.
EXCESS = 1 << 18


def _blocks(points: DataFrame, rows: int, extra: DataFrame | None = None) -> DataFrame:
    """points with their block and their graph's number of blocks, and extra's columns."""
    needed = F.greatest(F.lit(MOST).cast("long"), F.ceil(F.count("*") * F.max(F.size("v")) / NUMBERS))
    size = points.groupBy("graph_id").agg(F.least(F.ceil(F.count("*") / rows), needed).cast("int").alias("blocks"))
    if extra is not None:
        size = size.join(extra, "graph_id")
    return points.join(size, "graph_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _block_pairs(points: DataFrame, rows: int, extra: DataFrame | None) -> DataFrame:
    """graph_id, low, high, side (0, 1), id, v: each block of rows once for every block it meets, with extra's columns."""
    at = _blocks(points, rows, extra)
    met = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    names = [c for c in extra.columns if c != "graph_id"] if extra is not None else []
    return met.select("graph_id", low.alias("low"), high.alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "v", *names)


def _meet(points: DataFrame, rows: int, run, schema: str, extra: DataFrame | None = None, both: bool = False, finish=None, whole: bool = False) -> DataFrame:
    """Apply run(ids_a, vectors_a, ids_b, vectors_b, same block, extra's values) to every pair of blocks, some rows of a and all
    of b at a time (``whole``: all of both); with ``both`` to b and a as well. finish(columns) makes one table of a group's.
    """
    kinds = points.schema["graph_id"].dataType.simpleString()
    asked = [c for c in extra.columns if c != "graph_id"] if extra is not None else []
    names = [c.split()[0] for c in schema.split(", ")]

    def blockwise(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        same = key[1].as_py() == key[2].as_py()
        a, b = side == 0, (side == 0 if same else side == 1)
        of = {c: table.column(c)[0].as_py() for c in asked}
        sides = [(ids[a], v[a], ids[b], v[b])]
        if both and not same:
            sides.append((ids[b], v[b], ids[a], v[a]))
        made = []
        for ia, va, ib, vb in sides:
            step = max(1, len(ia) if whole else TILE // max(1, len(ib)))
            made += [run(ia[k : k + step], va[k : k + step], ib, vb, same, of) for k in range(0, max(1, len(ia)), step)]
        cols = [np.concatenate(c) for c in zip(*made, strict=True)]
        cols = cols if finish is None else finish(cols)
        n = len(cols[0])
        return pa.table([pa.array([key[0].as_py()] * n, table.schema.field("graph_id").type), *map(pa.array, cols)], names=["graph_id", *names])

    met = _block_pairs(points, rows, extra).repartition(TASKS, "graph_id", "low", "high")  # by number, for their work isn't told by their size
    return met.groupBy("graph_id", "low", "high").applyInArrow(blockwise, f"graph_id {kinds}, {schema}")


def _vectors(points: DataFrame, column: str, normal: bool) -> DataFrame:
    v = F.col(column)
    return points.select("graph_id", "id", (unit(v) if normal else F.transform(v, lambda x: x.cast("double"))).alias("v"))


def _squares(va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """Squared distances, unrounded."""
    d = (2 * va) @ vb.T
    return np.subtract((va**2).sum(1)[:, None] + (vb**2).sum(1), d, out=d)


def _places(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, in a fraction of its time where few are set."""
    return np.divmod(np.flatnonzero(where), max(1, where.shape[1]))


def _distances(va: np.ndarray, vb: np.ndarray, metric: str) -> np.ndarray:
    """Distances to 10 decimals; of unit vectors for the cosine."""
    if metric == "cosine":
        return np.round(1 - va @ vb.T, 10)
    return np.round(np.sqrt(np.maximum(_squares(va, vb), 0)), 10)


def pairwise_cosine(points: DataFrame, threshold: float = -1.0, column: str = "embedding", rows: int = ROWS) -> DataFrame:
    """graph_id, src < dst, sim (10 decimals) of all pairs with at least that cosine."""

    def run(ia, va, ib, vb, same, _):
        s = np.round(va @ vb.T, 10)
        keep = s >= threshold
        if same:
            keep &= ia[:, None] < ib[None, :]
        r, c = _places(keep)
        return [np.minimum(ia[r], ib[c]), np.maximum(ia[r], ib[c]), s[r, c]]

    return _meet(_vectors(points, column, True), rows, run, "src bigint, dst bigint, sim double")


def _keys(va: np.ndarray, vb: np.ndarray, metric: str) -> np.ndarray:
    """Whole numbers in the order of the pairs: most similar, or nearest, first."""
    if metric == "cosine":
        return 10**10 - np.rint(np.round(va @ vb.T, 10) * 1e10).astype(np.int64)
    return _distances(va, vb, metric).view(np.int64)  # the bits of doubles that are not negative are in their order


def top_pairs(points: DataFrame, wanted: DataFrame, column: str = "embedding", metric: str = "cosine", rows: int = ROWS) -> DataFrame:
    """graph_id, src < dst, sim (or distance) and p (1, 2, ...) of the first ``pool`` pairs of each graph of wanted(graph_id,
    pool) in the order of (sim descending, or distance; src; dst); all pairs of a graph that has fewer.

    Histograms of the blocks' products tell in which bucket of values the last wanted pair lies, another round in
    which of its parts, down to a single value if many pairs share a bucket. Only pairs up to there are made; of those
    with that very value no block sends more than are wanted.
    """
    v = _vectors(points, column, metric == "cosine")
    shifts = [20, 0] if metric == "cosine" else [40, 20, 0]
    state = wanted.select("graph_id", F.col("pool").cast("long").alias("pool"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("above"))
    state = cut(state.filter("pool > 0"))
    before = 63

    def counting(shift: int, before: int):
        def run(ia, va, ib, vb, same, of):
            keys = _keys(va, vb, metric)
            keys = keys[ia[:, None] < ib[None, :]] if same else keys.ravel()
            return summed([keys[keys >> before == of["base"]] >> shift, None])

        return run

    def summed(cols: list) -> list[np.ndarray]:
        """Buckets and their numbers of pairs, each bucket once."""
        bucket, n = cols
        low = bucket.min(initial=1 << 62)
        if bucket.max(initial=low) - low < 1 << 20:
            held = np.bincount(bucket - low, n).astype(np.int64)
            there = np.flatnonzero(held)
            return [there + low, held[there]]
        found, at = np.unique(bucket, return_inverse=True)
        return [found, np.bincount(at, n).astype(np.int64)]

    for shift in shifts:
        held = _meet(v, rows, counting(shift, before), "bucket bigint, n bigint", state.select("graph_id", "base"), finish=summed)
        counts = held.groupBy("graph_id", "bucket").agg(F.sum("n").alias("n"))
        # at most 2**20 buckets a graph
        upto = F.sum("n").over(Window.partitionBy("graph_id").orderBy("bucket"))
        reach = counts.withColumn("upto", upto).join(state.select("graph_id", "pool", "above"), "graph_id").withColumn("upto", F.col("upto") + F.col("above"))
        reach = reach.filter(F.col("upto") - F.col("n") < F.col("pool")).groupBy("graph_id", "pool").agg(F.max_by(F.struct("bucket", "n", "upto"), "bucket").alias("last"))
        state = cut(reach.select("graph_id", "pool", F.col("last.bucket").alias("base"), (F.col("last.upto") - F.col("last.n")).alias("above"), F.col("last.upto").alias("upto")))
        before = shift
        excess = state.agg(F.max(F.col("upto") - F.col("pool"))).first()[0]
        if excess is None or excess <= EXCESS:
            break

    def emit(ia, va, ib, vb, same, of):
        keys = _keys(va, vb, metric)
        part = keys >> before
        keep = part <= of["base"]
        if same:
            keep &= ia[:, None] < ib[None, :]
        r, c = _places(keep)
        src, dst = np.minimum(ia[r], ib[c]), np.maximum(ia[r], ib[c])
        if before == 0:
            last = np.flatnonzero(part[r, c] == of["base"])
            need = max(0, of["pool"] - of["above"])
            if len(last) > need:
                gone = last[np.lexsort((dst[last], src[last]))[need:]]
                stay = np.ones(len(r), bool)
                stay[gone] = False
                r, c, src, dst = r[stay], c[stay], src[stay], dst[stay]
        found = keys[r, c]
        value = (10**10 - found) / 1e10 if metric == "cosine" else found.view(np.float64)
        return [src, dst, np.round(value, 10)]

    name = "sim" if metric == "cosine" else "distance"
    pairs = _meet(v, rows, emit, f"src bigint, dst bigint, {name} double", state.select("graph_id", "pool", "base", "above"))
    order = [F.col("sim").desc() if metric == "cosine" else F.col("distance"), F.col("src"), F.col("dst")]
    first = ranked(pairs, ["graph_id"], order, "p")
    return first.join(state.select("graph_id", "pool"), "graph_id").filter("p <= pool").drop("pool")


def cosine_candidates(
    points: DataFrame, bits: int = 12, tables: int | None = None, seed: int = 0, column: str = "embedding", similar: float = 0.9, recall: float = 0.95
) -> DataFrame:
    """Approximate pairs for large tables: graph_id, src < dst, sim of pairs that share the signs of ``bits`` random projections
    in at least one of ``tables`` hash tables. A pair of cosine s shares a table with probability (1 - acos(s) / pi) ** bits;
    if not given, there are as many tables as find ``recall`` of the pairs of cosine ``similar`` (18 by default).
    pairwise_cosine is the exact way.
    """
    if tables is None:
        share = (1 - math.acos(similar) / math.pi) ** bits
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))) if share < 1 else 1
    rows = _vectors(points, column, True)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(2).to_pylist(), dtype=float)
            planes = np.random.default_rng(seed).standard_normal((tables * bits, v.shape[1] if len(v) else 1))
            signs = (v @ planes.T > 0).reshape(len(v), tables, bits) if len(v) else np.zeros((0, tables, bits), bool)
            code = (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code.tolist(), pa.list_(pa.int64()))], ["graph_id", "id", "keys"])

    kind = points.schema["graph_id"].dataType.simpleString()
    held = rows.mapInArrow(keys, f"graph_id {kind}, id bigint, keys array<bigint>").select("graph_id", "id", F.explode("keys").alias("key"))
    pairs = held.toDF("graph_id", "src", "key").join(held.toDF("graph_id", "dst", "key"), ["graph_id", "key"]).filter("src < dst")
    pairs = pairs.select("graph_id", "src", "dst").distinct()
    from topoeval.functions.scalars import dot

    out = pairs.join(rows.toDF("graph_id", "src", "a"), ["graph_id", "src"]).join(rows.toDF("graph_id", "dst", "b"), ["graph_id", "dst"])
    return out.select("graph_id", "src", "dst", F.round(dot("a", "b"), 10).alias("sim"))


def _apart(va: np.ndarray, vb: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances, or 1 - cosine of unit vectors, unrounded."""
    return 1 - va @ vb.T if metric == "cosine" else _squares(va, vb)


def _reaches(points: DataFrame, k: int, metric: str, rows: int) -> DataFrame:
    """points with the (squared) distance of the k-th nearest in their own block, which their k nearest don't exceed, before v."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        n = table.num_rows
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        reach = np.full(n, np.inf)
        if n > k:
            step = max(1, TILE // n)
            for at in range(0, n, step):
                d = _apart(v[at : at + step], v, metric)
                d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
                reach[at : at + step] = np.partition(d, k - 1, axis=1)[:, k - 1]
        held = np.column_stack([reach, v])
        wide = pa.ListArray.from_arrays(pa.array(np.arange(0, held.size + 1, held.shape[1], dtype=np.int32)), pa.array(held.ravel()))
        return pa.table([table.column("graph_id"), table.column("id"), wide], names=["graph_id", "id", "v"])

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("graph_id", "id"))
    dealt = _blocks(points, rows).select("graph_id", "block", "id", "v").repartition(MOST, "graph_id", "block")
    return cut(dealt.groupBy("graph_id", "block").applyInArrow(run, f"{kinds}, v array<double>"))


def _nearest(r: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows r with their partners' ids and distances the k first by (distance, id) for each row."""
    order = np.lexsort((ids, found, r))
    r, ids, found = r[order], ids[order], found[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], ids[first], found[first]


def knn(points: DataFrame, k: int, column: str = "embedding", metric: str = "euclidean", rows: int = ROWS) -> DataFrame:
    """graph_id, id, neighbor, distance (10 decimals), rank 1 ... k by (distance, neighbor).

    The k-th nearest in its own block bounds how far a row has to look. Each pair of blocks makes its products once for both
    sides, compares them with these bounds and sends at most k candidates for each of its rows; the best k of these win.
    """

    def run(ia, va, ib, vb, same, _):
        sides = [[ia, va[:, 1:], va[:, 0]], [ib, vb[:, 1:], vb[:, 0]]]
        for side in sides:  # what may be among the k nearest by unrounded values; only these are rounded and put in order
            off = 1e-13 * (1 + max(((v**2).sum(1).max(initial=0.0) for _, v, _ in sides), default=0.0))
            side[2] = side[2] + 2e-10 + off if metric == "cosine" else (np.sqrt(np.maximum(side[2], 0)) + 2e-10) ** 2 * (1 + 1e-12) + off
        (ia, xa, la), (ib, xb, lb) = sides
        kept = [[], []]
        step = max(1, math.isqrt(TILE))

        def keep(side: int, r: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
            kept[side].append((r, ids, found))
            if len(kept[side]) > 1 and sum(len(x[0]) for x in kept[side]) > max(TILE, 4 * k * len(sides[side][0])):
                kept[side] = [_nearest(*map(np.concatenate, zip(*kept[side], strict=True)), k)]

        for a in range(0, len(ia), step):
            for b in range(0, len(ib), step):
                d = _apart(xa[a : a + step], xb[b : b + step], metric)
                if same:
                    d[ia[a : a + step, None] == ib[b : b + step]] = np.inf
                near = d <= la[a : a + step, None]
                r, c = _places(near if same else near | (d <= lb[b : b + step]))
                there = np.isfinite(d[r, c])
                r, c, found = a + r[there], b + c[there], d[r[there], c[there]]
                value = np.round(found if metric == "cosine" else np.sqrt(np.maximum(found, 0)), 10)
                for side, mine in ((0, found <= la[r]), (1, found <= lb[c])) if not same else ((0, slice(None)),):
                    keep(side, (r, c)[side][mine], (ib[c], ia[r])[side][mine], value[mine])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best = [_nearest(*map(np.concatenate, zip(none, *held, strict=True)), k) for held in kept]
        return [np.concatenate([sides[side][0][best[side][0]] for side in (0, 1)]), *(np.concatenate([b[i] for b in best]) for i in (1, 2))]

    v = _reaches(_vectors(points, column, metric == "cosine"), k, metric, rows)
    found = _meet(v, rows, run, "id bigint, neighbor bigint, distance double", whole=True)
    order = Window.partitionBy("graph_id", "id").orderBy("distance", "neighbor")  # k rows a block that an id meets
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_plane(points: DataFrame, k: int) -> DataFrame:
    """knn of points(graph_id, id, x, y) in the plane, exactly and without all pairs.

    Points lie in tiles of about equal numbers of points. The k nearest in its own tile bound how far a point has to
    look; it then asks those tiles that its circle reaches, each of which sends at most k candidates. Copies of one point
    that fill several tiles all ask all of these.
    """
    from topoeval.operators.voronoi import _tiles

    place = ["graph_id", "slab", "tile"]
    held = cut(_tiles(points).select(*place, "id", "x", "y"))
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("graph_id", "slab", "tile", "id")}

    def nearest(ids, x, y, at, px, py):
        """Row, column and distance of the k nearest (distance, id) among ids to each of at, itself left out."""
        for start in range(0, len(at), step := max(1, TILE // max(1, len(ids)))):
            part = slice(start, start + step)
            dx, dy = px[part, None] - x, py[part, None] - y
            d = np.round(np.sqrt(dx * dx + dy * dy), 10)
            d[at[part, None] == ids] = np.inf
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            yield start + np.repeat(np.arange(len(d)), order.shape[1]), order.ravel(), np.take_along_axis(d, order, 1).ravel()

    def reaches(key: tuple, table: pa.Table) -> pa.Table:
        ids, x, y = (table.column(c).to_numpy() for c in ("id", "x", "y"))
        last = np.full(len(ids), np.inf)
        for r, _, d in nearest(ids, x, y, ids, x, y):
            if len(ids) > k:
                last[r[k - 1 :: k]] = d[k - 1 :: k]
        return table.append_column("reach", pa.array(last))

    def answers(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, x, y = (table.column(c).to_numpy() for c in ("id", "x", "y"))
        found = list(nearest(ids[~asks], x[~asks], y[~asks], ids[asks], x[asks], y[asks]))
        r, c, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        there = np.isfinite(d)
        cols = [pa.array(ids[asks][r[there].astype(np.int64)]), pa.array(ids[~asks][c[there].astype(np.int64)]), pa.array(d[there].astype(float))]
        return pa.table([pa.array([key[0].as_py()] * len(cols[0]), table.schema.field("graph_id").type), *cols], names=["graph_id", "id", "neighbor", "distance"])

    shape = ", ".join(f"{c} {kinds[c]}" for c in (*place, "id")) + ", x double, y double"
    seen = cut(held.groupBy(*place).applyInArrow(reaches, f"{shape}, reach double"))
    box = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    tiles = cut(seen.groupBy(*place).agg(*box, F.max("reach").alias("wide")))
    others = tiles.toDF("graph_id", "to_slab", "to_tile", "left", "right", "low", "high", "_").drop("_")
    apart = lambda low, high, one, two: F.greatest(F.col(low) - F.col(two), F.col(one) - F.col(high), F.lit(0.0))
    gap = lambda x0, x1, y0, y1: F.hypot(apart("left", "right", x0, x1), apart("low", "high", y0, y1))
    met = cut(tiles.join(others, "graph_id").filter(gap("x0", "x1", "y0", "y1") <= F.col("wide") + 1e-9).drop("x0", "x1", "y0", "y1", "wide"))
    asks = seen.join(met, place).filter(gap("x", "x", "y", "y") <= F.col("reach") + 1e-9)
    asks = asks.select("graph_id", F.col("to_slab").alias("slab"), F.col("to_tile").alias("tile"), "id", "x", "y", F.lit(True).alias("asks"))
    both = asks.unionByName(held.withColumn("asks", F.lit(False)))
    found = both.groupBy(*place).applyInArrow(answers, f"graph_id {kinds['graph_id']}, id {kinds['id']}, neighbor {kinds['id']}, distance double")
    order = Window.partitionBy("graph_id", "id").orderBy("distance", "neighbor")  # k rows a tile that an id asks
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_edges(neighbors: DataFrame, mutual: bool = False) -> DataFrame:
    """Canonical edges of a k-nearest-neighbour table with the least distance and whether both ends chose it."""
    edges = neighbors.groupBy("graph_id", F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst")).agg(
        F.min("distance").alias("distance"), (F.count("*") > 1).alias("mutual")
    )
    return edges.filter("mutual") if mutual else edges


def take_budget(candidates: DataFrame, budget: int, order: tuple[str, ...] = ("distance", "src", "dst")) -> DataFrame:
    """The first ``budget`` candidates of each graph in that order, with their rank; stops if a graph has fewer."""
    numbered = ranked(candidates, ["graph_id"], order)
    size = numbered.groupBy("graph_id").agg(F.count("*").alias("__n"))
    enough = F.when(F.col("__n") >= budget, F.col("rank")).otherwise(F.raise_error(F.lit("fewer candidates than the budget")).cast("long"))
    return numbered.filter(F.col("rank") <= budget).join(size, "graph_id").withColumn("rank", enough).drop("__n")


def budget_steps(n: int, budget: int) -> list[int]:
    """The k that budgeted_knn tries for n points: from two ends an edge on, by 1.6 each."""
    steps = [min(n - 1, max(8, -(-2 * budget // n)))]
    while steps[-1] < n - 1:
        steps.append(min(n - 1, max(steps[-1] + 1, int(steps[-1] * 1.6))))
    return steps


def budgeted_knn(points: DataFrame, budget: int, mutual: bool = True, column: str = "embedding", near: tuple[int, DataFrame] | None = None) -> DataFrame:
    """The ``budget`` shortest (mutual) neighbour edges; k grows by 1.6 until every graph has that many.

    Neighbours are found for two steps of k ahead and written; how many edges each k gives is counted from their ranks. What
    is known already may be given as ``near``: k and the table of the k nearest.
    """
    size = points.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.min("n"), F.count("*")).first()
    n, least, graphs = size
    if budget > least * (least - 1) // 2:
        raise ValueError("the budget exceeds the number of pairs")
    steps = budget_steps(n, budget)
    for at in range(0, len(steps), 3):
        mine = steps[at : at + 3]
        found = near[1] if near is not None and near[0] >= mine[-1] else cut(knn(points, mine[-1], column))
        ends = found.filter(F.col("rank") <= mine[-1]).groupBy("graph_id", F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst")).agg(
            (F.max("rank") if mutual else F.min("rank")).alias("k"), F.count("*").alias("both")
        )
        ends = ends.filter("both > 1") if mutual else ends
        counts = ends.groupBy("graph_id").agg(*[F.count(F.when(F.col("k") <= k, 1)).alias(f"k{k}") for k in mine])
        enough = counts.agg(*[F.count(F.when(F.col(f"k{k}") >= budget, 1)) for k in mine]).first()
        for k, done in zip(mine, enough, strict=True):
            if done == graphs or k == steps[-1]:
                return take_budget(knn_edges(found.filter(F.col("rank") <= k), mutual), budget)
    raise AssertionError("the last step has every pair")


def radius_graph(points: DataFrame, budget: int, column: str = "embedding", near: tuple[int, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``budget`` shortest pairs of each graph (a graph with fewer stops the query), and the distance of the last one
    (cutoff).

    If neighbours are known (``near``, as in budgeted_knn), the ``budget`` shortest edges to them bound the cutoff. A pair up to
    there that is none of these is missing from both ends' lists, whose last neighbours are then no farther: only points
    with such lists are met again.
    """
    if near is None:
        pool = points.select("graph_id").distinct().withColumn("pool", F.lit(budget))
        edges = take_budget(top_pairs(points, pool, column, "euclidean").drop("p"), budget)
        return edges, edges.groupBy("graph_id").agg(F.max("distance").alias("cutoff"), F.count("*").alias("n_edges"))
    k, found = near
    edges = cut(knn_edges(found).select("graph_id", "src", "dst", "distance"))
    bound = ranked(edges, ["graph_id"], ["distance", "src", "dst"]).filter(F.col("rank") == budget).select("graph_id", F.col("distance").alias("__bound"))
    last = found.filter(F.col("rank") == k).select("graph_id", "id", F.col("distance").alias("__last")).join(bound, "graph_id", "left")
    crowded = last.filter(F.col("__bound").isNull() | (F.col("__last") <= F.col("__bound") + 1e-9)).select("graph_id", "id")
    crowd = cut(points.select("graph_id", "id", column).join(crowded, ["graph_id", "id"], "left_semi"))
    if not crowd.isEmpty():
        pool = crowd.select("graph_id").distinct().withColumn("pool", F.lit(budget))
        more = top_pairs(crowd, pool, column, "euclidean").select("graph_id", "src", "dst", "distance")
        edges = edges.union(more).groupBy("graph_id", "src", "dst").agg(F.min("distance").alias("distance"))
    edges = take_budget(edges, budget)
    return edges, edges.groupBy("graph_id").agg(F.max("distance").alias("cutoff"), F.count("*").alias("n_edges"))


def bottom_k_edges(scored: DataFrame, k: int, score: str = "sim") -> DataFrame:
    """The k rows of each graph with the least score, ties by (src, dst), with their rank."""
    return ranked(scored, ["graph_id"], [score, "src", "dst"]).filter(F.col("rank") <= k)


def top_candidate_pairs(scored: DataFrame, k: int, score: str = "sim") -> DataFrame:
    """The k rows of each graph with the largest score, ties by (src, dst), with their rank. For all pairs of vectors
    top_pairs does not make the pairs first.
    """
    return ranked(scored, ["graph_id"], [F.col(score).desc(), F.col("src"), F.col("dst")]).filter(F.col("rank") <= k)


def anchor_similarity(points: DataFrame, anchors: int, k: int, column: str = "embedding", seed: int = 0) -> DataFrame:
    """graph_id, id, anchor, weight: the k most similar of a few anchors (those least by hash), negative
    similarity as 0, weights of a row summing to 1. Anchors are broadcast: ``anchors`` rows per graph.
    """
    order = Window.partitionBy("graph_id").orderBy(stable_uniform(F.lit(seed), "id"), "id")
    rows = _vectors(points, column, True)
    chosen = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= anchors).select("graph_id", F.col("id").alias("anchor"), F.col("v").alias("av"))
    from topoeval.functions.scalars import dot

    sims = rows.join(F.broadcast(chosen), "graph_id").select("graph_id", "id", "anchor", F.greatest(F.round(dot("v", "av"), 10), F.lit(0.0)).alias("sim"))
    best = Window.partitionBy("graph_id", "id").orderBy(F.col("sim").desc(), "anchor")
    top = sims.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    total = F.sum("sim").over(Window.partitionBy("graph_id", "id"))
    return top.withColumn("weight", F.when(total > 0, F.col("sim") / total).otherwise(0.0)).select("graph_id", "id", "anchor", "weight")


def anchor_propagate(weights: DataFrame, values: DataFrame) -> DataFrame:
    """Node values to anchors (weighted mean) and back: graph_id, id, value."""
    up = weights.join(values, ["graph_id", "id"]).groupBy("graph_id", "anchor").agg(
        (F.sum(F.col("weight") * F.col("value")) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("mean")
    )
    return weights.join(up, ["graph_id", "anchor"]).groupBy("graph_id", "id").agg(F.sum(F.col("weight") * F.col("mean")).alias("value"))


def blend_edges(observed: DataFrame, learned: DataFrame, skip: float) -> DataFrame:
    """skip * observed + (1 - skip) * learned over weighted edges (graph_id, src, dst, weight)."""
    key = ["graph_id", "src", "dst"]
    both = observed.withColumnRenamed("weight", "a").join(learned.withColumnRenamed("weight", "b"), key, "full").na.fill(0.0, ["a", "b"])
    return both.select(*key, (skip * F.col("a") + (1 - skip) * F.col("b")).alias("weight"))


def trustworthiness(points: DataFrame, k: int, high: str = "embedding", low: str = "projection", sample: int = 3000, seed: int = 0) -> DataFrame:
    """1 - 2 / (n k (2n - 3k - 1)) * sum of (rank - k) over the k low-dimensional neighbours that are no high-dimensional
    ones, on a sample of each graph; k is at most n/2 - 1. Neighbours in the plane are found by tiles. Ranks are counted block by block, for the k n pairs only; ids are below
    2**53.
    """
    order = Window.partitionBy("graph_id").orderBy(stable_uniform(F.lit(seed), "id"), "id")
    rows = cut(points.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= sample).select("graph_id", "id", high, low))
    n = rows.groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("k", F.least(F.lit(k), F.floor(F.col("n") / 2) - 1))
    flat = rows.agg(F.min(F.size(low)), F.max(F.size(low))).first()
    at = lambda i: F.element_at(low, i).cast("double")
    close = knn_plane(rows.select("graph_id", "id", at(1).alias("x"), at(2).alias("y")), k) if tuple(flat) == (2, 2) else knn(rows, k, low)
    near = close.join(n, "graph_id").filter("rank <= k").select("graph_id", "id", F.col("neighbor").alias("j"))
    wide = rows.select("graph_id", "id", F.col(high).alias("h"))
    ends = near.join(wide, ["graph_id", "id"]).join(wide.toDF("graph_id", "j", "hj"), ["graph_id", "j"])
    far = ends.select("graph_id", "id", F.struct("j", F.round(sqdist("h", "hj"), 10).alias("d")).alias("s"))
    far = far.groupBy("graph_id", "id").agg(F.collect_list("s").alias("s"))  # k of them
    pad = lambda name: F.slice(F.concat(F.transform("s", lambda s: s[name].cast("double")), F.array_repeat(F.lit(-1.0), k)), 1, k)
    v = wide.join(far, ["graph_id", "id"]).select("graph_id", "id", F.concat(pad("d"), pad("j"), F.transform("h", lambda x: x.cast("double"))).alias("v"))

    def nearer(ia, va, ib, vb, same, _):
        """For each row of a and each of its neighbours: how many rows of b come before that neighbour."""
        d, j, x, y = va[:, :k], va[:, k : 2 * k], va[:, 2 * k :], vb[:, 2 * k :]
        square = np.round(_squares(x, y), 10)
        if same:
            square[ia[:, None] == ib[None, :]] = np.inf
        first = np.zeros(d.shape, np.int64)
        for row, (held, ends) in enumerate(zip(np.sort(square, axis=1), d, strict=True)):
            first[row] = np.searchsorted(held, ends)
            for c in np.flatnonzero(np.searchsorted(held, ends, "right") > first[row]):  # ties go by id
                first[row, c] += np.count_nonzero(ib[square[row] == ends[c]] < j[row, c])
        there = d >= 0
        return [np.repeat(ia, k).reshape(-1, k)[there], j[there].astype(np.int64), first[there]]

    ranks = _meet(v, ROWS, nearer, "i bigint, j bigint, before bigint", both=True).groupBy("graph_id", "i", "j").agg((F.sum("before") + 1).alias("rh"))
    late = ranks.join(n, "graph_id").groupBy("graph_id", "n", "k").agg(F.sum(F.greatest(F.col("rh") - F.col("k"), F.lit(0))).alias("late"))
    size = F.col("n") * F.col("k") * (2 * F.col("n") - 3 * F.col("k") - 1)
    return late.select("graph_id", "n", "k", (1 - 2 * F.col("late") / size).alias("trustworthiness"))
