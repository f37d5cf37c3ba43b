"""The registered queries of the library and the SQL that checks them.

Each query is an operator on a whole view of the given tables; values are rounded to six digits where engines sum in
another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoeval.functions import scalars as X
from topoeval.functions.lineage import cut
from topoeval.operators import checks, components, evaluate, graph, linalg, models, motifs, perturb, proximity, resample, rewire, select, similarity, splits, stats
from topoeval.operators import summaries as S
from topoeval.plans import fixtures as V
from topoeval.plans.fixtures import SQL_EDGES, SQL_PLANE, SQL_RING, SQL_RUNS, SQL_SCORES, SQL_SIMS, sql_mixed, sql_seed, sql_uniform

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["dataset", "backbone", "seed"]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})  # no negative zeros


def _en(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return V.co_purchases(s, d), V.part_nodes(s, d)


# --- graphs -------------------------------------------------------------------------------


@query("canonical_edges", "WITH e AS (SELECT DISTINCT l_returnflag AS graph_id, least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey != l_suppkey) SELECT * FROM e")
def _(s, d):
    return graph.canonical_edges(V.read(s, d, "lineitem").select(F.col("l_returnflag").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("degree_stats", f"""WITH {SQL_EDGES} SELECT graph_id, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 6) AS degree_avg, round(stddev_pop(degree), 6) AS degree_std,
round(var_pop(degree), 6) AS degree_var, max(degree) AS degree_max, count(*) FILTER (degree = 0) AS n_isolated, round((sum(degree) / (count(*) * (count(*) - 1.0)))::DOUBLE, 6) AS density,
round(stddev_pop(degree) / avg(degree), 6) AS degree_cv FROM d GROUP BY 1""")  # fmt: skip
def _(s, d):
    return r6(graph.basic_metrics(*_en(s, d)), "degree_avg", "degree_std", "degree_var", "density", "degree_cv")


@query("degree_histogram", f"WITH {SQL_EDGES} SELECT graph_id, degree, count(*) AS n_nodes FROM d GROUP BY 1, 2")
def _(s, d):
    return graph.degree_histogram(*_en(s, d))


@query("degree_features", f"WITH {SQL_EDGES} SELECT graph_id, id, degree::DOUBLE AS f0, round(ln(1 + degree), 6) AS f1, (degree = 0)::INT::DOUBLE AS f2 FROM d")
def _(s, d):
    return graph.degree_features(*_en(s, d)).select("graph_id", "id", *[F.round(F.col("features")[k], 6).alias(f"f{k}") for k in range(3)])


@query("edge_homophily", f"WITH {SQL_EDGES} SELECT graph_id, round(avg((x.part = y.part)::INT), 6) AS homophily FROM e JOIN n x USING (graph_id) JOIN n y USING (graph_id) WHERE x.id = src AND y.id = dst GROUP BY 1")
def _(s, d):
    return r6(graph.edge_homophily(*_en(s, d), "part"), "homophily")


SQL_TRI = """t AS (SELECT x.graph_id, x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.graph_id = y.graph_id AND x.dst = y.src JOIN e z ON z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst),
tn AS (SELECT graph_id, unnest([a, b, c]) AS id FROM t), tc AS (SELECT graph_id, id, count(*) AS k FROM tn GROUP BY 1, 2),
cl AS (SELECT graph_id, id, degree, coalesce(k, 0) AS k, CASE WHEN degree > 1 THEN 2.0 * coalesce(k, 0) / (degree * (degree - 1)) ELSE 0 END AS c FROM d LEFT JOIN tc USING (graph_id, id))"""


@query("triangles_clustering", f"""WITH {SQL_EDGES}, {SQL_TRI} SELECT graph_id, (sum(k) / 3)::BIGINT AS n_triangles, round(avg(c), 6) AS average_clustering,
round(sum(k) / sum(degree * (degree - 1) / 2.0), 6) AS transitivity FROM cl GROUP BY 1""")
def _(s, d):
    return r6(motifs.clustering(*_en(s, d)), "average_clustering", "transitivity")


@query("degree_assortativity", f"WITH {SQL_EDGES} SELECT graph_id, round(corr(x.degree, y.degree), 6) AS assortativity FROM b JOIN d x USING (graph_id) JOIN d y USING (graph_id) WHERE x.id = src AND y.id = dst GROUP BY 1")
def _(s, d):
    return r6(motifs.degree_assortativity(*_en(s, d)), "assortativity")


@query("connected_components", f"""WITH RECURSIVE {SQL_EDGES}, r AS (SELECT graph_id, id, id AS m FROM n UNION SELECT r.graph_id, b.dst, r.m FROM r JOIN b ON b.graph_id = r.graph_id AND b.src = r.id WHERE r.m < b.dst)
SELECT graph_id, id, min(m) AS component FROM r GROUP BY 1, 2""".replace(" WHERE r.m < b.dst", ""))
def _(s, d):
    return components.connected_components(*_en(s, d))


def _sources(s, d, k=8) -> DataFrame:
    return components.sampled_nodes(V.part_nodes(s, d), k, 5)


SQL_SOURCES = f"src0 AS (SELECT graph_id, id FROM (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY {sql_uniform('5', 'id')}, id) AS k FROM n) WHERE k <= 8)"


@query("bfs_distance_hist", f"""WITH RECURSIVE {SQL_EDGES}, {SQL_SOURCES}, r AS (SELECT graph_id, id AS source, id, 0 AS hops FROM src0
UNION SELECT r.graph_id, r.source, b.dst, r.hops + 1 FROM r JOIN b ON b.graph_id = r.graph_id AND b.src = r.id WHERE r.hops < 24),
m AS (SELECT graph_id, source, id, min(hops) AS hops FROM r GROUP BY 1, 2, 3) SELECT graph_id, hops, count(*) AS n FROM m GROUP BY 1, 2""")
def _(s, d):
    seen = components.bfs_distances(V.co_purchases(s, d), _sources(s, d))
    return seen.groupBy("graph_id", "hops").agg(F.count("*").alias("n"))


@query("modularity_brand", f"""WITH {SQL_EDGES}, m AS (SELECT graph_id, count(*) AS m FROM e GROUP BY 1), i AS (SELECT e.graph_id, x.part, count(*) AS k FROM e JOIN n x ON x.graph_id = e.graph_id AND x.id = src
JOIN n y ON y.graph_id = e.graph_id AND y.id = dst WHERE x.part = y.part GROUP BY 1, 2), v AS (SELECT graph_id, part, sum(degree) AS v FROM d JOIN n USING (graph_id, id) GROUP BY 1, 2)
SELECT graph_id, round(sum(coalesce(k, 0) / m - (v / (2.0 * m)) ^ 2), 6) AS modularity, count(*) AS n_parts FROM v JOIN m USING (graph_id) LEFT JOIN i USING (graph_id, part) GROUP BY 1""")
def _(s, d):
    return r6(graph.modularity(*_en(s, d)), "modularity")


@query("cut_metrics_brand", f"""WITH {SQL_EDGES}, q AS (SELECT b.graph_id, x.part, x.part != y.part AS c FROM b JOIN n x ON x.graph_id = b.graph_id AND x.id = src JOIN n y ON y.graph_id = b.graph_id AND y.id = dst)
SELECT graph_id, part, min_degree, n_nodes, coalesce(volume, 0) AS volume, coalesce(cut_edges, 0) AS cut_edges, coalesce(inner_edges, 0) AS inner_edges
FROM (SELECT graph_id, part, min(degree) AS min_degree, count(*) AS n_nodes FROM d JOIN n USING (graph_id, id) GROUP BY 1, 2)
LEFT JOIN (SELECT graph_id, part, count(*) AS volume, count(*) FILTER (c) AS cut_edges, (count(*) FILTER (NOT c) / 2)::BIGINT AS inner_edges FROM q GROUP BY 1, 2) USING (graph_id, part)""")
def _(s, d):
    return graph.cut_metrics(*_en(s, d))


@query("balanced_forman", f"""WITH {SQL_EDGES},
tt AS (SELECT e.graph_id, e.src, e.dst, count(*) AS t FROM e JOIN b x ON x.graph_id = e.graph_id AND x.src = e.src JOIN b y ON y.graph_id = e.graph_id AND y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2, 3),
q AS (SELECT e.graph_id, e.src, e.dst, x.dst AS a, y.dst AS c FROM e JOIN b x ON x.graph_id = e.graph_id AND x.src = e.src AND x.dst != e.dst
JOIN b y ON y.graph_id = e.graph_id AND y.src = x.dst AND y.dst != e.src JOIN b z ON z.graph_id = e.graph_id AND z.src = e.dst AND z.dst = y.dst
WHERE NOT EXISTS (SELECT 1 FROM b w WHERE w.graph_id = e.graph_id AND w.src = e.dst AND w.dst = x.dst) AND NOT EXISTS (SELECT 1 FROM b w WHERE w.graph_id = e.graph_id AND w.src = e.src AND w.dst = y.dst)),
g1 AS (SELECT graph_id, src, dst, a, count(*) AS k FROM q GROUP BY ALL), g2 AS (SELECT graph_id, src, dst, c, count(*) AS k FROM q GROUP BY ALL),
sq AS (SELECT graph_id, src, dst, s1 + s2 AS sq, greatest(m1, m2) AS gam FROM (SELECT graph_id, src, dst, count(*) AS s1, max(k) AS m1 FROM g1 GROUP BY 1, 2, 3) JOIN (SELECT graph_id, src, dst, count(*) AS s2, max(k) AS m2 FROM g2 GROUP BY 1, 2, 3) USING (graph_id, src, dst))
SELECT e.graph_id, e.src, e.dst, round(CASE WHEN least(x.degree, y.degree) <= 1 THEN 0 ELSE 2.0 / x.degree + 2.0 / y.degree - 2 + 2.0 * coalesce(t, 0) / greatest(x.degree, y.degree)
+ 1.0 * coalesce(t, 0) / least(x.degree, y.degree) + coalesce(1.0 * sq / (gam * greatest(x.degree, y.degree)), 0) END, 6) + 0.0::DOUBLE AS curvature
FROM e JOIN d x ON x.graph_id = e.graph_id AND x.id = e.src JOIN d y ON y.graph_id = e.graph_id AND y.id = e.dst
LEFT JOIN tt ON tt.graph_id = e.graph_id AND tt.src = e.src AND tt.dst = e.dst LEFT JOIN sq ON sq.graph_id = e.graph_id AND sq.src = e.src AND sq.dst = e.dst""")
def _(s, d):
    e, n = _en(s, d)
    return r6(motifs.balanced_forman(cut(e), n), "curvature")


def _year_edges(s, d, flag: str) -> DataFrame:
    e = V.co_purchases(s, d)
    return e.filter(F.col("graph_id") == flag).withColumn("graph_id", F.lit("g"))


@query("edge_set_diff", f"""WITH {SQL_EDGES}, f AS (SELECT coalesce(x.src, y.src) AS s, x.src IS NOT NULL AS c, y.src IS NOT NULL AS o FROM (FROM e WHERE graph_id = 'R') x FULL JOIN (FROM e WHERE graph_id = 'A') y ON x.src = y.src AND x.dst = y.dst)
SELECT 'g' AS graph_id, count(*) FILTER (c) AS n_clean, count(*) FILTER (o) AS n_observed, count(*) FILTER (c AND o) AS n_both, count(*) AS n_any,
round(count(*) FILTER (c AND o) / greatest(count(*), 1), 6) AS jaccard, round((count(*) - count(*) FILTER (c AND o)) / greatest(2 * count(*) FILTER (c), 1), 6) AS changed_fraction FROM f""")
def _(s, d):
    return r6(graph.edge_set_diff(_year_edges(s, d, "R"), _year_edges(s, d, "A")), "jaccard", "changed_fraction")


@query("normalized_edges", f"""WITH {SQL_EDGES}, l AS (SELECT * FROM b UNION SELECT graph_id, id, id FROM n) SELECT l.graph_id, l.src, l.dst, round(1 / sqrt((x.degree + 1) * (y.degree + 1)), 6) AS weight
FROM l JOIN d x ON x.graph_id = l.graph_id AND x.id = src JOIN d y ON y.graph_id = l.graph_id AND y.id = dst""")
def _(s, d):
    return r6(graph.normalized_edges(*_en(s, d)), "weight")


@query("propagate_mean", f"""WITH {SQL_EDGES}, l AS (SELECT * FROM b UNION SELECT graph_id, id, id FROM n) SELECT l.graph_id, src AS id, round(avg(x.degree), 6) AS f0, round(avg((x.degree = 0)::INT), 6) AS f1
FROM l JOIN d x ON x.graph_id = l.graph_id AND x.id = dst GROUP BY 1, 2""")
def _(s, d):
    e, n = _en(s, d)
    x = graph.degrees(e, n).select("graph_id", "id", F.array(F.col("degree").cast("double"), (F.col("degree") == 0).cast("double")).alias("features"))
    out = linalg.propagate_features(e, x, 2, 1, "mean")
    return out.select("graph_id", "id", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"))


@query("spmv_degree", "WITH e AS (SELECT DISTINCT l_partkey AS src, 1000000 + l_suppkey AS dst FROM lineitem), w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT 'ps' AS graph_id, src AS id, sum(dst % 7)::DOUBLE AS x FROM w GROUP BY src")
def _(s, d):
    w = V.supplied(s, d)
    x = w.select("graph_id", F.col("src").alias("id"), (F.col("src") % 7).cast("double").alias("x")).distinct()
    return linalg.spmv(w, x)


@query("label_propagation")
def _(s, d):
    return components.label_propagation(*_en(s, d), rounds=3)


# --- similarity, proximity, rewiring ------------------------------------------------------


@query("pairwise_cosine_topk", f"WITH {SQL_SIMS}, t AS (SELECT src AS id, dst AS neighbor, sim FROM s UNION ALL SELECT dst, src, sim FROM s) SELECT 'all' AS graph_id, id, neighbor, round(1 - sim, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(1 - sim, 10), neighbor) AS r FROM t) WHERE r <= 5")
def _(s, d):
    return r6(similarity.knn(V.vectors(s, d), 5, metric="cosine"), "distance")


SQL_KNN = """dd AS (SELECT x.id AS id, y.id AS neighbor, round(list_distance(x.a, y.a), 10) AS distance FROM v x JOIN v y ON x.id != y.id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS r FROM dd) WHERE r <= 8),
ke AS (SELECT least(id, neighbor) AS src, greatest(id, neighbor) AS dst, min(distance) AS distance, count(*) > 1 AS mutual FROM nn GROUP BY 1, 2)"""


@query("knn_mutual", f"WITH {SQL_SIMS}, {SQL_KNN} SELECT 'all' AS graph_id, src, dst, round(distance, 6) AS distance, mutual FROM ke WHERE mutual")
def _(s, d):
    return r6(similarity.knn_edges(similarity.knn(V.vectors(s, d), 8), True), "distance")


@query("radius_budget", f"WITH {SQL_SIMS}, {SQL_KNN.split('nn AS')[0].rstrip().rstrip(',')} SELECT 'all' AS graph_id, count(*) AS n_edges, round(max(distance), 6) AS cutoff FROM (SELECT * FROM dd WHERE id < neighbor ORDER BY distance, id, neighbor LIMIT 300)")
def _(s, d):
    return r6(similarity.radius_graph(V.vectors(s, d), 300)[1], "cutoff")


@query("anchor_similarity", f"""WITH {SQL_SIMS}, an AS (SELECT id FROM v ORDER BY {sql_uniform('3', 'id')}, id LIMIT 16),
t AS (SELECT v.id, an.id AS anchor, greatest(round(list_dot_product(v.a, w.a) / (v.l * w.l), 10), 0) AS sim FROM v, an JOIN v w ON w.id = an.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, anchor) AS r FROM t) WHERE r <= 4)
SELECT 'all' AS graph_id, id, anchor, round(CASE WHEN sum(sim) OVER (PARTITION BY id) > 0 THEN sim / sum(sim) OVER (PARTITION BY id) ELSE 0 END, 6) AS weight FROM k""")
def _(s, d):
    return r6(similarity.anchor_similarity(V.vectors(s, d), 16, 4, seed=3), "weight")


@query("trustworthiness", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, embedding[1:2]::DOUBLE[] AS c FROM embeddings),
q AS (SELECT x.id AS i, y.id AS j, round(list_sum([(p - q) ^ 2 FOR p, q IN []]) , 10) AS z FROM v x, v y WHERE false),
t AS (SELECT x.id AS i, y.id AS j, round(list_distance(x.a, y.a) ^ 2, 8) AS dh, round(list_distance(x.c, y.c) ^ 2, 8) AS dl FROM v x JOIN v y ON x.id != y.id),
w AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dh, j) AS rh, row_number() OVER (PARTITION BY i ORDER BY dl, j) AS rl FROM t), c AS (SELECT count(*) AS n FROM v)
SELECT 'all' AS graph_id, n, 10 AS k, round(1 - 2.0 * sum(greatest(rh - 10, 0)) / (n * 10 * (2 * n - 31)), 4) AS trustworthiness FROM w, c WHERE rl <= 10 GROUP BY n""".replace("q AS (SELECT x.id AS i, y.id AS j, round(list_sum([(p - q) ^ 2 FOR p, q IN []]) , 10) AS z FROM v x, v y WHERE false),\n", ""))
def _(s, d):
    p = V.vectors(s, d).withColumn("projection", F.slice("embedding", 1, 2))
    out = similarity.trustworthiness(p, 10, sample=1_000_000)
    return out.select("graph_id", "n", F.col("k").cast("int").alias("k"), F.round("trustworthiness", 4).alias("trustworthiness"))


SQL_PAIRS = "pr AS (SELECT a.graph_id, a.id AS src, b.id AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS w FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.id < b.id)"


@query("gabriel", f"""WITH {SQL_PLANE}, {SQL_PAIRS} SELECT graph_id, src, dst, round(w, 6) AS weight FROM pr WHERE NOT EXISTS (SELECT 1 FROM p t WHERE t.graph_id = pr.graph_id AND t.id NOT IN (src, dst)
AND sqrt((t.x - (ax + bx) / 2) ^ 2 + (t.y - (ay + b_y) / 2) ^ 2) < w / 2 - 1e-13)""")
def _(s, d):
    return r6(proximity.gabriel_graph(V.plane(s, d)), "weight")


@query("rng", f"""WITH {SQL_PLANE}, {SQL_PAIRS} SELECT graph_id, src, dst, round(w, 6) AS weight FROM pr WHERE NOT EXISTS (SELECT 1 FROM p t WHERE t.graph_id = pr.graph_id AND t.id NOT IN (src, dst)
AND greatest(sqrt((t.x - ax) ^ 2 + (t.y - ay) ^ 2), sqrt((t.x - bx) ^ 2 + (t.y - b_y) ^ 2)) < w - 1e-13)""")
def _(s, d):
    return r6(proximity.rng_graph(V.plane(s, d)), "weight")


@query("delaunay", f"""WITH {SQL_PLANE}, tr AS (SELECT a.graph_id, a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, c.x AS cx, c.y AS cy, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS dd
FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.id < b.id JOIN p c ON c.graph_id = a.graph_id AND b.id < c.id),
o AS (SELECT *, ((ax * ax + ay * ay) * (b_y - cy) + (bx * bx + b_y * b_y) * (cy - ay) + (cx * cx + cy * cy) * (ay - b_y)) / dd AS ox,
((ax * ax + ay * ay) * (cx - bx) + (bx * bx + b_y * b_y) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / dd AS oy FROM tr WHERE dd != 0),
g AS (SELECT graph_id, i, j, k FROM o WHERE NOT EXISTS (SELECT 1 FROM p t WHERE t.graph_id = o.graph_id AND t.id NOT IN (i, j, k) AND (t.x - ox) ^ 2 + (t.y - oy) ^ 2 < ((ax - ox) ^ 2 + (ay - oy) ^ 2) * (1 - 1e-10))),
x AS (SELECT graph_id, i AS src, j AS dst FROM g UNION SELECT graph_id, i, k FROM g UNION SELECT graph_id, j, k FROM g)
SELECT x.graph_id, src, dst, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) AS weight FROM x JOIN p a ON a.graph_id = x.graph_id AND a.id = src JOIN p b ON b.graph_id = x.graph_id AND b.id = dst""")
def _(s, d):
    return r6(proximity.delaunay_edges(V.plane(s, d)), "weight")


SQL_REWIRE = f"""{SQL_SIMS}, {SQL_RING}, sz AS (SELECT (SELECT count(*) FROM v) AS nn, (SELECT count(*) FROM ring) AS m),
rt AS (SELECT ratio, nn, m, floor(m * ratio)::BIGINT AS k FROM sz, (VALUES (0.1::DOUBLE), (0.25), (0.4), (0.55)) t(ratio)),
c AS (SELECT *, floor(least(nn * nn, greatest(10 * k, 3 * m)) / 2) AS pool FROM rt),
ed AS (SELECT src, dst, sim, row_number() OVER (ORDER BY sim, src, dst) AS r FROM ring JOIN s USING (src, dst)),
po AS (SELECT src, dst, row_number() OVER (ORDER BY sim DESC, src, dst) AS p FROM s),
st AS (SELECT ratio, src, dst FROM ed, c WHERE r > k),
fr AS (SELECT c.ratio, po.src, po.dst, po.p, c.k FROM po, c WHERE p <= pool AND NOT EXISTS (SELECT 1 FROM st WHERE st.ratio = c.ratio AND st.src = po.src AND st.dst = po.dst)),
ad AS (SELECT ratio, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY p) AS a FROM fr) WHERE a <= k)"""


@query("rewire_similarity_r25", f"WITH {SQL_REWIRE} SELECT 'all' AS graph_id, src, dst, false AS added FROM st WHERE ratio = 0.25 UNION ALL SELECT 'all', src, dst, true FROM ad WHERE ratio = 0.25")
def _(s, d):
    return rewire.rewire_by_similarity(V.ring_edges(s, d), V.vectors(s, d), 0.25)


@query("rewire_grid_counts", f"WITH {SQL_REWIRE} SELECT 'all' AS graph_id, ratio, count(*) AS n_edges, sum(a)::BIGINT AS n_added FROM (SELECT ratio, 0 AS a FROM st UNION ALL SELECT ratio, 1 FROM ad) GROUP BY 2")
def _(s, d):
    g = rewire.rewire_grid(V.ring_edges(s, d), V.vectors(s, d), [0.1, 0.25, 0.4, 0.55])
    return g.groupBy("graph_id", "ratio").agg(F.count("*").alias("n_edges"), F.count_if("added").alias("n_added"))


@query("homophily_attack_removed", f"""WITH {SQL_EDGES}, m AS (SELECT graph_id, floor(count(*) * 0.01 + 0.5) AS ask FROM e GROUP BY 1), q AS (SELECT e.*, row_number() OVER (PARTITION BY e.graph_id ORDER BY {sql_uniform('7', 'src', 'dst')}, src, dst) AS r
FROM e JOIN n x ON x.graph_id = e.graph_id AND x.id = src JOIN n y ON y.graph_id = e.graph_id AND y.id = dst WHERE x.part = y.part) SELECT q.graph_id, src, dst FROM q JOIN m USING (graph_id) WHERE r <= ask""")
def _(s, d):
    e, n = _en(s, d)
    return perturb.homophily_attack_removed(e, n.select("graph_id", "id", F.col("part").alias("label")), 0.01, 7)


@query("degree_preserving_swap")
def _(s, d):
    e, n = _en(s, d)
    e = cut(e)
    out = perturb.degree_preserving_swap(e, 0.2, 3)
    return perturb.perturbation_report(e, out, n.select("graph_id", "id", F.col("part").alias("label")))


# --- splits and evaluation ----------------------------------------------------------------


def _quota_sql(parts: list[tuple[str, float]], last: str) -> str:
    out, bound = "CASE", "0"
    for name, f in parts:
        bound += f" + greatest(1, floor(c * {f} + 0.5))"
        out += f" WHEN r <= {bound} THEN '{name}'"
    return f"{out} ELSE '{last}' END"


@query("nested_split", f"""WITH q AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_uniform('42', 'vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS c FROM embeddings)
SELECT id, label, {_quota_sql([('train', 0.6), ('inner_val', 0.1), ('topology_val', 0.1)], 'test')} AS split FROM q""")
def _(s, d):
    return splits.nested_split(V.vectors(s, d), seed=42).select("id", "label", "split")


@query("stratified_split", f"""WITH q AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_uniform('1', 'vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS c FROM embeddings)
SELECT id, label, {_quota_sql([('train', 0.6), ('val', 0.2)], 'test')} AS split FROM q""")
def _(s, d):
    return splits.stratified_split(V.vectors(s, d), seed=1).select("id", "label", "split")


@query("group_folds", f"""WITH {SQL_SCORES}, g AS (SELECT source, round(avg(y))::INT AS y, count(*) AS n FROM sc GROUP BY 1), r AS (SELECT source, (row_number() OVER (ORDER BY y, n DESC, source) - 1) % 8 AS k FROM g)
SELECT source, CASE WHEN k < 4 THEN k ELSE 7 - k END::INT AS fold FROM r""")
def _(s, d):
    return splits.group_folds(V.scores(s, d), "source", 4, "y")


@query("macro_f1", f"""WITH {SQL_SCORES}, q AS (SELECT lang, y, (p >= 0.6)::INT AS pred FROM sc), c AS (SELECT DISTINCT lang, y AS c FROM q UNION SELECT DISTINCT lang, pred FROM q),
f AS (SELECT c.lang, c.c, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (y = c) AS a, count(*) FILTER (pred = c) AS b FROM c JOIN q USING (lang) GROUP BY 1, 2)
SELECT lang, round(sum(tp) / sum(a), 6) AS accuracy, round(avg(2.0 * tp / (a + b)), 6) AS macro_f1, sum(a)::BIGINT AS n FROM f GROUP BY 1""")
def _(s, d):
    x = V.scores(s, d).withColumn("pred", (F.col("p") >= 0.6).cast("int"))
    return r6(evaluate.macro_f1(x, ["lang"]), "accuracy", "macro_f1")


SQL_AUC = """ra AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM sc)"""


@query("binary_metrics", f"""WITH {SQL_SCORES}, {SQL_AUC}, c AS (SELECT lang, count(*) FILTER (y = 1 AND p >= 0.6) AS tp, count(*) FILTER (y = 0 AND p >= 0.6) AS fp, count(*) FILTER (y = 0 AND p < 0.6) AS tn, count(*) FILTER (y = 1 AND p < 0.6) AS fn,
round(avg((p - y) ^ 2), 6) AS brier, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM ra GROUP BY 1),
z AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rec, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS spec FROM c)
SELECT lang, tp, fp, tn, fn, brier, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((rec + spec) / 2, 6) AS balanced_accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(spec, 6) AS specificity, round(CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END, 6) AS bad_recommendation, round(auc, 6) AS auc FROM z""")
def _(s, d):
    m = evaluate.binary_metrics(V.scores(s, d), threshold=0.6, keys=["lang"], brier=True)
    return r6(m, "brier", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity", "bad_recommendation", "auc")


SQL_ROC = """ct AS (SELECT lang, p AS t, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM sc GROUP BY 1, 2),
roc AS (SELECT lang, t, sum(n1) OVER w AS tp, sum(n0) OVER w AS fp, sum(n1) OVER (PARTITION BY lang) AS pp, sum(n0) OVER (PARTITION BY lang) AS nn FROM ct WINDOW w AS (PARTITION BY lang ORDER BY t DESC ROWS UNBOUNDED PRECEDING))"""


@query("youden", f"WITH {SQL_SCORES}, {SQL_ROC}, j AS (SELECT lang, t, round(tp / greatest(pp, 1) - fp / greatest(nn, 1), 12) AS j FROM roc) SELECT lang, t AS threshold, round(j, 6) AS youden FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY j DESC, t DESC) AS r FROM j) WHERE r = 1")
def _(s, d):
    return r6(evaluate.youden_threshold(V.scores(s, d), "y", "p", ["lang"]), "youden")


@query("cost_threshold", f"""WITH {SQL_SCORES}, t AS (SELECT DISTINCT p AS t FROM sc UNION SELECT 0.01::DOUBLE UNION SELECT 0.99::DOUBLE),
c AS (SELECT t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn FROM t, sc GROUP BY 1)
SELECT t AS threshold, 2.0 * fp + fn AS cost, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision FROM c ORDER BY 2, 3 DESC, 1 LIMIT 1""")
def _(s, d):
    return r6(evaluate.cost_threshold(V.scores(s, d), "y", "p"), "precision")


@query("avoid_threshold", f"""WITH {SQL_SCORES}, t AS (SELECT DISTINCT p AS t FROM sc), c AS (SELECT t, count(*) FILTER (p <= t) AS cov, count(*) FILTER (p <= t AND y = 1) AS miss, count(*) AS n FROM t, sc GROUP BY 1)
SELECT round(coalesce((SELECT max(t) FROM c WHERE cov >= greatest(5, n * 0.05) AND miss <= 0.1 * cov), (SELECT quantile_cont(p, 0.25) FROM sc WHERE y = 0)), 6) AS threshold""")
def _(s, d):
    return r6(evaluate.avoid_threshold(V.scores(s, d), "y", "p"), "threshold")


# --- selection ----------------------------------------------------------------------------


@query("validation_select", f"""WITH {SQL_RUNS} SELECT dataset, backbone, seed, candidate, val_f1 AS val, test_f1 AS test, bv AS baseline_val, bt AS baseline_test, round(val_f1 - bv, 6) AS gain_val, round(test_f1 - bt, 6) AS gain_test
FROM best LEFT JOIN base USING (dataset, backbone, seed)""")
def _(s, d):
    return r6(select.validation_select(V.runs(s, d)), "gain_val", "gain_test")


@query("select_with_fallback", f"""WITH {SQL_RUNS}, q AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed ORDER BY val_f1 DESC, (candidate = 1) DESC, candidate) AS r FROM runs SEMI JOIN base USING (dataset, backbone, seed))
SELECT dataset, backbone, seed, candidate, val_f1 AS val, candidate = 1 AS fallback, test_f1 AS test FROM q WHERE r = 1""")
def _(s, d):
    return select.select_with_fallback(V.runs(s, d))


@query("margin_gate", f"""WITH {SQL_RUNS}, g AS (SELECT base.*, best.candidate AS c, best.val_f1 AS cv, coalesce(round(100 * (best.val_f1 - bv), 6) >= 1.0, false) AS adopted FROM base LEFT JOIN best USING (dataset, backbone, seed)),
f AS (SELECT *, CASE WHEN adopted THEN c ELSE 1 END AS candidate FROM g) SELECT dataset, backbone, seed, candidate, adopted, round(100 * (test_f1 - bt), 6) AS gain_pp FROM f JOIN runs USING (dataset, backbone, seed, candidate)""")
def _(s, d):
    return r6(select.margin_gate(V.runs(s, d), 1.0), "gain_pp").select(*KEYS, "candidate", "adopted", "gain_pp")


@query("gate_sweep", f"""WITH {SQL_RUNS}, g AS (SELECT margin, coalesce(round(100 * (best.val_f1 - bv), 6) >= margin, false) AS a, CASE WHEN coalesce(round(100 * (best.val_f1 - bv), 6) >= margin, false) THEN 100 * (test_f1 - bt) ELSE 0 END AS gain
FROM base LEFT JOIN best USING (dataset, backbone, seed), (VALUES (0::DOUBLE), (0.5), (1), (2), (3)) t(margin))
SELECT margin, count(*) AS n, round(avg(a::INT), 6) AS adopted, round(avg(gain), 6) AS mean_gain_pp, round(avg((gain > 0)::INT), 6) AS positive FROM g GROUP BY 1""")
def _(s, d):
    return r6(select.gate_sweep(V.runs(s, d)), "adopted", "mean_gain_pp", "positive")


@query("selection_regret", f"""WITH {SQL_RUNS}, o AS (SELECT dataset, backbone, seed, max(test_f1) AS ot FROM runs GROUP BY 1, 2, 3), r AS (SELECT backbone, round(100 * (ot - test_f1), 6) AS regret FROM best JOIN o USING (dataset, backbone, seed))
SELECT backbone, count(*) AS n, round(avg(regret), 6) AS mean, round(quantile_cont(regret, 0.5), 6) AS median, round(quantile_cont(regret, 0.9), 6) AS p90, round(avg((abs(regret) < 1e-10)::INT), 6) AS hit_rate FROM r GROUP BY 1""")
def _(s, d):
    runs = V.runs(s, d)
    r = select.selection_regret(runs, select.validation_select(runs)).withColumn("regret_pp", F.round("regret_pp", 6))
    return r6(select.regret_summary(r, ["backbone"]), "mean", "median", "p90", "hit_rate")


@query("best_candidates_wide", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, max(val_f1) FILTER (candidate = 2) AS c2_val, max(val_f1) FILTER (candidate = 3) AS c3_val, max(val_f1) FILTER (candidate = 4) AS c4_val, max(val_f1) FILTER (candidate = 5) AS c5_val FROM runs GROUP BY 1, 2, 3")
def _(s, d):
    runs = V.runs(s, d)
    return select.best_candidates_wide(runs.withColumn("constructor", F.col("candidate")), KEYS, "constructor", [2, 3, 4, 5])


@query("gain_decomposition", f"""WITH {SQL_RUNS}, o AS (SELECT dataset, backbone, seed, bt FROM base), g AS (SELECT dataset, backbone, seed, test_f1 AS g FROM runs WHERE candidate = 2),
f AS (SELECT dataset, backbone, seed, arg_max(test_f1, (val_f1, -candidate)) AS f FROM runs WHERE candidate > 2 GROUP BY 1, 2, 3)
SELECT dataset, backbone, seed, round(g - bt, 6) AS gain_geometry, round(f - g, 6) AS gain_refinement, round(test_f1 - bt, 6) AS gain_total FROM o LEFT JOIN g USING (dataset, backbone, seed) LEFT JOIN f USING (dataset, backbone, seed) LEFT JOIN best USING (dataset, backbone, seed)""")
def _(s, d):
    return r6(select.gain_decomposition(V.runs(s, d)), "gain_geometry", "gain_refinement", "gain_total")


@query("threshold_sweep", f"""WITH {SQL_SCORES} SELECT t AS threshold, round(avg((p <= t)::INT), 6) AS coverage, round(avg(y - 0.5) FILTER (p <= t), 6) AS mean_gain, round(quantile_cont(y - 0.5, 0.5) FILTER (p <= t), 6) AS median_gain,
round(avg((y > 0.5)::INT) FILTER (p <= t), 6) AS success_low, round(avg((y > 0.5)::INT) FILTER (p > t), 6) AS success_high FROM sc, (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) v(t) GROUP BY 1""")
def _(s, d):
    x = V.scores(s, d).withColumn("g", F.col("y") - F.lit(0.5))
    return r6(select.threshold_sweep(x, "p", "g", [0.3, 0.5, 0.7, 0.9]), "coverage", "mean_gain", "median_gain", "success_low", "success_high")


# --- summaries ----------------------------------------------------------------------------


def _selected(s, d) -> DataFrame:
    c = select.validation_select(V.runs(s, d)).filter("baseline_test is not null")
    return c.withColumnsRenamed({"baseline_test": "baseline", "candidate": "ratio"}).withColumn("gain", F.round(F.col("test") - F.col("baseline"), 6))


SQL_SEL = f"{SQL_RUNS}, sel AS (SELECT dataset, backbone, seed, candidate AS ratio, bt AS baseline, test_f1 AS test, round(test_f1 - bt, 6) AS gain FROM best JOIN base USING (dataset, backbone, seed))"


@query("dataset_level_gain", f"""WITH {SQL_SEL}, x AS (SELECT dataset, backbone, avg(baseline) AS b, avg(test) AS t, avg(test - baseline) AS g FROM sel GROUP BY 1, 2), m AS (SELECT dataset, ratio, count(*) AS n FROM sel GROUP BY 1, 2)
SELECT dataset, round(avg(b), 6) AS baseline, round(avg(t), 6) AS test, round(avg(g), 6) AS gain, round(max(g), 6) AS best_backbone_gain, round(min(g), 6) AS worst_backbone_gain, (SELECT ratio FROM m WHERE m.dataset = x.dataset ORDER BY n DESC, ratio LIMIT 1) AS mode_ratio FROM x GROUP BY 1""")
def _(s, d):
    return r6(S.dataset_level_gain(_selected(s, d)), "baseline", "test", "gain", "best_backbone_gain", "worst_backbone_gain")


@query("graph_outcomes", f"WITH {SQL_SEL} SELECT dataset, backbone, round(avg(gain), 6) AS gain_mean, round(stddev_samp(gain), 6) AS gain_std, count(*) AS n, round(avg((gain > 0)::INT), 6) AS positive_fraction FROM sel GROUP BY 1, 2")
def _(s, d):
    return r6(S.graph_outcomes(_selected(s, d), ["dataset", "backbone"]), "gain_mean", "gain_std", "positive_fraction")


@query("metric_summary", f"WITH {SQL_RUNS} SELECT backbone, candidate, round(avg(test_f1), 6) AS mean, round(stddev_pop(test_f1), 6) AS std, round(1.96 * stddev_pop(test_f1) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM runs GROUP BY 1, 2")
def _(s, d):
    return r6(S.metric_summary(V.runs(s, d), ["backbone", "candidate"], "test_f1"), "mean", "std", "ci95")


@query("stratified_summary", f"""WITH {SQL_SEL}, l AS (SELECT gain, unnest([{{'d': 'dataset', 'l': dataset}}, {{'d': 'backbone', 'l': backbone}}, {{'d': 'ratio', 'l': ratio::VARCHAR}}]) AS s FROM sel)
SELECT s.d AS dimension, s.l AS level, count(*) AS n, round(avg(gain), 6) AS mean, round(quantile_cont(gain, 0.5), 6) AS median, round(avg((gain > 0)::INT), 6) AS positive_fraction FROM l GROUP BY 1, 2""")
def _(s, d):
    return r6(S.stratified_summary(_selected(s, d), ["dataset", "backbone", "ratio"], "gain"), "mean", "median", "positive_fraction")


@query("choice_frequency", f"WITH {SQL_SEL}, c AS (SELECT backbone, ratio, count(*) AS n FROM sel GROUP BY 1, 2) SELECT backbone, ratio, n, round(n / sum(n) OVER (PARTITION BY backbone), 6) AS fraction FROM c")
def _(s, d):
    return r6(S.choice_frequency(_selected(s, d), "backbone", "ratio"), "fraction")


@query("effect_summary", f"""WITH {SQL_SEL}, g AS (SELECT dataset, round(100 * gain, 4) AS g FROM sel) SELECT dataset, count(*) AS n, round(avg(g), 6) AS mean, round(quantile_cont(g, 0.5), 6) AS median, round(quantile_cont(g, 0.025), 6) AS q025, round(quantile_cont(g, 0.975), 6) AS q975,
round(avg((g > 0)::INT), 6) AS positive, round(avg((g > 0.5)::INT), 6) AS above_05, round(avg((g > 1)::INT), 6) AS above_10 FROM g GROUP BY 1""")
def _(s, d):
    x = _selected(s, d).withColumn("g", F.round(100 * F.col("gain"), 4))
    return r6(S.effect_summary(x, ["dataset"], "g"), "mean", "median", "q025", "q975", "positive", "above_05", "above_10")


SQL_BINS = "cu AS (SELECT list_distinct(list_transform(range(0, {k} + 1), lambda i: i)) AS i, quantile_cont(p, [{q}]) AS c FROM sc), bn AS (SELECT sc.*, greatest(len(list_filter(list_distinct(c), lambda v: v < p)) - 1, 0) AS bin FROM sc, cu)"


def _bins(k: int) -> str:
    return SQL_BINS.format(k=k, q=", ".join(str(i / k) for i in range(k + 1)))


@query("quantile_bins", f"WITH {SQL_SCORES}, {_bins(4)} SELECT bin, count(*) AS n, min(p) AS low, max(p) AS high FROM bn GROUP BY 1")
def _(s, d):
    return X.quantile_bin(V.scores(s, d), "p", 4).groupBy("bin").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


@query("calibration_table", f"WITH {SQL_SCORES}, {_bins(10)} SELECT bin, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed_rate, count(*) AS n FROM bn GROUP BY 1")
def _(s, d):
    return r6(S.calibration_table(V.scores(s, d), "p", "y"), "mean_score", "observed_rate")


@query("domain_overlap", f"""WITH {SQL_SCORES}, r AS (SELECT min(p) AS a, max(p) AS b, min(n_chars) AS c, max(n_chars) AS e FROM sc WHERE lang = 'en')
SELECT 'p' AS metric, a AS low, b AS high, count(*) FILTER (p BETWEEN a AND b) AS inside, count(*) AS n FROM sc, r WHERE lang != 'en' GROUP BY 2, 3 UNION ALL SELECT 'n_chars', c, e, count(*) FILTER (n_chars BETWEEN c AND e), count(*) FROM sc, r WHERE lang != 'en' GROUP BY 2, 3""")
def _(s, d):
    x = V.scores(s, d)
    return S.domain_overlap(x.filter("lang = 'en'"), x.filter("lang != 'en'"), ["p", "n_chars"])


@query("design_grid", """SELECT DISTINCT p_brand, p_size, width, ratio FROM part, (VALUES (8), (16), (32)) x(width), (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.4)) y(ratio) WHERE CASE WHEN ratio = 0 THEN width = 8 ELSE width * ratio < p_size END""")
def _(s, d):
    base = V.read(s, d, "part").select("p_brand", "p_size")
    branch = F.when(F.col("ratio") == 0, F.col("width") == 8).otherwise(F.col("width") * F.col("ratio") < F.col("p_size"))
    return S.design_grid(base, {"width": [8, 16, 32], "ratio": [0.0, 0.1, 0.25, 0.4]}, branch).drop("parameters", "config_id")


@query("stable_seed", f"SELECT o_orderkey AS id, {sql_seed('42', 'o_orderkey', 'o_orderstatus')} AS seed FROM orders")
def _(s, d):
    return V.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), X.stable_seed(F.lit("42"), "o_orderkey", "o_orderstatus").alias("seed"))


@query("minmax_scale", "SELECT o_orderkey AS id, round(coalesce((o_totalprice - min(o_totalprice) OVER w) / nullif(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 0), 0)::DOUBLE, 6) AS x FROM orders WINDOW w AS (PARTITION BY o_orderstatus)")
def _(s, d):
    o = V.read(s, d, "orders").withColumn("p", F.col("o_totalprice").cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), F.round(X.minmax_scale("p", ["o_orderstatus"]), 6).alias("x"))


@query("recommend_rule", f"""WITH {SQL_SCORES} SELECT id, CASE WHEN p >= 0.88 THEN 'saturated_baseline' WHEN p / 100 < 0.001 THEN 'bottleneck' WHEN n_chars / 100.0 > 50 OR n_chars / 300.0 > 20 THEN 'long_range' WHEN p / 10 >= 0.03 AND n_chars / 300.0 <= 4 AND p / 100 >= 0.03 THEN 'well_connected'
WHEN p / 100 >= 0.01 THEN 'moderate' ELSE 'undetermined' END AS rule FROM sc""")
def _(s, d):
    return V.scores(s, d).select("id", X.recommend_rule("p", F.col("p") / 100, F.col("n_chars") / 100.0, F.col("n_chars") / 300.0).alias("rule"))


@query("upsert_by_key", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS version FROM orders")
def _(s, d):
    from topoeval.sources.tables import upsert_by_key

    o = V.read(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return upsert_by_key(o.withColumn("version", F.lit(0)), o.filter("o_orderstatus = 'F'").withColumn("version", F.lit(1)), ["o_orderkey"])


@query("table_checks", """SELECT 'orders: rows' AS "check", 100::DOUBLE AS expected, count(*)::DOUBLE AS actual, count(*) = 100 AS passed FROM orders UNION ALL SELECT 'orders: distinct o_orderstatus', 3, count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) = 3 FROM orders
UNION ALL SELECT 'unique o_orderkey', 0, count(*), count(*) = 0 FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'nulls o_custkey', 0, count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_custkey IS NULL) = 0 FROM orders""")
def _(s, d):
    o = V.read(s, d, "orders")
    return checks.expect_table(o, "orders", 100, {"o_orderstatus": 3}).union(checks.expect_unique(o, ["o_orderkey"])).union(checks.expect_not_null(o, ["o_custkey"]))


@query("remaining_work", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    done = V.read(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.remaining_work(V.read(s, d, "customer").select("c_custkey"), done, ["c_custkey"])


# --- statistics ---------------------------------------------------------------------------


@query("paired_tests", f"""WITH {SQL_SEL} SELECT dataset, backbone, count(*) AS n, round(avg(baseline), 9) AS mean_a, round(avg(test), 9) AS mean_b, round(avg(test - baseline), 9) AS mean_diff, round(stddev_samp(test - baseline), 9) AS std_diff,
round(avg(test - baseline) - 1.96 * stddev_samp(test - baseline) / sqrt(count(*)), 9) AS ci_low, round(avg(test - baseline) + 1.96 * stddev_samp(test - baseline) / sqrt(count(*)), 9) AS ci_high,
round(avg(test - baseline) / (stddev_samp(test - baseline) / sqrt(count(*))), 7) AS t, round(avg(test - baseline) / stddev_samp(test - baseline), 9) AS dz FROM sel GROUP BY 1, 2""")
def _(s, d):
    m = stats.paired_moments(_selected(s, d), ["dataset", "backbone"], "baseline", "test")
    digits = dict.fromkeys(("mean_a", "mean_b", "mean_diff", "std_diff", "ci_low", "ci_high", "dz"), 9) | {"t": 7}
    return m.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("paired_tests_p")
def _(s, d):
    return r6(stats.paired_tests(_selected(s, d), ["dataset", "backbone"], "baseline", "test"), "p_t", "p_w").select("dataset", "backbone", "n", "w", "p_t", "p_w")


@query("wilcoxon_stat", f"""WITH {SQL_SEL}, z AS (SELECT dataset, backbone, gain AS d, abs(gain) AS a FROM sel WHERE gain != 0), r AS (SELECT *, rank() OVER (PARTITION BY dataset, backbone ORDER BY a) + (count(*) OVER (PARTITION BY dataset, backbone, a) - 1) / 2.0 AS rk FROM z)
SELECT dataset, backbone, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY 1, 2""")
def _(s, d):
    return stats.wilcoxon_stat(_selected(s, d), ["dataset", "backbone"], "gain").select("dataset", "backbone", "n", "w_plus", "w_minus")


SQL_LONG = "lo AS (SELECT lang, metric, v, y, p FROM (SELECT lang, y, p, unnest([{'m': 'n_chars', 'v': n_chars::DOUBLE}, {'m': 'toxic', 'v': toxic::DOUBLE}, {'m': 'id', 'v': id::DOUBLE}]) AS s FROM sc), LATERAL (SELECT s.m AS metric, s.v AS v))"
SQL_RANKS = "rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY {k} ORDER BY {t}) + (count(*) OVER (PARTITION BY {k}, {t}) - 1) / 2.0 AS rt FROM {f})"


@query("correlation_table", f"WITH {SQL_SCORES}, {SQL_LONG}, {SQL_RANKS.format(k='metric', t='p', f='lo')} SELECT metric, 'p' AS target, count(*) AS n, round(corr(v, p), 6) AS pearson, round(corr(rv, rt), 6) AS spearman FROM rk GROUP BY 1")
def _(s, d):
    c = stats.correlation_table(V.scores(s, d), ["n_chars", "toxic", "id"], ["p"])
    return r6(c, "pearson", "spearman").select("metric", "target", "n", "pearson", "spearman")


@query("loo_correlations", f"""WITH {SQL_SCORES}, {SQL_LONG}, ex AS (SELECT u AS excluded, lo.* FROM lo, (SELECT DISTINCT lang AS u FROM sc) WHERE lang != u), {SQL_RANKS.format(k='excluded, metric', t='p', f='ex')}
SELECT excluded, metric, count(*) AS n, round(corr(v, p), 6) AS pearson, round(corr(rv, rt), 6) AS spearman FROM rk GROUP BY 1, 2""")
def _(s, d):
    c = stats.loo_correlations(V.scores(s, d), "lang", ["n_chars", "toxic", "id"], "p")
    return r6(c, "pearson", "spearman").select("excluded", "metric", "n", "pearson", "spearman")


@query("partial_correlation", f"""WITH {SQL_SCORES}, lo AS (SELECT 'n_chars' AS metric, n_chars::DOUBLE AS v, y, id::DOUBLE AS c FROM sc UNION ALL SELECT 'toxic', toxic, y, id FROM sc),
f AS (SELECT metric, regr_slope(v, c) AS a, regr_intercept(v, c) AS b, regr_slope(y, c) AS g, regr_intercept(y, c) AS h FROM lo GROUP BY 1) SELECT metric, count(*) AS n, round(corr(v - a * c - b, y - g * c - h), 5) AS pearson FROM lo JOIN f USING (metric) GROUP BY 1""")
def _(s, d):
    c = stats.partial_correlation(V.scores(s, d), ["n_chars", "toxic"], "y", "id")
    return c.select("metric", "n", F.round("pearson", 5).alias("pearson"))


@query("leave_one_out_means", f"""WITH {SQL_SEL}, u AS (SELECT dataset, avg(gain) AS v FROM sel GROUP BY 1), x AS (SELECT dataset AS removed FROM u UNION ALL SELECT 'none')
SELECT removed, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(avg((v > 0)::INT), 6) AS positive FROM x, u WHERE dataset != removed GROUP BY 1""")
def _(s, d):
    return r6(stats.leave_one_out_means(_selected(s, d), "dataset", "gain"), "mean", "median", "positive")


@query("holm", f"""WITH {SQL_SEL}, t AS (SELECT dataset, backbone, round(abs(avg(gain)), 9) AS p FROM sel GROUP BY 1, 2), q AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, dataset, backbone) + 1) AS st FROM t)
SELECT dataset, backbone, p, round(least(max(st) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0), 9) AS p_holm FROM q""")
def _(s, d):
    t = _selected(s, d).groupBy("dataset", "backbone").agg(F.round(F.abs(F.avg("gain")), 9).alias("p"))
    return S.holm_adjust(t).withColumn("p_holm", F.round("p_holm", 9))


@query("metric_suitability")
def _(s, d):
    return r6(stats.metric_suitability(V.scores(s, d), ["n_chars", "toxic"], "p", "y"), "spearman", "p_spearman", "auc", "oriented_auc")


@query("recovery_comparisons")
def _(s, d):
    return r6(stats.recovery_comparisons(_selected(s, d), ["backbone"], "dataset", "gain", B), "mean", "median", "ci_low", "ci_high", "p", "p_holm", "positive")


# --- resampling ---------------------------------------------------------------------------

B = resample.REPLICATES
_REPS = f"(SELECT unnest(range(1, {B + 1})) AS rep)"
_CI = "round(avg(m), 6) AS boot_mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, count(*) AS replicates"


def _inner(seed: int, keys: str, rows: str, reps: str = _REPS) -> str:
    """dr: draws of row numbers i (from 0) of tables with n rows a key, of one chunk each."""
    rep = "rep" if reps == _REPS else "slot"
    return f"""dr AS (SELECT {keys}{rep}, {sql_mixed(str(seed + 1), rep, "0", "j")} % n AS i FROM (SELECT DISTINCT {keys}n FROM {rows}), {reps}, LATERAL (SELECT unnest(range(0, n)) AS j))"""


@query("bootstrap_mean", f"""WITH {SQL_SEL}, z AS (SELECT backbone, gain AS v, row_number() OVER (PARTITION BY backbone ORDER BY dataset || seed) - 1 AS i, count(*) OVER (PARTITION BY backbone) AS n FROM sel),
{_inner(11, "backbone, ", "z")},
m AS (SELECT backbone, rep, avg(v) AS m FROM dr JOIN z USING (backbone, i) GROUP BY 1, 2) SELECT backbone, {_CI} FROM m GROUP BY 1""")
def _(s, d):
    x = _selected(s, d).withColumn("k", F.concat("dataset", F.col("seed").cast("string")))
    return r6(resample.bootstrap_mean(x, ["backbone"], "k", "gain", B, 11), "boot_mean", "ci_low", "ci_high")


@query("hierarchical_bootstrap", f"""WITH {SQL_SEL}, z AS (SELECT dataset, gain AS v, row_number() OVER (PARTITION BY dataset ORDER BY backbone || seed) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM sel),
g AS (SELECT dataset, n, row_number() OVER (ORDER BY dataset) - 1 AS gi, count(*) OVER () AS gn FROM (SELECT DISTINCT dataset, n FROM z)),
o AS (SELECT gn, unnest(range(1, gn * {B} + 1)) AS slot FROM (SELECT DISTINCT gn FROM g)),
f AS (SELECT slot, (slot - 1) // gn + 1 AS rep, {sql_mixed("11", "(slot - 1) // gn + 1", "slot % gn")} % gn AS gi FROM o),
h AS (SELECT slot, rep, dataset, {sql_mixed("13", "slot", "0", "j")} % n AS i FROM f JOIN g USING (gi), LATERAL (SELECT unnest(range(0, n)) AS j)),
m AS (SELECT rep, avg(m) AS m FROM (SELECT rep, slot, avg(v) AS m FROM h JOIN z USING (dataset, i) GROUP BY 1, 2) GROUP BY 1) SELECT {_CI} FROM m""")
def _(s, d):
    x = _selected(s, d).withColumn("k", F.concat("backbone", F.col("seed").cast("string")))
    return r6(resample.hierarchical_bootstrap(x, "dataset", "k", "gain", B, 11), "boot_mean", "ci_low", "ci_high")


@query("cluster_bootstrap", f"""WITH {SQL_SEL}, z AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT dataset || backbone AS c, sum(gain) AS s, count(*) AS k FROM sel GROUP BY 1)),
{_inner(5, "", "z")},
m AS (SELECT rep, sum(s) / sum(k) AS m FROM dr JOIN z USING (i) GROUP BY 1) SELECT {_CI} FROM m""")
def _(s, d):
    x = _selected(s, d).withColumn("c", F.concat("dataset", "backbone"))
    return r6(resample.cluster_bootstrap(x, "c", "gain", B, 5), "boot_mean", "ci_low", "ci_high")


@query("bootstrap_auc", f"""WITH {SQL_SCORES}, z AS (SELECT y, p, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY y) AS n FROM sc),
dr AS (SELECT y, rep, {sql_mixed("2 + y", "rep", "j")} % n AS i FROM (SELECT DISTINCT y, n FROM z), {_REPS}, LATERAL (SELECT unnest(range(0, n)) AS j)),
ct AS (SELECT rep, p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM dr JOIN z USING (y, i) GROUP BY 1, 2),
u AS (SELECT rep, a, b, sum(b) OVER (PARTITION BY rep ORDER BY p) - b / 2.0 AS below FROM ct),
m AS (SELECT rep, sum(a * below) / (sum(a) * sum(b)) AS m FROM u GROUP BY 1) SELECT {_CI} FROM m""")
def _(s, d):
    return r6(resample.bootstrap_auc(V.scores(s, d), "y", "p", "id", B, 2), "boot_mean", "ci_low", "ci_high")


@query("binned_bootstrap", f"""WITH {SQL_SCORES}, {_bins(4)}, z AS (SELECT bin, toxic AS v, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY bin) AS n FROM bn),
{_inner(3, "bin, ", "z")},
m AS (SELECT bin, rep, avg(v) AS m FROM dr JOIN z USING (bin, i) GROUP BY 1, 2) SELECT bin, {_CI} FROM m GROUP BY 1""")
def _(s, d):
    return r6(resample.binned_bootstrap(V.scores(s, d), "p", "toxic", "id", 4, B, 3), "boot_mean", "ci_low", "ci_high")


@query("direction_stability", f"""WITH {SQL_SCORES}, lg AS (SELECT metric, source AS c, CASE metric WHEN 'p' THEN p ELSE n_chars::DOUBLE END AS x, toxic::DOUBLE AS y FROM sc, (VALUES ('p'), ('n_chars')) t(metric)),
z AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c FROM lg)),
dr AS (SELECT rep, {sql_mixed("4", "rep", "j")} % n AS i FROM (SELECT DISTINCT n FROM z), (SELECT unnest(range(1, 201)) AS rep), LATERAL (SELECT unnest(range(0, n)) AS j)),
al AS (SELECT metric, rep, x, y FROM dr JOIN z USING (i) JOIN lg USING (c) UNION ALL SELECT metric, 0, x, y FROM lg),
rk AS (SELECT metric, rep, rank() OVER (PARTITION BY metric, rep ORDER BY x) + (count(*) OVER (PARTITION BY metric, rep, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY metric, rep ORDER BY y) + (count(*) OVER (PARTITION BY metric, rep, y) - 1) / 2.0 AS ry FROM al),
rho AS (SELECT metric, rep, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2),
f AS (SELECT metric, rho AS spearman FROM rho WHERE rep = 0)
SELECT metric, round(spearman, 6) AS spearman, round(avg((sign(rho) = sign(spearman))::INT), 6) AS sign_stability, round(quantile_cont(rho, 0.025), 6) AS q025, round(quantile_cont(rho, 0.975), 6) AS q975
FROM rho JOIN f USING (metric) WHERE rep > 0 GROUP BY 1, 2""")
def _(s, d):
    x = V.scores(s, d).withColumn("target", F.col("toxic").cast("double"))
    return r6(resample.direction_stability(x, "source", ["p", "n_chars"], "target", 200, 4), "spearman", "sign_stability", "q025", "q975")


# --- models, blind evaluation, streaming --------------------------------------------------

_MANIFEST = {"features": ["p", "n_chars"], "medians": [0.5, 1000.0], "means": [0.6, 2000.0], "stds": [0.2, 1500.0], "coefficients": [1.5, -0.5], "intercept": 0.25}


@query("score_frozen", f"WITH {SQL_SCORES} SELECT id, round(1 / (1 + exp(-(0.25 + (p - 0.6) / 0.2 * 1.5 + (n_chars - 2000.0) / 1500.0 * -0.5))), 6) AS prob FROM sc")
def _(s, d):
    return V.scores(s, d).select("id", F.round(models.score_frozen(_MANIFEST), 6).alias("prob"))


@query("mine_rules")
def _(s, d):
    return r6(models.mine_rules(V.scores(s, d), "id", ["p", "n_chars"], "y"), "support", "balanced_accuracy")


@query("mine_rules_to_pairs", f"""WITH {SQL_SCORES}, lg AS (SELECT metric, id, y, CASE metric WHEN 'p' THEN p ELSE n_chars::DOUBLE END AS v FROM sc, (VALUES ('p'), ('n_chars')) t(metric)),
ct AS (SELECT DISTINCT metric, round(unnest(quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9])), 9) AS t FROM lg GROUP BY metric),
am AS (SELECT metric || ' ' || op || ' ' || t::VARCHAR AS rule, id, y FROM lg JOIN ct USING (metric), (VALUES ('>='), ('<')) o(op) WHERE CASE op WHEN '>=' THEN v >= t ELSE v < t END),
tot AS (SELECT count(*) AS n, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM sc),
c1 AS (SELECT rule, count(*) AS k, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y = 0) AS fp FROM am GROUP BY 1),
r1 AS (SELECT rule, 1 AS complexity, k / n AS support, tp, fp, (tp / greatest(n1, 1) + 1 - fp / greatest(n0, 1)) / 2 AS ba FROM c1, tot WHERE k / n BETWEEN 0.08 AND 0.8),
tp AS (SELECT rule FROM (SELECT rule, row_number() OVER (ORDER BY round(ba, 9) DESC, rule) AS r FROM r1) WHERE r <= 35),
ta AS (SELECT am.* FROM am JOIN tp USING (rule)),
pr AS (SELECT '(' || a.rule || ' AND ' || b.rule || ')' AS rule, a.id, a.y FROM ta a JOIN ta b ON a.id = b.id AND a.rule < b.rule
       UNION ALL SELECT DISTINCT '(' || x.rule || ' OR ' || z.rule || ')', h.id, h.y FROM tp x JOIN tp z ON x.rule < z.rule JOIN ta h ON h.rule IN (x.rule, z.rule)),
c2 AS (SELECT rule, count(*) AS k, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y = 0) AS fp FROM pr GROUP BY 1),
r2 AS (SELECT rule, 2 AS complexity, k / n AS support, tp, fp, (tp / greatest(n1, 1) + 1 - fp / greatest(n0, 1)) / 2 AS ba FROM c2, tot WHERE k / n BETWEEN 0.08 AND 0.8)
SELECT rule, complexity, round(support, 6) AS support, tp, fp, round(ba, 6) AS balanced_accuracy, round(ba - 0.01 * (complexity - 1), 9) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def _(s, d):
    return r6(models.mine_rules(V.scores(s, d), "id", ["p", "n_chars"], "y").filter("complexity <= 2"), "support", "balanced_accuracy")


def _descriptors(s, d) -> DataFrame:
    """A small metric table with a target: documents' figures by source and language."""
    x = V.scores(s, d)
    return x.withColumns({"log_chars": F.log1p("n_chars"), "root": F.sqrt("n_chars"), "graph_id": F.col("id")})


@query("fit_indicator")
def _(s, d):
    board, _, _ = models.fit_indicator(_descriptors(s, d), ["log_chars", "root"], "y", "source", ["id"], folds=2)
    return board


@query("permutation_importance")
def _(s, d):
    return models.permutation_importance(_descriptors(s, d), ["log_chars", "root"], "y", "id", 20)


@query("blind_waves")
def _(s, d):
    from topoeval.operators import blind

    truth = cut(blind.minimal_knowledge(_descriptors(s, d).withColumn("gain", (F.col("y") - 0.5) / 10), ["log_chars", "root"], "gain").withColumn("w", F.pmod(F.xxhash64("graph_id"), F.lit(3))))
    known, out = truth.filter("w = 0").drop("w"), None
    for k in (1, 2):
        now = truth.filter(F.col("w") == k).drop("w")
        p, _ = blind.blind_predict(known, now.drop("gain_pp", "success"), ["log_chars", "root"])
        revealed, known = blind.blind_reveal(p, now, known)
        one = revealed.withColumn("wave", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return blind.blind_summary(out)


@query("evaluate_topology")
def _(s, d):
    v = V.vectors(s, d).withColumn("features", F.col("embedding"))
    return r6(evaluate.evaluate_topology(similarity.knn_edges(similarity.knn(v, 5)), v, 64), "accuracy", "macro_f1")


@query("project_2d")
def _(s, d):
    return r6(linalg.project_2d(V.vectors(s, d)), "x", "y")


@query("lambda2")
def _(s, d):
    e, n = _en(s, d)
    return r6(linalg.lambda2(cut(e), n), "lambda2", "cheeger_low", "cheeger_high")


@query("sweep_conductance")
def _(s, d):
    e, n = _en(s, d)
    e = cut(e)
    return r6(linalg.sweep_conductance(e, n, linalg.fiedler_vector(e, n, 1e-4)), "conductance")


@query("spectral_partition")
def _(s, d):
    v = V.vectors(s, d)
    return linalg.spectral_partition(similarity.knn_edges(similarity.knn(v, 6)).select("graph_id", "src", "dst"), v)


@query("effective_resistance")
def _(s, d):
    v = V.vectors(s, d)
    ends = components.sampled_nodes(v, 6, 1).withColumn("k", F.row_number().over(_by_id()))
    pairs = ends.filter("k % 2 = 1").select("graph_id", ((F.col("k") + 1) / 2).cast("int").alias("j"), F.col("id").alias("u"))
    pairs = pairs.join(ends.filter("k % 2 = 0").select("graph_id", (F.col("k") / 2).cast("int").alias("j"), F.col("id").alias("v")), ["graph_id", "j"])
    e = similarity.knn_edges(similarity.knn(v, 6))
    return linalg.effective_resistance(e, v, pairs, 1e-4, 25).select("graph_id", "u", "v", F.round("resistance", 3).alias("resistance"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("graph_id").orderBy("id")


@query("curvature_rewire")
def _(s, d):
    v = V.vectors(s, d)
    shots = rewire.curvature_rewire(V.ring_edges(s, d), v, 0.05, remove_above=0.5)
    return shots.groupBy("graph_id", "round").agg(F.count("*").alias("n_edges"))


@query("stream_outcomes", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS gain_mean, round(avg((value > 50)::INT), 6) AS positive_fraction FROM events GROUP BY 1")
def _(s, d):
    from topoeval.streaming import ingest

    return _streamed(s, d, lambda parts: ingest.outcome_aggregates(parts.withColumn("g", F.col("value") - 50), ["event_type"], "g"), "complete").select(
        "event_type", "n", F.round(F.col("gain_mean") + 50, 6).alias("gain_mean"), F.round("positive_fraction", 6).alias("positive_fraction")
    )


def _streamed(s: SparkSession, d: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The last state of a streaming plan over the events table, drained into the shared folder."""
    import os
    import uuid

    from topoeval.streaming import ingest

    cut(s.range(1))  # makes sure that there is a checkpoint folder
    base = os.path.join(s.sparkContext.getCheckpointDir(), "streams", uuid.uuid4().hex)
    schema = V.read(s, d, "events").schema
    parts = s.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out")

    ingest.drained(lambda: plan(parts).writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    return s.read.parquet(f"{base}/out")


@query("complete_runs", "SELECT user_id, count(DISTINCT event_type) AS n_kinds, count(*) AS n_parts FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def _(s, d):
    from topoeval.streaming import ingest

    e = V.read(s, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]
    return ingest.complete_runs(e, "user_id", "event_type", kinds)


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    from topoeval.streaming import ingest

    e = V.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windowed_events(e, "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Query]:
    from topoeval.plans import more, rings  # noqa: F401  (register their own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
