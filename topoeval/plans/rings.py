"""Registered queries on graphs whose numbers are known in closed form: the suppliers of each nation in a ring by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.operators import bundles, linalg, models, stats
from topoeval.operators import summaries as S
from topoeval.plans import fixtures as V
from topoeval.plans.catalogue import _CI, B, SQL_SEL, _inner, _selected, query, r6
from topoeval.plans.fixtures import SQL_RING, SQL_RUNS, SQL_SCORES


def rings(s, d) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a ring for every nation with three suppliers or more; labels take turns."""
    by = Window.partitionBy("s_nationkey")
    n = V.read(s, d, "supplier").select(
        F.col("s_nationkey").cast("long").alias("graph_id"), F.col("s_suppkey").cast("long").alias("id"),
        F.lead("s_suppkey").over(by.orderBy("s_suppkey")).cast("long").alias("next"), F.min("s_suppkey").over(by).cast("long").alias("first"),
        (F.row_number().over(by.orderBy("s_suppkey")) % 2).alias("label"), F.count("*").over(by).alias("n"),
    ).filter("n >= 3")
    to = F.coalesce("next", "first")
    return cut(n.select("graph_id", F.least("id", to).alias("src"), F.greatest("id", to).alias("dst"))), cut(n.select("graph_id", "id", "label"))


SQL_RINGS = "r AS (SELECT s_nationkey::BIGINT AS graph_id, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 3)"
_SPECTRUM = "round(1 - cos(2 * pi() / n), 6) AS lambda2, round((1 - cos(2 * pi() / n)) / 2, 6) AS cheeger_low"


@query("ring_lambda2", f"WITH {SQL_RINGS} SELECT graph_id, {_SPECTRUM}, round(sqrt(2 - 2 * cos(2 * pi() / n)), 6) AS cheeger_high FROM r")
def _(s, d):
    return r6(linalg.lambda2(*rings(s, d)), "lambda2", "cheeger_low", "cheeger_high")


@query("algebraic_connectivity", f"WITH {SQL_RINGS} SELECT graph_id, round(2 - 2 * cos(2 * pi() / n), 6) AS algebraic_connectivity FROM r")
def _(s, d):
    return r6(linalg.algebraic_connectivity(*rings(s, d)), "algebraic_connectivity")


@query("ring_conductance", f"WITH {SQL_RINGS} SELECT graph_id, round(1.0 / (n // 2), 6) AS conductance FROM r")
def _(s, d):
    return r6(linalg.sweep_conductance(*rings(s, d)), "conductance")


@query("ring_resistance", f"WITH {SQL_RINGS} SELECT graph_id, round((n - 1) / n, 6) AS resistance_mean, round((n - 1) / n, 6) AS resistance_median, n AS converged FROM r")
def _(s, d):
    e, n = rings(s, d)
    pairs = e.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    return r6(linalg.resistance_summary(linalg.effective_resistance(e, n, pairs)), "resistance_mean", "resistance_median")


@query("resistance_weights_of_rings", f"WITH {SQL_RINGS} SELECT graph_id, n AS n_edges, 1.0::DOUBLE AS low, 1.0::DOUBLE AS high FROM r")
def _(s, d):
    e, n = rings(s, d)
    pairs = e.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    w = linalg.resistance_edge_weights(linalg.effective_resistance(e, n, pairs)).groupBy("graph_id")
    return r6(w.agg(F.count("*").alias("n_edges"), F.min("weight").alias("low"), F.max("weight").alias("high")), "low", "high")


_DESCRIPTOR = ["graph_id", "n_nodes", "n_edges", "density", "degree_avg", "n_components", "largest", "homophily", "lambda2", "cheeger_low", "mean_path", "approx_diameter"]
_SQL_DESCRIPTOR = f"""graph_id, n AS n_nodes, n AS n_edges, round(2.0 / (n - 1), 6) AS density, 2.0::DOUBLE AS degree_avg, 1::BIGINT AS n_components, n AS largest, round((n % 2) / n, 6) AS homophily,
{_SPECTRUM}, round((n * n // 4) / (n - 1), 6) AS mean_path, (n // 2)::INT AS approx_diameter"""


@query("structural_metrics", f"WITH {SQL_RINGS} SELECT {_SQL_DESCRIPTOR} FROM r")
def _(s, d):
    out = bundles.structural_metrics(*rings(s, d)).select(_DESCRIPTOR)
    return r6(out, "density", "homophily", "lambda2", "cheeger_low", "mean_path")


@query("prerewiring_metrics", f"WITH {SQL_RINGS} SELECT {_SQL_DESCRIPTOR}, (n = 3)::INT::DOUBLE AS transitivity, round(2 - 2 * cos(2 * pi() / n), 6) AS algebraic_connectivity, round(1.0 / (n // 2), 6) AS conductance FROM r")
def _(s, d):
    out = bundles.prerewiring_metrics(*rings(s, d)).select(*_DESCRIPTOR, "transitivity", "algebraic_connectivity", "conductance")
    return r6(out, "density", "homophily", "lambda2", "cheeger_low", "mean_path", "transitivity", "algebraic_connectivity", "conductance")


# --- bundles, guards and summaries --------------------------------------------------------


@query("constructor_controls", f"""WITH {SQL_RING} SELECT constructor, count(*) AS n_edges, count(*) AS n_distinct
FROM ring, (VALUES ('mutual_knn'), ('knn'), ('radius'), ('mst_knn'), ('random'), ('degree_preserving')) t(constructor) GROUP BY 1""")
def _(s, d):
    plane = V.plane(s, d).select("id", "x", "y")
    made = bundles.constructor_controls(cut(V.vectors(s, d).join(plane, "id")), cut(V.ring_edges(s, d)))
    return made.groupBy("constructor").agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_distinct"))


@query("gain_summary", f"""WITH {SQL_SEL}, u AS (SELECT backbone, dataset, avg(gain) AS v FROM sel GROUP BY 1, 2),
z AS (SELECT backbone, v, row_number() OVER (PARTITION BY backbone ORDER BY dataset) - 1 AS i, count(*) OVER (PARTITION BY backbone) AS n FROM u),
{_inner(0, "backbone, ", "z")},
m AS (SELECT backbone, rep, avg(v) AS m FROM dr JOIN z USING (backbone, i) GROUP BY 1, 2), ci AS (SELECT backbone, {_CI} FROM m GROUP BY 1)
SELECT backbone, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(avg((v > 0)::INT), 6) AS positive, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high
FROM u JOIN ci USING (backbone) GROUP BY 1""")
def _(s, d):
    out = stats.gain_summary(_selected(s, d), ["backbone"], "dataset", "gain", B)
    return r6(out.select("backbone", "n", "mean", "median", "std", "positive", "ci_low", "ci_high"), "mean", "median", "std", "positive", "ci_low", "ci_high")


@query("shard_filter", "SELECT o_orderkey AS id, 1::BIGINT AS n_shards FROM orders")
def _(s, d):
    o = V.read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    shards = [S.shard_filter(o, "id", 4, k) for k in range(4)]
    return S.union_all(*shards).groupBy("id").agg(F.count("*").alias("n_shards"))


@query("assert_no_leakage", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, candidate, val_f1 FROM runs")
def _(s, d):
    r = V.runs(s, d)
    features = [c for c in r.columns if c != "test_f1"]
    S.assert_no_leakage(features, ["test_f1", "gain"])
    return r.select(features)


@query("single_metric_indicators", f"""WITH {SQL_SCORES}, lg AS (SELECT metric, lang != 'en' AS train, y, CASE metric WHEN 'p' THEN p ELSE n_chars::DOUBLE END AS v FROM sc, (VALUES ('p'), ('n_chars')) t(metric)),
rk AS (SELECT metric, y, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM lg WHERE train),
au AS (SELECT metric, CASE WHEN (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) >= 0.5 THEN 1.0 ELSE -1.0 END AS sign FROM rk GROUP BY 1),
tu AS (SELECT metric, train, y, v * sign AS s, sign FROM lg JOIN au USING (metric)),
pt AS (SELECT metric, s AS threshold, sum(sum((y = 1)::INT)) OVER w / sum(sum((y = 1)::INT)) OVER (PARTITION BY metric) - sum(sum((y = 0)::INT)) OVER w / sum(sum((y = 0)::INT)) OVER (PARTITION BY metric) AS j
       FROM tu WHERE train GROUP BY metric, s WINDOW w AS (PARTITION BY metric ORDER BY s DESC)),
th AS (SELECT metric, max(threshold) AS threshold FROM (SELECT metric, threshold, round(j, 12) AS j, max(round(j, 12)) OVER (PARTITION BY metric) AS top FROM pt) WHERE j = top GROUP BY 1)
SELECT metric, any_value(sign)::DOUBLE AS sign, round(any_value(threshold), 6) AS threshold, round(avg(((s >= threshold) = (y = 1))::INT), 6) AS accuracy FROM tu JOIN th USING (metric) WHERE NOT train GROUP BY 1""")
def _(s, d):
    sc = V.scores(s, d)
    out = models.single_metric_indicators(sc.filter("lang != 'en'"), sc.filter("lang = 'en'"), ["p", "n_chars"], "y")
    return r6(out.select("metric", "sign", "threshold", "accuracy"), "threshold", "accuracy")
