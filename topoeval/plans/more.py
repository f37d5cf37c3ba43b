"""More registered queries: sources and sinks, filters, joins, aggregations, text and set functions, gates, checks.

Tables that a query writes first go to a folder of their own below the checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoeval.functions import scalars as X
from topoeval.functions.lineage import cut
from topoeval.operators import bundles, checks, components, evaluate, graph, linalg, models, perturb, proximity, rewire, select, similarity, splits, stats
from topoeval.operators import summaries as S
from topoeval.plans import fixtures as V
from topoeval.plans.catalogue import _SQL as SQL_OF
from topoeval.plans.catalogue import KEYS, SQL_KNN, SQL_PAIRS, SQL_SEL, _en, _selected, query, r6
from topoeval.plans.fixtures import SQL_EDGES, SQL_PLANE, SQL_RING, SQL_RUNS, SQL_SCORES, SQL_SIMS, sql_uniform
from topoeval.sources import tables


def _folder(s: SparkSession) -> str:
    cut(s.range(1))  # makes sure that there is a checkpoint folder
    return os.path.join(s.sparkContext.getCheckpointDir(), "query-tables", uuid.uuid4().hex)


# --- sources and sinks --------------------------------------------------------------------


def _edge_file(s, d) -> str:
    at = f"{_folder(s)}/edges.csv"
    rows = V.read(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").cast("int").alias("label"))
    rows.write.option("header", True).csv(at)
    return at


@query("read_edges", "SELECT 'g' AS graph_id, l_partkey AS src, l_suppkey AS dst FROM lineitem")
def _(s, d):
    return tables.read_edges(s, _edge_file(s, d))[0]


@query("read_edges_nodes", """WITH t AS (SELECT max(greatest(l_partkey, l_suppkey)) AS top FROM lineitem), l AS (SELECT l_partkey AS id, min(l_linenumber)::INT AS label FROM lineitem GROUP BY 1)
SELECT 'g' AS graph_id, i AS id, label FROM (SELECT unnest(range(0, top + 1)) AS i FROM t) LEFT JOIN l ON l.id = i""")
def _(s, d):
    return tables.read_edges(s, _edge_file(s, d))[1]


def _graph_files(s, d) -> tuple[str, str]:
    at = _folder(s)
    e, n = _en(s, d)
    tables.write_table(e, f"{at}/edges.parquet")
    tables.write_table(n.select("graph_id", "id", (F.col("id") % 7).cast("int").alias("label")), f"{at}/nodes.parquet", partition_by=["graph_id"])
    return f"{at}/edges.parquet", f"{at}/nodes.parquet"


@query("read_graph", f"WITH {SQL_EDGES} SELECT e.graph_id, src, dst, x.id % 7 = y.id % 7 AS same FROM e JOIN n x ON x.graph_id = e.graph_id AND x.id = src JOIN n y ON y.graph_id = e.graph_id AND y.id = dst")
def _(s, d):
    e, n = tables.read_graph(s, *reversed(_graph_files(s, d)))
    return graph.labelled_edges(e, n).select("graph_id", "src", "dst", (F.col("src_label") == F.col("dst_label")).alias("same"))


@query("load_graph", f"WITH {SQL_EDGES} SELECT graph_id, src, dst FROM b")
def _(s, d):
    e, n = _graph_files(s, d)
    return tables.load_graph(s, e, n)[0].select("graph_id", "src", "dst")


@query("normalize_graph", f"WITH {SQL_EDGES} SELECT graph_id, id, (id % 7)::INT AS label, degree::DOUBLE AS f0, (degree = 0)::INT::DOUBLE AS f2 FROM d")
def _(s, d):
    e, n = _en(s, d)
    out = graph.normalize_graph(e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))), n.select("graph_id", "id", (F.col("id") % 7).cast("int").alias("label")))[1]
    return out.select("graph_id", "id", "label", F.col("features")[0].alias("f0"), F.col("features")[2].alias("f2"))


@query("collect_tables", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def _(s, d):
    at, o = _folder(s), V.read(s, d, "orders")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(f"{at}/a/one")
    o.filter("o_orderstatus != 'F'").select("o_orderstatus", "o_orderkey").write.option("header", True).csv(f"{at}/a/two")
    o.filter("o_orderstatus = 'P'").select("o_orderstatus", "o_orderkey").write.option("header", True).csv(f"{at}/b")  # the same rows in other files count
    return tables.collect_tables(s, [at, f"{at}/a", f"{at}/b"], "part-*.csv").select("o_orderkey", "o_orderstatus")


@query("recover_key_from_sibling", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'one' END AS dataset FROM orders")
def _(s, d):
    o = V.read(s, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "one").otherwise(F.concat(F.lit("k"), F.col("o_orderkey") % 2))
    return tables.recover_key_from_sibling(o.select("o_orderkey", F.col("o_orderstatus").alias("folder")), o.select(F.col("o_orderstatus").alias("folder"), kind.alias("dataset"))).select("o_orderkey", "dataset")


@query("collect_parts", "SELECT user_id, event_type, CASE WHEN event_type != (SELECT min(event_type) FROM events) THEN value END AS value FROM events")
def _(s, d):
    at, e = _folder(s), V.read(s, d, "events").select("user_id", "event_type", "value")
    first = e.agg(F.min("event_type").alias("f"))
    e.join(F.broadcast(first), F.col("event_type") == F.col("f")).select("user_id", "event_type").write.parquet(f"{at}/first")
    e.join(F.broadcast(first), F.col("event_type") != F.col("f")).drop("f").write.parquet(f"{at}/rest")
    return tables.collect_parts(s, [f"{at}/rest", f"{at}/first", f"{at}/rest"])


@query("write_table", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def _(s, d):
    at, c = f"{_folder(s)}/t", V.read(s, d, "customer").select("c_custkey", "c_mktsegment")
    tables.write_table(c, at)
    tables.write_table(c.filter("c_custkey % 2 = 0"), at, partition_by=["c_mktsegment"])
    return s.read.parquet(at)


@query("cached_table", "SELECT c_custkey, c_mktsegment FROM customer")
def _(s, d):
    at, c = f"{_folder(s)}/t", V.read(s, d, "customer").select("c_custkey", "c_mktsegment")
    tables.cached_table(s, at, lambda: c)
    return tables.cached_table(s, at, lambda: c.limit(0))


@query("manifest", "SELECT count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments FROM customer")
def _(s, d):
    row = V.read(s, d, "customer").agg(F.count("*").alias("n_rows"), F.count_distinct("c_mktsegment").alias("n_segments")).first()
    at = f"{_folder(s)}/manifest"
    tables.write_manifest(s, row.asDict(), at)
    return s.read.schema("n_rows long, n_segments long").json(at)


@query("summary_row", f"WITH {SQL_RUNS} SELECT backbone, candidate, printf('%.2f    %.2f (CI95:   %.2f)', 100 * avg(test_f1), 100 * stddev_pop(test_f1), 196 * stddev_pop(test_f1) / sqrt(count(*))) AS cell FROM runs GROUP BY 1, 2")
def _(s, d):
    return tables.summary_row(S.metric_summary(V.runs(s, d), ["backbone", "candidate"], "test_f1"), ["backbone", "candidate"])


# --- rows and columns ---------------------------------------------------------------------


@query("finite_rows", f"WITH {SQL_SCORES} SELECT id, p FROM sc WHERE id % 5 != 0 AND id % 7 != 0 AND id % 11 != 0")
def _(s, d):
    bad = F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, float("-inf")).when(F.col("id") % 11 == 0, None).otherwise(F.col("p"))
    return S.finite_rows(V.scores(s, d).select("id", bad.alias("p")), ["p"])


@query("usable_features", f"WITH {SQL_SCORES}, c AS (SELECT count(*) AS n, count(*) FILTER (id % 3 = 0) AS a, count(*) FILTER (id % 3 != 0) AS b FROM sc) SELECT 'p' AS feature FROM c WHERE n >= greatest(4, n / 2) UNION ALL SELECT 'third' FROM c WHERE a >= greatest(4, n / 2) UNION ALL SELECT 'rest' FROM c WHERE b >= greatest(4, n / 2)")
def _(s, d):
    x = V.scores(s, d).select("p", F.when(F.col("id") % 3 == 0, 1).alias("third"), F.when(F.col("id") % 3 != 0, 1).alias("rest"))
    return s.createDataFrame([(c,) for c in S.usable_features(x, ["p", "third", "rest"])], "feature string")


@query("prefix_columns", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, candidate, val_f1 AS before_val_f1, test_f1 AS before_test_f1 FROM runs")
def _(s, d):
    return S.prefix_columns(V.runs(s, d), "before_", [*KEYS, "candidate"])


@query("original_rows", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, test_f1 FROM runs WHERE candidate = 1 AND dataset IN ('BUILDING', 'MACHINERY') AND backbone NOT IN ('P')")
def _(s, d):
    return V.runs(s, d).filter((F.col("candidate") == 1) & F.col("dataset").isin("BUILDING", "MACHINERY") & ~F.col("backbone").isin("P")).select(*KEYS, "test_f1")


@query("candidate_label", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, candidate, CASE WHEN candidate % 2 = 1 THEN 'knn' WHEN candidate > 2 THEN 'vgae' ELSE 'delaunay' END AS label FROM runs")
def _(s, d):
    name = F.when(F.col("candidate") % 2 == 1, "knn").otherwise("delaunay")
    return V.runs(s, d).select(*KEYS, "candidate", X.candidate_label(name, F.col("candidate") - 2).alias("label"))


@query("three_region", f"WITH {SQL_SCORES} SELECT id, CASE WHEN p >= 0.7 THEN 'Recommend' WHEN p <= 0.3 THEN 'Avoid' ELSE 'Uncertain' END AS region FROM sc")
def _(s, d):
    return V.scores(s, d).select("id", X.three_region("p", 0.7, 0.3).alias("region"))


@query("success_flags", f"WITH {SQL_SEL} SELECT dataset, backbone, seed, (round(100 * gain, 4) > 0)::INT AS success_0, (round(100 * gain, 4) > 0.5)::INT AS success_0_5, (round(100 * gain, 4) > 1.0)::INT AS success_1_0 FROM sel")
def _(s, d):
    return _selected(s, d).select(*KEYS, F.round(100 * F.col("gain"), 4).alias("g")).withColumns(X.success_flags("g", [0, 0.5, 1.0])).drop("g")


# --- joins --------------------------------------------------------------------------------

SQL_CORR = "SELECT lang, CASE WHEN stddev_pop(n_chars) * stddev_pop({y}) > 1e-150 THEN round(corr(n_chars, {y}), 6) END AS r, round(avg({y}), 6) AS p FROM sc {w} GROUP BY 1"


@query("compare_correlations", f"""WITH {SQL_SCORES}, a AS ({SQL_CORR.format(y='y', w="WHERE lang != 'de'")}), b AS ({SQL_CORR.format(y='toxic', w="WHERE lang != 'fr'")})
SELECT coalesce(a.lang, b.lang) AS lang, a.r AS r_old, a.p AS p_old, b.r AS r_new, b.p AS p_new, coalesce(sign(a.r) = sign(b.r), false) AS same_direction, coalesce(a.p < 0.05 AND b.p < 0.05, false) AS both_significant FROM a FULL JOIN b ON a.lang = b.lang""")
def _(s, d):
    x = V.scores(s, d)
    table = lambda df, y: df.groupBy("lang").agg(F.round(X.safe_corr("n_chars", y), 6).alias("r"), F.round(F.avg(y), 6).alias("p"))
    return S.compare_correlations(table(x.filter("lang != 'de'"), "y"), table(x.filter("lang != 'fr'"), "toxic"), ["lang"])


@query("checked_join", "SELECT o_custkey AS k, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    o = V.read(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return S.checked_join(o, V.read(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"], "inner", "many_to_one")


@query("disjoint_keys", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    o = V.read(s, d, "orders")
    return S.assert_disjoint_keys(o.filter("o_orderstatus = 'F'").select("o_orderkey"), o.filter("o_orderstatus != 'F'"), ["o_orderkey"])


@query("left_join_keys", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(s, d):
    c, o = V.read(s, d, "customer"), V.read(s, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("with_baseline_gain", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, runs.candidate, bt AS baseline, round(runs.test_f1 - bt, 6) AS gain FROM runs LEFT JOIN base USING (dataset, backbone, seed)")
def _(s, d):
    return r6(S.with_baseline_gain(V.runs(s, d), KEYS, F.col("candidate") == 1, "test_f1"), "gain").select(*KEYS, "candidate", "baseline", "gain")


@query("metric_deltas", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, runs.candidate, round(runs.val_f1 - bv, 6) AS delta_val_f1, round(runs.test_f1 - bt, 6) AS delta_test_f1 FROM runs JOIN base USING (dataset, backbone, seed) WHERE runs.candidate != 1")
def _(s, d):
    out = S.metric_deltas(V.runs(s, d), KEYS, F.col("candidate") == 1, ["val_f1", "test_f1"])
    return r6(out, "delta_val_f1", "delta_test_f1").select(*KEYS, "candidate", "delta_val_f1", "delta_test_f1")


# --- aggregations -------------------------------------------------------------------------


@query("multi_agg", f"WITH {SQL_RUNS} SELECT dataset, round(avg(val_f1), 6) AS val_f1_mean, round(stddev_samp(val_f1), 6) AS val_f1_std, count(val_f1) AS val_f1_count, round(avg(test_f1), 6) AS test_f1_mean, round(stddev_samp(test_f1), 6) AS test_f1_std, count(test_f1) AS test_f1_count FROM runs GROUP BY 1")
def _(s, d):
    return r6(S.multi_agg(V.runs(s, d), ["dataset"], ["val_f1", "test_f1"]), "val_f1_mean", "val_f1_std", "test_f1_mean", "test_f1_std")


@query("regime_outcomes", f"WITH {SQL_SEL} SELECT dataset, round(avg(gain), 6) AS gain_mean, round(stddev_samp(gain), 6) AS gain_std, count(*) AS n, round(avg((gain > 0)::INT), 6) AS positive_fraction FROM sel GROUP BY 1")
def _(s, d):
    return r6(S.regime_outcomes(_selected(s, d), "dataset"), "gain_mean", "gain_std", "positive_fraction")


@query("constructor_summary", f"""WITH {SQL_RUNS}, g AS (SELECT backbone AS constructor, nullif(runs.candidate, 1) AS ratio, round(runs.test_f1 - bt, 6) AS gain, runs.val_f1 FROM runs JOIN base USING (dataset, backbone, seed))
SELECT constructor, ratio, count(*) AS n, round(avg(gain), 6) AS gain_mean, round(quantile_cont(gain, 0.5), 6) AS gain_median, round(avg((gain > 0)::INT), 6) AS positive_fraction, round(avg(val_f1), 6) AS val_f1_mean FROM g GROUP BY 1, 2""")
def _(s, d):
    g = S.with_baseline_gain(V.runs(s, d), KEYS, F.col("candidate") == 1, "test_f1").filter("baseline is not null")
    g = g.select(F.col("backbone").alias("constructor"), F.nullif("candidate", F.lit(1)).alias("ratio"), F.round("gain", 6).alias("gain"), "val_f1")
    return r6(S.constructor_summary(g, timings=["val_f1"]), "gain_mean", "gain_median", "positive_fraction", "val_f1_mean")


@query("family_summary", f"WITH {SQL_SEL} SELECT dataset, count(DISTINCT backbone) AS n_units, count(*) AS n, round(avg(gain), 6) AS gain_mean, round(count(*) / (SELECT count(*) FROM sel), 6) AS share FROM sel GROUP BY 1")
def _(s, d):
    return r6(S.family_summary(_selected(s, d), "dataset", "backbone"), "gain_mean", "share")


@query("ratio_share", f"WITH {SQL_SEL} SELECT ratio, count(*) AS n, round(count(*) / (SELECT count(*) FROM sel), 6) AS share FROM sel GROUP BY 1")
def _(s, d):
    return r6(S.ratio_share(_selected(s, d)), "share")


@query("method_summary", f"WITH {SQL_RUNS} SELECT candidate, backbone, count(*) AS n, round(avg(val_f1), 6) AS val_f1_mean, round(stddev_samp(val_f1), 6) AS val_f1_std, round(avg(test_f1), 6) AS test_f1_mean, round(stddev_samp(test_f1), 6) AS test_f1_std FROM runs GROUP BY 1, 2")
def _(s, d):
    return r6(S.method_summary(V.runs(s, d), ["candidate", "backbone"], ["val_f1", "test_f1"]), "val_f1_mean", "val_f1_std", "test_f1_mean", "test_f1_std")


@query("factor_combinations", f"WITH {SQL_SEL} SELECT dataset, backbone, ratio, count(*) AS n, round(avg(gain), 12) AS mean, round(avg((gain > 0)::INT), 6) AS positive_fraction FROM sel GROUP BY 1, 2, 3")
def _(s, d):
    out = r6(S.factor_combinations(_selected(s, d), ["dataset", "backbone", "ratio"], "gain"), "positive_fraction")
    return out.withColumn("mean", F.round("mean", 12) + 0.0)


@query("binned_pivot", f"""WITH {SQL_SCORES}, c AS (SELECT quantile_cont(p, [0, 0.25, 0.5, 0.75, 1]) AS cp, quantile_cont(id, [0, 0.25, 0.5, 0.75, 1]) AS ci FROM sc),
q AS (SELECT y, greatest(len(list_filter(list_distinct(cp), lambda v: v < p)) - 1, 0) AS x_bin, greatest(len(list_filter(list_distinct(ci), lambda v: v < id)) - 1, 0) AS y_bin FROM sc, c)
SELECT x_bin, round(avg(y) FILTER (y_bin = 0), 6) AS b0, round(avg(y) FILTER (y_bin = 1), 6) AS b1, round(avg(y) FILTER (y_bin = 2), 6) AS b2, round(avg(y) FILTER (y_bin = 3), 6) AS b3 FROM q GROUP BY 1""")
def _(s, d):
    return r6(S.binned_pivot(V.scores(s, d), "p", "id", "y", 4), "b0", "b1", "b2", "b3")


@query("class_balance", f"WITH {SQL_SCORES} SELECT y, count(*) AS n FROM sc GROUP BY 1")
def _(s, d):
    return V.scores(s, d).groupBy("y").agg(F.count("*").alias("n"))


@query("integrity_report", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count(*) - count(DISTINCT o_custkey) AS n_repeated, count(*) FILTER (o_orderstatus IS NULL) AS o_orderstatus_nulls, count(*) FILTER (o_orderstatus = 'P') AS odd_nulls FROM orders")
def _(s, d):
    o = V.read(s, d, "orders").withColumn("odd", F.when(F.col("o_orderstatus") != "P", 1))
    return S.integrity_report(o, ["o_custkey"], ["o_orderstatus", "odd"])


@query("candidate_summary", f"WITH {SQL_RUNS} SELECT 'raw' AS condition, backbone, candidate, round(avg(test_f1), 6) AS mean, round(stddev_pop(test_f1), 6) AS std, round(1.96 * stddev_pop(test_f1) / sqrt(count(*)), 6) AS ci95, count(*) AS n FROM runs GROUP BY 2, 3")
def _(s, d):
    return r6(S.candidate_summary(V.runs(s, d), "test_f1", condition="raw"), "mean", "std", "ci95")


# --- order and windows --------------------------------------------------------------------


@query("best_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(s, d):
    return S.best_per_key(V.read(s, d, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey").select("o_custkey", "o_orderkey")


@query("group_total", f"WITH {SQL_SEL} SELECT dataset, backbone, seed, count(*) OVER (PARTITION BY dataset, backbone) AS total FROM sel")
def _(s, d):
    from pyspark.sql import Window

    return _selected(s, d).select(*KEYS, F.count("*").over(Window.partitionBy("dataset", "backbone")).alias("total"))


@query("prefix_sum", "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM orders")
def _(s, d):
    return S.prefix_sum(V.read(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select("o_orderkey", "prefix")


@query("fixed_bin", f"WITH {SQL_SCORES} SELECT id, CASE WHEN p > 0 AND p <= 0.25 THEN 0 WHEN p > 0.25 AND p <= 0.5 THEN 1 WHEN p > 0.5 AND p <= 0.9 THEN 2 END AS bin FROM sc")
def _(s, d):
    return S.ratio_bin(V.scores(s, d).select("id", "p"), "p", [0.0, 0.25, 0.5, 0.9]).drop("p")


@query("leaderboard", f"WITH {SQL_SEL} SELECT dataset, backbone, seed, abs(gain) AS size FROM sel ORDER BY abs(gain) DESC, dataset, backbone, seed LIMIT 25")
def _(s, d):
    size = F.abs("gain").alias("size")
    return S.leaderboard(_selected(s, d).select(*KEYS, size), F.col("size").desc(), *KEYS, limit=25)


@query("first_graphs", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 50")
def _(s, d):
    return V.read(s, d, "part").select("p_partkey").orderBy("p_partkey").limit(50)


@query("bottom_k_edges", f"WITH {SQL_SIMS}, {SQL_RING} SELECT 'all' AS graph_id, src, dst, round(sim, 6) AS sim FROM ring JOIN s USING (src, dst) ORDER BY s.sim, src, dst LIMIT 100")
def _(s, d):
    e = rewire.edge_similarity(V.ring_edges(s, d), V.vectors(s, d))
    return r6(similarity.bottom_k_edges(e, 100), "sim").drop("rank")


@query("top_candidate_pairs", f"WITH {SQL_SIMS} SELECT 'all' AS graph_id, src, dst, round(sim, 6) AS sim FROM s ORDER BY s.sim DESC, src, dst LIMIT 100")
def _(s, d):
    v = V.vectors(s, d)
    return r6(similarity.top_pairs(v, v.select("graph_id").distinct().withColumn("pool", F.lit(100))), "sim").drop("p")


# --- sets ---------------------------------------------------------------------------------


@query("union_all", "SELECT c_custkey AS k, c_mktsegment, NULL::VARCHAR AS o_orderstatus FROM customer UNION ALL SELECT o_custkey, NULL, o_orderstatus FROM orders")
def _(s, d):
    return S.union_all(V.read(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), V.read(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus"))


@query("append_knowledge", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'known' ELSE 'new' END AS origin FROM customer")
def _(s, d):
    c = V.read(s, d, "customer").select(F.col("c_custkey").alias("k"))
    return S.append_knowledge(c.filter("k % 3 = 0").withColumn("origin", F.lit("known")), c.withColumn("origin", F.lit("new")), ["k"])


@query("edge_union", f"WITH {SQL_EDGES} SELECT DISTINCT 'g' AS graph_id, src, dst FROM e WHERE graph_id IN ('A', 'R')")
def _(s, d):
    e = V.co_purchases(s, d)
    one = lambda f: e.filter(F.col("graph_id") == f).withColumn("graph_id", F.lit("g"))
    return graph.edge_union(one("A"), one("R"))


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(s, d):
    return V.read(s, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates(["o_custkey", "o_orderstatus"])


# --- scalar functions ---------------------------------------------------------------------


@query("config_id", "SELECT o_orderkey, o_orderstatus || '__' || substr(sha1('{\"k\":' || o_orderkey || '}'), 1, 10) AS config FROM orders")
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", X.config_id("o_orderstatus", F.to_json(F.struct(F.col("o_orderkey").alias("k")))).alias("config"))


@query("table_fingerprint", """WITH r AS (SELECT sha256(c_custkey || ',' || c_mktsegment) AS d FROM customer), p AS (SELECT substr(d, 1, 2) AS part, sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM r GROUP BY 1)
SELECT sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS fingerprint FROM p""")
def _(s, d):
    return X.table_fingerprint(V.read(s, d, "customer"), "c_custkey", "c_mktsegment")


@query("stable_seed32", "SELECT o_orderkey, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS seed FROM (SELECT o_orderkey, sha256('a::' || o_orderkey) AS h FROM orders)")
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", X.stable_seed32(F.lit("a"), "o_orderkey").alias("seed"))


@query("flatten_params", "SELECT o_orderkey, o_custkey::BIGINT AS param_c, o_totalprice::DOUBLE AS param_p, NULL::BIGINT AS param_none FROM orders")
def _(s, d):
    text = F.to_json(F.struct(F.col("o_custkey").alias("c"), F.col("o_totalprice").cast("double").alias("p")))
    return V.read(s, d, "orders").select("o_orderkey", text.alias("j")).withColumns(X.flatten_params("j", c="long", p="double", none="long")).drop("j")


@query("number", "SELECT c_custkey, try_cast(c_phone AS DOUBLE) AS phone, try_cast(c_custkey::VARCHAR AS DOUBLE) AS k FROM (SELECT c_custkey, c_mktsegment AS c_phone FROM customer)")
def _(s, d):
    return V.read(s, d, "customer").select("c_custkey", X.number("c_mktsegment").alias("phone"), X.number(F.col("c_custkey").cast("string")).alias("k"))


@query("slug", "SELECT o_orderkey, replace(replace(lower(o_orderpriority), '-', '_'), ' ', '_') AS slug FROM orders")
def _(s, d):
    return V.read(s, d, "orders").select("o_orderkey", X.slug("o_orderpriority").alias("slug"))


@query("labels_of_ratio", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, candidate, CASE WHEN candidate = 1 THEN 'original' ELSE printf('r%03d', 10 * candidate) END AS label, 'm' || candidate AS mode, candidate / 4 AS fraction FROM runs")
def _(s, d):
    c = F.col("candidate")
    mode, fraction = X.mode_fraction(F.concat(F.lit("m"), c, F.lit(":"), (c / 4).cast("string")))
    return V.runs(s, d).select(*KEYS, "candidate", X.ratio_label(F.when(c > 1, c / 10)).alias("label"), mode.alias("mode"), fraction.alias("fraction"))


@query("clip_ratio", f"WITH {SQL_SCORES} SELECT id, least(greatest(p, 0.2), 0.8) AS clipped, round(n_chars / greatest(toxic, 1), 6)::DOUBLE AS ratio FROM sc")
def _(s, d):
    return V.scores(s, d).select("id", X.clip("p", 0.2, 0.8).alias("clipped"), F.round(X.safe_ratio(F.col("n_chars").cast("double"), "toxic"), 6).alias("ratio"))


@query("softmax_weights", f"WITH {SQL_SCORES}, e AS (SELECT id, source, exp(5 * p - max(5 * p) OVER (PARTITION BY source)) AS e FROM sc) SELECT id, round(e / sum(e) OVER (PARTITION BY source), 6) AS weight FROM e")
def _(s, d):
    return V.scores(s, d).select("id", F.round(X.softmax_weights("p", ["source"], 5.0), 6).alias("weight"))


# --- graphs -------------------------------------------------------------------------------


@query("symmetrize", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT 'g' AS graph_id, src, dst FROM e UNION SELECT 'g', dst, src FROM e")
def _(s, d):
    return graph.symmetrize(V.read(s, d, "lineitem").select(F.lit("g").alias("graph_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("add_self_loops", f"WITH {SQL_EDGES} SELECT * FROM e UNION SELECT graph_id, id, id FROM n")
def _(s, d):
    return graph.add_self_loops(*_en(s, d))


@query("largest_component", f"""WITH RECURSIVE {SQL_EDGES}, r AS (SELECT graph_id, id, id AS m FROM n UNION SELECT r.graph_id, b.dst, r.m FROM r JOIN b ON b.graph_id = r.graph_id AND b.src = r.id),
c AS (SELECT graph_id, id, min(m) AS c FROM r GROUP BY 1, 2), z AS (SELECT graph_id, c, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, c) AS k FROM c GROUP BY 1, 2) SELECT c.graph_id, c.id FROM c JOIN z USING (graph_id, c) WHERE k = 1""")
def _(s, d):
    return components.largest_component(components.connected_components(*_en(s, d)))


@query("component_summary", f"""WITH RECURSIVE {SQL_EDGES}, r AS (SELECT graph_id, id, id AS m FROM n UNION SELECT r.graph_id, b.dst, r.m FROM r JOIN b ON b.graph_id = r.graph_id AND b.src = r.id),
c AS (SELECT graph_id, id, min(m) AS c FROM r GROUP BY 1, 2), z AS (SELECT graph_id, c, count(*) AS k FROM c GROUP BY 1, 2) SELECT graph_id, count(*) AS n_components, max(k) AS largest, round(max(k) / sum(k), 6) AS largest_ratio FROM z GROUP BY 1""")
def _(s, d):
    return r6(components.component_summary(components.connected_components(*_en(s, d))), "largest_ratio")


@query("graph_catalog", f"WITH {SQL_EDGES} SELECT graph_id, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, graph_id = 'R' AS returned FROM d GROUP BY 1")
def _(s, d):
    design = V.read(s, d, "lineitem").select(F.col("l_returnflag").alias("graph_id"), (F.col("l_returnflag") == "R").alias("returned")).distinct()
    return bundles.graph_catalog(graph.basic_metrics(*_en(s, d)), design).select("graph_id", "n_nodes", "n_edges", "returned")


@query("mechanism_rows", f"""WITH {SQL_EDGES}, k AS (SELECT graph_id AS c, src, dst FROM e WHERE graph_id IN ('A', 'R')), v AS (SELECT id, part FROM n WHERE graph_id = 'A')
SELECT c AS graph_id, (SELECT count(*) FROM v) AS n_nodes, count(*) AS n_edges, round(avg((x.part = y.part)::INT), 6) AS homophily FROM k JOIN v x ON x.id = src JOIN v y ON y.id = dst GROUP BY 1""")
def _(s, d):
    e, n = _en(s, d)
    nodes = n.filter("graph_id = 'A'").select("graph_id", "id", F.col("part").alias("label"))
    rows = bundles.mechanism_rows({f: e.filter(F.col("graph_id") == f) for f in "AR"}, nodes)
    return r6(rows, "homophily").select("graph_id", "n_nodes", "n_edges", "homophily")


@query("cheeger_bounds", f"WITH {SQL_SCORES} SELECT id, p, round(p / 2, 8) AS cheeger_low, round(sqrt(2 * p), 6) AS cheeger_high FROM sc")
def _(s, d):
    return r6(linalg.cheeger_bounds(V.scores(s, d).select("id", "p"), "p"), "cheeger_high").withColumn("cheeger_low", F.round("cheeger_low", 8))


SQL_RES = f"{SQL_SIMS}, {SQL_RING}, rr AS (SELECT src, dst, greatest(list_sum(list_transform(list_zip(x.a[1:3], y.a[1:3]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 1e-12) AS resistance FROM ring JOIN v x ON x.id = src JOIN v y ON y.id = dst)"


def _resistances(s, d) -> DataFrame:
    c = V.vectors(s, d).select("graph_id", "id", F.slice("embedding", 1, 3).alias("c"))
    return linalg.pair_resistance(c, V.ring_edges(s, d).toDF("graph_id", "u", "v")).select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst"), "resistance")


@query("pair_resistance", f"WITH {SQL_RES} SELECT 'all' AS graph_id, src, dst, round(resistance, 6) AS resistance FROM rr")
def _(s, d):
    return r6(_resistances(s, d), "resistance")


@query("resistance_edge_weights", f"WITH {SQL_RES} SELECT 'all' AS graph_id, src, dst, round(least(greatest(resistance / (SELECT quantile_cont(resistance, 0.5) FROM rr), 0.001), 100), 5) AS weight FROM rr")
def _(s, d):
    w = linalg.resistance_edge_weights(_resistances(s, d))
    return w.select("graph_id", "src", "dst", F.round("weight", 5).alias("weight"))


# --- similarity and rewiring --------------------------------------------------------------


@query("budgeted_knn", f"WITH {SQL_SIMS}, {SQL_KNN} SELECT 'all' AS graph_id, src, dst, round(distance, 6) AS distance FROM ke WHERE mutual ORDER BY ke.distance, src, dst LIMIT 300")
def _(s, d):
    return r6(similarity.budgeted_knn(V.vectors(s, d), 300), "distance").select("graph_id", "src", "dst", "distance")


@query("knn_of_projection", f"""WITH {SQL_SIMS}, dd AS (SELECT x.id AS id, y.id AS neighbor, round(list_distance(x.a[1:2], y.a[1:2]), 10) AS distance FROM v x JOIN v y ON x.id != y.id)
SELECT 'all' AS graph_id, id, neighbor, round(distance, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS r FROM dd) WHERE r <= 3""")
def _(s, d):
    return r6(similarity.knn_plane(V.plane(s, d).withColumn("graph_id", F.lit("all")), 3), "distance")


@query("blend_edges", f"""WITH {SQL_EDGES}, a AS (SELECT src, dst, 1.0 AS w FROM e WHERE graph_id = 'A'), r AS (SELECT src, dst, 0.5 AS w FROM e WHERE graph_id = 'R')
SELECT 'g' AS graph_id, coalesce(a.src, r.src) AS src, coalesce(a.dst, r.dst) AS dst, round(0.8 * coalesce(a.w, 0) + 0.2 * coalesce(r.w, 0), 6)::DOUBLE AS weight FROM a FULL JOIN r ON a.src = r.src AND a.dst = r.dst""")
def _(s, d):
    e = V.co_purchases(s, d)
    one = lambda f, w: e.filter(F.col("graph_id") == f).select(F.lit("g").alias("graph_id"), "src", "dst", F.lit(w).alias("weight"))
    return r6(similarity.blend_edges(one("A", 1.0), one("R", 0.5), 0.8), "weight")


@query("anchor_propagate", f"""WITH {SQL_SIMS}, an AS (SELECT id FROM v ORDER BY {sql_uniform('3', 'id')}, id LIMIT 16),
t AS (SELECT v.id, an.id AS anchor, greatest(round(list_dot_product(v.a, w.a) / (v.l * w.l), 10), 0) AS sim FROM v, an JOIN v w ON w.id = an.id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, anchor) AS r FROM t) WHERE r <= 4),
w AS (SELECT id, anchor, CASE WHEN sum(sim) OVER (PARTITION BY id) > 0 THEN sim / sum(sim) OVER (PARTITION BY id) ELSE 0 END AS weight FROM k),
u AS (SELECT anchor, sum(weight * (id % 5)) / greatest(sum(weight), 1e-12) AS mean FROM w GROUP BY 1) SELECT 'all' AS graph_id, id, round(sum(weight * mean), 6) AS value FROM w JOIN u USING (anchor) GROUP BY 2""")
def _(s, d):
    v = V.vectors(s, d)
    values = v.select("graph_id", "id", (F.col("id") % 5).cast("double").alias("value"))
    return r6(similarity.anchor_propagate(cut(similarity.anchor_similarity(v, 16, 4, seed=3)), values), "value")


SQL_MST = f"""WITH RECURSIVE {SQL_PLANE}, {SQL_PAIRS}, g AS (SELECT graph_id, src, dst, round(w, 12) AS w FROM pr WHERE NOT EXISTS (SELECT 1 FROM p t WHERE t.graph_id = pr.graph_id AND t.id NOT IN (src, dst)
AND greatest(sqrt((t.x - ax) ^ 2 + (t.y - ay) ^ 2), sqrt((t.x - bx) ^ 2 + (t.y - b_y) ^ 2)) < w - 1e-13)),
h AS (SELECT graph_id, src AS a, dst AS z, w, src, dst FROM g UNION ALL SELECT graph_id, dst, src, w, src, dst FROM g),
r AS (SELECT graph_id, src, dst, w, src AS at FROM g UNION SELECT r.graph_id, r.src, r.dst, r.w, h.z FROM r JOIN h ON h.graph_id = r.graph_id AND h.a = r.at AND (h.w, h.src, h.dst) < (r.w, r.src, r.dst))
SELECT graph_id, src, dst, round(w, 6) AS weight FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.graph_id = g.graph_id AND r.src = g.src AND r.dst = g.dst AND r.at = g.dst)"""


@query("mst_edges", SQL_MST)
def _(s, d):
    return r6(proximity.euclidean_mst(V.plane(s, d)), "weight")


@query("mst_weight", f"SELECT graph_id, count(*) AS n_edges, round(sum(weight), 6) AS weight FROM ({SQL_MST.replace('round(w, 6)', 'w')}) GROUP BY 1")
def _(s, d):
    return proximity.euclidean_mst(V.plane(s, d)).groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("weight"))


_CHAIN = " UNION ALL ".join(f"SELECT graph_id, '{name}' AS constructor, count(*) AS n_edges FROM ({sql}) GROUP BY 1" for name, sql in (("mst", SQL_MST), *((k, SQL_OF[k]) for k in ("rng", "gabriel", "delaunay"))))


@query("proximity_chain", f"""WITH c AS ({_CHAIN}), n AS (SELECT label AS graph_id, count(*) AS n_nodes FROM embeddings GROUP BY 1)
SELECT graph_id, constructor, n_edges, n_nodes, round(n_edges / greatest(n_nodes * (n_nodes - 1) / 2, 1), 6) AS density, constructor != 'delaunay' AS derived FROM c JOIN n USING (graph_id)""")
def _(s, d):
    p = V.plane(s, d)
    return r6(proximity.proximity_summary(proximity.proximity_graphs(p), p), "density")


SQL_HYBRID = f"""{SQL_SIMS}, {SQL_RING}, sz AS (SELECT floor(m * 0.25)::BIGINT AS k, floor(least(nn * nn, greatest(20 * floor(m * 0.25), 3 * m)) / 2) AS pool FROM (SELECT (SELECT count(*) FROM v) AS nn, (SELECT count(*) FROM ring) AS m)),
rs AS (SELECT s.src, s.dst, s.sim, list_sum(list_transform(list_zip(x.a[1:3], y.a[1:3]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS res FROM s JOIN v x ON x.id = src JOIN v y ON y.id = dst),
ed AS (SELECT src, dst, sim, res AS part FROM ring JOIN rs USING (src, dst)),
es AS (SELECT src, dst, round(0.7 * (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) + (1 - 0.7) * (part - min(part) OVER ()) / (max(part) OVER () - min(part) OVER ()), 10) AS sc FROM ed),
st AS (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY sc, src, dst) AS r FROM es), sz WHERE r > k),
po AS (SELECT src, dst, sim, CASE WHEN res > 0 THEN 1 / res ELSE 0 END AS part FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, src, dst) AS q FROM rs), sz WHERE q <= pool),
fr AS (SELECT * FROM po ANTI JOIN st USING (src, dst)),
fs AS (SELECT src, dst, round(0.7 * (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) + (1 - 0.7) * (part - min(part) OVER ()) / (max(part) OVER () - min(part) OVER ()), 10) AS sc FROM fr),
ad AS (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, src, dst) AS r FROM fs), sz WHERE r <= k)"""


@query("rewire_hybrid_r25", f"WITH {SQL_HYBRID} SELECT 'all' AS graph_id, src, dst, false AS added FROM st UNION ALL SELECT 'all', src, dst, true FROM ad")
def _(s, d):
    v = V.vectors(s, d)
    return rewire.rewire_hybrid(V.ring_edges(s, d), v, v.select("graph_id", "id", F.slice("embedding", 1, 3).alias("c")), 0.25)


@query("homophily_attack_counts", f"""WITH {SQL_EDGES}, m AS (SELECT graph_id, count(*) AS m, floor(count(*) * 0.01 + 0.5)::BIGINT AS ask FROM e GROUP BY 1), q AS (SELECT e.graph_id, count(*) AS same FROM e JOIN n x ON x.graph_id = e.graph_id AND x.id = src JOIN n y ON y.graph_id = e.graph_id AND y.id = dst WHERE x.part = y.part GROUP BY 1)
SELECT graph_id, m - least(ask, same) AS n_kept, least(ask, same) AS n_added, 0::BIGINT AS n_added_same, 0::BIGINT AS n_repeated FROM m JOIN q USING (graph_id)""")
def _(s, d):
    e, n = _en(s, d)
    nodes = n.select("graph_id", "id", F.col("part").alias("label"))
    out = perturb.homophily_attack(e, nodes, 0.01, 7)
    ends = graph.labelled_edges(out, nodes)
    return ends.groupBy("graph_id").agg(
        F.count_if(~F.col("added")).alias("n_kept"), F.count_if("added").alias("n_added"), F.count_if(F.col("added") & (F.col("src_label") == F.col("dst_label"))).alias("n_added_same"),
        (F.count("*") - F.count_distinct("src", "dst")).alias("n_repeated"),
    )


@query("swap_invariants", f"WITH {SQL_EDGES} SELECT graph_id, count(*) AS n_edges, count(*) AS n_distinct, true AS same_degrees, true AS enough FROM e GROUP BY 1")
def _(s, d):
    e, n = _en(s, d)
    e = cut(e)
    out = cut(perturb.degree_preserving_swap(e, 0.2, 3))
    size = out.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_distinct"))
    same = graph.same_degree_sequence(e, out, n).withColumnRenamed("same", "same_degrees")
    diff = graph.edge_set_diff(e, out).select("graph_id", (F.col("n_clean") - F.col("n_both") >= F.round(0.2 * F.col("n_clean"))).alias("enough"))
    return size.join(same, "graph_id").join(diff, "graph_id")


@query("random_rewire_counts", f"WITH {SQL_EDGES}, m AS (SELECT graph_id, count(*) AS m, floor(count(*) * 0.1 + 0.5)::BIGINT AS k FROM e GROUP BY 1) SELECT graph_id, m AS n_clean, m AS n_observed, m - k AS n_both FROM m")
def _(s, d):
    e, n = _en(s, d)
    e = cut(e)
    out = perturb.perturb(e, n.select("graph_id", "id", F.col("part").alias("label")), "random", 0.1, 5)
    return graph.edge_set_diff(e, out).select("graph_id", "n_clean", "n_observed", "n_both")


@query("random_edges", "SELECT label AS graph_id, 60::BIGINT AS n_edges, 60::BIGINT AS n_distinct, 0::BIGINT AS n_strange FROM embeddings GROUP BY 1")
def _(s, d):
    v = V.vectors_by_label(s, d)
    e = cut(perturb.random_edges(v, 60, 4))
    known = v.select("graph_id", "id")
    odd = e.join(known.toDF("graph_id", "src").withColumn("a", F.lit(1)), ["graph_id", "src"], "left").join(known.toDF("graph_id", "dst").withColumn("b", F.lit(1)), ["graph_id", "dst"], "left")
    return odd.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.count_distinct("src", "dst").alias("n_distinct"), F.count_if(F.isnull("a") | F.isnull("b") | (F.col("src") >= F.col("dst"))).alias("n_strange"))


# --- evaluation and selection -------------------------------------------------------------


@query("regression_metrics", f"""WITH {SQL_SCORES}, q AS (SELECT lang, ln(1 + n_chars) AS y, 10 * p AS pred FROM sc), a AS (SELECT lang, avg(y) AS m FROM q GROUP BY 1),
k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY lang ORDER BY pred) + (count(*) OVER (PARTITION BY lang, pred) - 1) / 2.0 AS rp FROM q)
SELECT lang, round(avg(abs(y - pred)), 5) AS mae, round(sqrt(avg((y - pred) ^ 2)), 5) AS rmse, round(1 - sum((y - pred) ^ 2) / sum((y - m) ^ 2), 4) AS r2, count(*) AS n, round(corr(ry, rp), 5) AS spearman FROM k JOIN a USING (lang) GROUP BY 1""")
def _(s, d):
    x = V.scores(s, d).select("lang", F.log1p("n_chars").alias("y"), (10 * F.col("p")).alias("pred"))
    m = evaluate.regression_metrics(x, keys=["lang"])
    return m.withColumns({c: F.round(c, k) for c, k in (("mae", 5), ("rmse", 5), ("r2", 4), ("spearman", 5))})


@query("validation_select_by_method", f"""WITH {SQL_RUNS}, m AS (SELECT *, candidate % 2 AS method FROM runs WHERE candidate != 1), q AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed, method ORDER BY val_f1 DESC, candidate) AS r FROM m)
SELECT dataset, backbone, seed, method, candidate, val_f1 AS val, test_f1 AS test FROM q WHERE r = 1""")
def _(s, d):
    runs = V.runs(s, d).withColumn("method", F.col("candidate") % 2)
    return select.validation_select(runs, [*KEYS, "method"]).select(*KEYS, "method", "candidate", "val", "test")


@query("two_stage_gate", f"""WITH {SQL_RUNS}, m AS (SELECT *, candidate % 2 AS method FROM runs WHERE candidate != 1), q AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed, method ORDER BY val_f1 DESC, candidate) AS r FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed ORDER BY val_f1 DESC, method, candidate) AS z FROM q WHERE r = 1), g AS (SELECT base.*, w.candidate AS c, coalesce(round(100 * (w.val_f1 - bv), 6) >= 2, false) AS adopted FROM base LEFT JOIN (FROM w WHERE z = 1) w USING (dataset, backbone, seed)),
f AS (SELECT *, CASE WHEN adopted THEN c ELSE 1 END AS candidate FROM g) SELECT dataset, backbone, seed, candidate, adopted, round(100 * (test_f1 - bt), 6) AS gain_pp FROM f JOIN runs USING (dataset, backbone, seed, candidate)""")
def _(s, d):
    runs = V.runs(s, d).withColumn("method", F.col("candidate") % 2)
    return r6(select.two_stage_gate(runs, KEYS, "method", 2.0), "gain_pp").select(*KEYS, "candidate", "adopted", "gain_pp")


@query("gate_audit", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, runs.candidate, base.bt IS NOT NULL AS eligible, best.candidate IS NOT DISTINCT FROM runs.candidate AS chosen FROM runs LEFT JOIN base USING (dataset, backbone, seed) LEFT JOIN best USING (dataset, backbone, seed)")
def _(s, d):
    runs = V.runs(s, d)
    return select.gate_audit(runs, select.validation_select(runs)).select(*KEYS, "candidate", "eligible", "chosen")


@query("condition_vs_baseline", f"WITH {SQL_RUNS} SELECT dataset, backbone, seed, runs.candidate, round(runs.val_f1 - bv, 6) AS gain_val_f1, round(runs.test_f1 - bt, 6) AS gain_test_f1 FROM runs LEFT JOIN base USING (dataset, backbone, seed) WHERE runs.candidate = 3")
def _(s, d):
    runs = V.runs(s, d)
    out = select.condition_vs_baseline(runs.filter("candidate = 3"), runs.filter("candidate = 1"), KEYS, ["val_f1", "test_f1"])
    return r6(out, "gain_val_f1", "gain_test_f1").select(*KEYS, "candidate", "gain_val_f1", "gain_test_f1")


@query("nested_select", f"""WITH {SQL_RUNS}, t AS (SELECT *, round((val_f1 + 2 * test_f1) / 3, 6) AS top FROM runs), q AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed ORDER BY top DESC, candidate) AS r FROM t WHERE candidate != 1)
SELECT q.dataset, q.backbone, q.seed, q.candidate, round(q.val_f1 - o.val_f1, 6) AS gain_inner, round(q.top - o.top, 6) AS gain_topology, round(q.test_f1 - o.test_f1, 6) AS gain_test FROM q LEFT JOIN (FROM t WHERE candidate = 1) o ON o.dataset = q.dataset AND o.backbone = q.backbone AND o.seed = q.seed WHERE r = 1""")
def _(s, d):
    runs = V.runs(s, d).withColumns({"inner_val_f1": F.col("val_f1"), "topology_val_f1": F.round((F.col("val_f1") + 2 * F.col("test_f1")) / 3, 6)})
    out = select.nested_select(runs)
    return out.select(*KEYS, "candidate", *[(F.round(f"gain_{a}", 6) + 0.0).alias(f"gain_{b}") for a, b in (("inner_val_f1", "inner"), ("topology_val_f1", "topology"), ("test_f1", "test"))])


# --- statistics ---------------------------------------------------------------------------

SQL_RANK2 = "rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM ab)"


@query("baseline_saturation", f"WITH {SQL_SEL}, ab AS (SELECT baseline AS a, gain AS b FROM sel), {SQL_RANK2} SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM rk")
def _(s, d):
    return r6(stats.baseline_saturation(_selected(s, d), "baseline", "gain"), "pearson", "spearman").select("n", "pearson", "spearman")


@query("delta_correlations", f"WITH {SQL_RUNS}, ab AS (SELECT round(runs.val_f1 - bv, 6) AS a, runs.test_f1 AS b FROM runs JOIN base USING (dataset, backbone, seed) WHERE runs.candidate != 1), {SQL_RANK2} SELECT 'delta_val' AS metric, count(*) AS n, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman FROM rk")
def _(s, d):
    runs = V.runs(s, d).select(*KEYS, "candidate", F.round(F.col("val_f1") * 1e6).alias("val"), F.col("test_f1").alias("gain"))
    out = stats.delta_correlations(runs, KEYS, F.col("candidate") == 1, ["val"], "gain")
    return out.select("metric", "n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


@query("two_level_summary", f"""WITH {SQL_SEL}, r AS (SELECT 'execution' AS level, gain AS g FROM sel UNION ALL SELECT 'unit', avg(gain) FROM sel GROUP BY dataset)
SELECT level, count(*) AS n, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS std, round(quantile_cont(g, 0.5), 6) AS median, round(avg((g > 0)::INT), 6) AS positive FROM r GROUP BY 1""")
def _(s, d):
    return r6(stats.two_level_summary(_selected(s, d), "dataset", "gain"), "mean", "std", "median", "positive").drop("statistic", "p")


@query("confidence_intervals", f"""WITH {SQL_SEL} SELECT dataset, backbone, count(*) AS n, round(avg(test - baseline), 6) AS mean_diff, round(avg(test - baseline) - 1.96 * stddev_samp(test - baseline) / sqrt(count(*)), 6) AS ci_low,
round(avg(test - baseline) + 1.96 * stddev_samp(test - baseline) / sqrt(count(*)), 6) AS ci_high FROM sel GROUP BY 1, 2""")
def _(s, d):
    m = stats.paired_moments(_selected(s, d), ["dataset", "backbone"], "baseline", "test")
    return r6(stats.confidence_intervals(m, ["dataset", "backbone"]), "mean_diff", "ci_low", "ci_high")


@query("metric_suitability_auc", f"""WITH {SQL_SCORES}, lo AS (SELECT 'n_chars' AS metric, n_chars::DOUBLE AS v, y, p FROM sc UNION ALL SELECT 'toxic', toxic, y, p FROM sc),
k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY metric ORDER BY p) + (count(*) OVER (PARTITION BY metric, p) - 1) / 2.0 AS rp FROM lo),
a AS (SELECT metric, count(*) AS n, corr(rv, rp) AS rho, (sum(rv) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k GROUP BY 1)
SELECT metric, n, round(rho, 6) AS spearman, round(greatest(auc, 1 - auc), 6) AS oriented_auc, CASE WHEN auc >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM a""")
def _(s, d):
    m = stats.metric_suitability(V.scores(s, d), ["n_chars", "toxic"], "p", "y")
    return r6(m, "spearman", "oriented_auc").select("metric", "n", "spearman", "oriented_auc", "direction")


@query("logo_folds", f"WITH {SQL_SCORES} SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS fold FROM (SELECT DISTINCT source FROM sc)")
def _(s, d):
    return splits.logo_folds(V.scores(s, d), "source")


@query("combined_importance", f"WITH {SQL_SCORES}, t AS (SELECT source AS feature, avg(p) AS coefficient, avg(y) AS importance FROM sc GROUP BY 1) SELECT feature, round((coefficient / (SELECT sum(coefficient) FROM t) + importance / (SELECT sum(importance) FROM t)) / 2, 6) AS combined FROM t")
def _(s, d):
    t = V.scores(s, d).groupBy(F.col("source").alias("feature")).agg(F.avg("p").alias("coefficient"), F.avg("y").alias("importance"))
    return r6(models.combined_importance(t), "combined").select("feature", "combined")


# --- checks, design, streams --------------------------------------------------------------


@query("data_checks", """WITH c AS (SELECT count(*) AS c FROM customer), o AS (SELECT count(*) AS o FROM orders), b AS (SELECT count(*) FILTER (k != 3) AS b FROM (SELECT count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY o_orderpriority)),
e AS (SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 IS DISTINCT FROM o_custkey % 2) AS e FROM orders)
SELECT 'counts' AS "check", c::DOUBLE AS expected, o::DOUBLE AS actual, c = o AS passed FROM c, o UNION ALL SELECT 'close', c, o, abs(c - o) <= greatest(10, ceil(c * 0.001)) FROM c, o
UNION ALL SELECT 'o_orderstatus per o_orderpriority', 0, b, b = 0 FROM b UNION ALL SELECT 'equal', 0, e, e = 0 FROM e UNION ALL SELECT 'orders', 7, o, o = 7 FROM o""")
def _(s, d):
    c, o = V.read(s, d, "customer"), V.read(s, d, "orders")
    out = checks.expect_counts(o, c).union(checks.expect_close(c, o)).union(checks.expect_group_distinct(o, "o_orderpriority", "o_orderstatus", 3))
    out = out.union(checks.expect_equal_when(o, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2, F.col("o_custkey") % 2))
    return out.union(checks.expect_complete({"orders": o.withColumn("protocol", F.lit("p"))}, {"orders": 7}, "p"))


@query("design_summary", "SELECT n AS configurations, 4 * n AS graphs, 12 * n AS tasks, 60 * n AS runs, 360 * n AS fits FROM (SELECT count(DISTINCT p_brand || p_type) AS n FROM part)")
def _(s, d):
    grid = V.read(s, d, "part").select(F.concat("p_brand", "p_type").alias("config_id"))
    return S.design_summary(grid, 4, 3, 5, 6)


@query("ingest_run_parts", "SELECT user_id, event_type, value FROM events")
def _(s, d):
    from topoeval.streaming import ingest

    at, e = _folder(s), V.read(s, d, "events").select("user_id", "event_type", "value")
    e.filter("user_id % 2 = 0").write.parquet(f"{at}/in")
    go = lambda: ingest.drained(lambda: ingest.ingest_run_parts(ingest.read_parts(s, f"{at}/in", e.schema), f"{at}/out", f"{at}/state"))
    go()
    e.filter("user_id % 2 != 0").write.mode("append").parquet(f"{at}/in")
    go()  # a restart takes the new parts only
    return s.read.parquet(f"{at}/out")


@query("stream_complete_runs", "SELECT user_id, count(DISTINCT event_type) AS n_kinds, count(*) AS n_parts FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def _(s, d):
    from topoeval.plans.catalogue import _streamed
    from topoeval.streaming import ingest

    kinds = sorted(r[0] for r in V.read(s, d, "events").select("event_type").distinct().collect())  # a few event types
    return _streamed(s, d, lambda parts: ingest.complete_runs(parts, "user_id", "event_type", kinds), "complete")


@query("stream_windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    from topoeval.plans.catalogue import _streamed
    from topoeval.streaming import ingest

    plan = lambda parts: ingest.windowed_events(parts.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    out = _streamed(s, d, plan, "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
