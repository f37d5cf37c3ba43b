"""Views of the star-schema tables in the shapes of the operators, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought in one order with the same return flag: one graph per flag."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("graph_id"), "l_orderkey", "l_partkey").distinct()
    both = li.withColumnRenamed("l_partkey", "src").join(li.withColumnRenamed("l_partkey", "dst"), ["graph_id", "l_orderkey"])
    return both.filter("src < dst").select("graph_id", "src", "dst").distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in every graph: label (type) and part (brand)."""
    flags = F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("graph_id")
    return read(spark, sf_dir, "part").select(flags, F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_brand").alias("part"))


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part - supplier edges as weighted directed edges both ways."""
    e = read(spark, sf_dir, "lineitem").select(F.lit("ps").alias("graph_id"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()
    return e.union(e.select("graph_id", "dst", "src")).withColumn("weight", F.lit(1.0))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution rows: dataset, backbone, seed, candidate (1: baseline), val_f1, test_f1."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice").cast("double")
    other = (price * 7 + F.col("o_orderkey") * 13) % 500000
    keys = [
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderstatus").alias("backbone"), (F.col("o_custkey") % 30).cast("int").alias("seed"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("candidate"),
    ]
    return o.groupBy(*keys).agg(F.round(F.avg(price) / 500000, 6).alias("val_f1"), F.round(F.avg(other) / 500000, 6).alias("test_f1"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one graph's points."""
    return read(spark, sf_dir, "embeddings").select(F.lit("all").alias("graph_id"), F.col("vec_id").alias("id"), "embedding", "label")


def vectors_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), "embedding")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two coordinates of all embeddings, one set of points per label."""
    at = lambda k: F.element_at("embedding", k).cast("double")
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("graph_id"), F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"))


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph on the embeddings: each id with the next four."""
    e = read(spark, sf_dir, "embeddings").select(F.lit("all").alias("graph_id"), F.col("vec_id").alias("src"))
    n = e.groupBy().agg(F.max("src").alias("top"))
    out = e.crossJoin(F.broadcast(n)).select("graph_id", "src", F.explode(F.array(*[F.col("src") + k for k in (1, 2, 3, 4)])).alias("dst"), "top")
    return out.filter("dst <= top").select("graph_id", "src", "dst")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, y, p, source, lang."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    p = F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6)
    return read(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), p.alias("p"), "source", "lang", "n_chars", "toxic")


SQL_EDGES = """e AS (SELECT DISTINCT a.l_returnflag AS graph_id, a.l_partkey AS src, b.l_partkey AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_partkey < b.l_partkey),
n AS (SELECT graph_id, p_partkey AS id, p_type AS label, p_brand AS part FROM part, (VALUES ('A'), ('N'), ('R')) t(graph_id)),
b AS (SELECT graph_id, src, dst FROM e UNION ALL SELECT graph_id, dst, src FROM e),
d AS (SELECT n.graph_id, n.id, count(b.src) AS degree FROM n LEFT JOIN b ON b.graph_id = n.graph_id AND b.src = n.id GROUP BY 1, 2)"""
SQL_RUNS = """runs AS (SELECT c_mktsegment AS dataset, o_orderstatus AS backbone, (o_custkey % 30)::INT AS seed, substr(o_orderpriority, 1, 1)::INT AS candidate,
round(avg(o_totalprice::DOUBLE) / 500000, 6) AS val_f1, round(avg((o_totalprice::DOUBLE * 7 + o_orderkey * 13) % 500000) / 500000, 6) AS test_f1
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
base AS (SELECT dataset, backbone, seed, val_f1 AS bv, test_f1 AS bt FROM runs WHERE candidate = 1),
cand AS (SELECT *, row_number() OVER (PARTITION BY dataset, backbone, seed ORDER BY val_f1 DESC, candidate) AS r FROM runs WHERE candidate != 1),
best AS (SELECT * FROM cand WHERE r = 1)"""
SQL_PLANE = "p AS (SELECT label AS graph_id, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
SQL_SIMS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
s AS (SELECT x.id AS src, y.id AS dst, round(list_dot_product(x.a, y.a) / (x.l * y.l), 10) AS sim FROM v x JOIN v y ON x.id < y.id)"""
SQL_RING = "ring AS (SELECT v.vec_id AS src, v.vec_id + k AS dst FROM embeddings v, (VALUES (1), (2), (3), (4)) t(k) WHERE v.vec_id + k <= (SELECT max(vec_id) FROM embeddings))"
SQL_SCORES = """sc AS (SELECT doc_id AS id, quality AS y, toxic, round(n_chars / (n_chars + 1000.0), 6) AS p, source, lang, n_chars FROM labels JOIN documents USING (doc_id))"""


def sql_seed(*parts: str) -> str:
    """stable_seed in SQL: sixteen hex digits as a number modulo 2**31 - 1."""
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(sha256({text}), 1, 16))::UBIGINT % 2147483647)::BIGINT"


def sql_uniform(*parts: str) -> str:
    return f"({sql_seed(*parts)} / 2147483647.0::DOUBLE)"


def sql_mixed(*parts: str) -> str:
    """resample.mixed in SQL."""
    from topoeval.operators.resample import STEPS

    h = "7::BIGINT"
    for p in parts:
        h = f"xor({h}, ({p})::BIGINT)"
        for bits, factor, modulus in STEPS:
            h = f"(xor({h}, {bits}::BIGINT) * {factor} % {modulus})"
    return h
