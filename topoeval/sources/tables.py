"""Reading and writing graphs, run tables and manifests."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoeval.functions.scalars import format_metric

EDGE_CSV = T.StructType().add("source", "long").add("target", "long").add("label", "integer")
FORMATS = ("csv", "parquet", "json", "orc")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_edges(spark: SparkSession, path: str, graph_id: str = "g") -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a CSV edge list with header source,target[,label]; nodes are 0 ... max id, a node's label the least of its
    rows as a source. Missing columns are an error.
    """
    head = spark.read.option("header", True).csv(path)
    if missing := {"source", "target"} - set(head.columns):
        raise ValueError(f"the edge list lacks {sorted(missing)}")
    schema = T.StructType([f for c in head.columns for f in [EDGE_CSV[c] if c in EDGE_CSV.names else T.StructField(c, T.StringType())]])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    edges = rows.select(F.lit(graph_id).alias("graph_id"), F.col("source").alias("src"), F.col("target").alias("dst"))
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    nodes = spark.range(0 if top is None else top + 1).select(F.lit(graph_id).alias("graph_id"), "id")
    if "label" in head.columns:
        names = rows.groupBy(F.col("source").alias("id")).agg(F.min("label").alias("label"))
        nodes = nodes.join(names, "id", "left").select("graph_id", "id", "label")
    return edges, nodes


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """edges(graph_id, src, dst) and nodes(graph_id, id, ...) from a pair of tables."""
    edges, nodes = spark.read.format(fmt).load(edges_path), spark.read.format(fmt).load(nodes_path)
    if missing := ({"graph_id", "src", "dst"} - set(edges.columns)) | ({"graph_id", "id"} - set(nodes.columns)):
        raise ValueError(f"the graph lacks {sorted(missing)}")
    return edges, nodes


def load_graph(spark: SparkSession, path: str, nodes_path: str | None = None, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A graph by format (the suffix if none is given): an edge list in CSV, or a pair of tables. Normalised."""
    from topoeval.operators.graph import both_ways, canonical_edges, normalize_graph

    fmt = fmt or path.rstrip("/").rpartition(".")[2]
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    edges, nodes = read_edges(spark, path) if nodes_path is None else read_graph(spark, nodes_path, path, fmt)
    return normalize_graph(edges, nodes) if "label" in nodes.columns else (both_ways(canonical_edges(edges, nodes)), nodes)


def collect_tables(spark: SparkSession, roots: Sequence[str], filename: str) -> DataFrame:
    """All rows of all CSV files of that name below the roots, with file and folder. A file is read once, also where roots
    overlap; unreadable files are skipped; columns are matched by name, and what a file lacks is NULL. All columns are text.
    """
    lines = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", filename).option("ignoreCorruptFiles", True)
    heads, out = lines, None
    kept: dict[str, list[str]] = {}
    seen: set[str] = set()
    for root in dict.fromkeys(roots):
        if not _exists(spark, root):
            continue
        # one row for each file: its first line
        first = heads.load(root).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_block_start"))
        first = first.filter("at = 0").groupBy("file").agg(F.first("value").alias("head"))
        for r in first.collect():
            if r["file"] not in seen:
                seen.add(r["file"])
                kept.setdefault(r["head"], []).append(r["file"])
    for head in sorted(kept):
        # files of one header are read together; the schema comes from them alone
        one = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).csv(sorted(kept[head]))
        one = one.withColumn("file", F.col("_metadata.file_path"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(filename)
    return out.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))


def recover_key_from_sibling(rows: DataFrame, sibling: DataFrame, key: str = "dataset", folder: str = "folder") -> DataFrame:
    """Fill a missing key from the sibling table of the same folder where that has exactly one value."""
    one = sibling.groupBy(folder).agg(F.count_distinct(key).alias("n"), F.min(key).alias("__k")).filter("n = 1").drop("n")
    base = rows if key in rows.columns else rows.withColumn(key, F.lit(None).cast(sibling.schema[key].dataType))
    return base.join(one, folder, "left").withColumn(key, F.coalesce(key, "__k")).drop("__k")


def collect_parts(spark: SparkSession, globs: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Part files of several globs as one table; columns that a part lacks are NULL."""
    out = None
    for g in sorted(set(globs)):
        one = spark.read.format(fmt).options(header=True, mergeSchema=True).load(g)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace a table; readers see the old or the new one by Spark's commit protocol."""
    df.write.mode("overwrite").format(fmt).partitionBy(*partition_by).save(path)


def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in new, and new."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def cached_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at path, computed and written first if it is not there."""
    if overwrite or not _exists(spark, path):
        write_table(make(), path)
    return spark.read.parquet(path)


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """One row of JSON."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def summary_row(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and cell: mean, deviation and interval of a metric_summary in percent."""
    return summary.select(*keys, format_metric("mean", "std", "ci95").alias("cell"))
