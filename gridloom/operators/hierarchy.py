"""Hierarchies of groups and arrays: one row per node, and what is asked of it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import V2_ARRAY_KEY, V2_GROUP_KEY, V3_KEY
from gridloom.plans.meta import ArrayMeta, GroupMeta

#: Keys of nodes' documents.
DOCUMENTS = "(^|/)(zarr\\.json|\\.zarray|\\.zgroup)$"
NODES = "path string, parent string, name string, node_type string, depth int, meta string"


def nodes_of(blobs: DataFrame) -> DataFrame:
    """Nodes (path, parent, name, node_type, depth, meta) of metadata documents (key, value). Version 3 goes before version 2."""
    name = F.element_at(F.split("key", "/"), -1)
    docs = blobs.select("key", "value").where(name.isin(V3_KEY, V2_ARRAY_KEY, V2_GROUP_KEY))
    path = F.concat(F.lit("/"), F.regexp_replace("key", "/?[^/]*$", ""))
    meta = F.col("value").cast("string")
    kind = F.when(name == V2_ARRAY_KEY, "array").when(name == V2_GROUP_KEY, "group").otherwise(F.get_json_object(meta, "$.node_type"))
    rows = docs.select(path.alias("path"), kind.alias("node_type"), meta.alias("meta"), (name != V3_KEY).cast("int").alias("old"))
    best = rows.groupBy("path").agg(F.min(F.struct("old", "node_type", "meta")).alias("b")).select("path", "b.node_type", "b.meta")
    return with_places(best)


def with_places(rows: DataFrame) -> DataFrame:
    """Adds parent, name and depth to path, node_type, meta."""
    root = F.col("path") == "/"
    return rows.select(
        "path",
        F.when(~root, F.when(F.size(F.split("path", "/")) == 2, "/").otherwise(F.regexp_replace("path", "/[^/]*$", ""))).alias("parent"),
        F.when(root, "").otherwise(F.element_at(F.split("path", "/"), -1)).alias("name"),
        "node_type",
        F.when(root, 0).otherwise(F.size(F.split("path", "/")) - 1).alias("depth"),
        "meta",
    )


def nodes_from(spark: SparkSession, metas: dict[str, ArrayMeta | GroupMeta]) -> DataFrame:
    rows = [(p, "array" if isinstance(m, ArrayMeta) else "group", json.dumps(m.to_json())) for p, m in metas.items()]
    return with_places(spark.createDataFrame(rows, "path string, node_type string, meta string"))


def consolidated_nodes(spark: SparkSession, root: GroupMeta, path: str = "/") -> DataFrame:
    """Nodes of a group's consolidated metadata, without listing the store."""
    below = "" if path == "/" else path
    rows = [(path, "group", json.dumps(root.to_json()))] + [(f"{below}/{p}", d["node_type"], json.dumps(d)) for p, d in (root.consolidated or {}).items()]
    return with_places(spark.createDataFrame(rows, "path string, node_type string, meta string"))


def children(nodes: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    if recursive:
        return nodes.where(F.col("path").startswith(path if path == "/" else path + "/") & (F.col("path") != path))
    return nodes.where(F.col("parent") == path)


def child_groups(nodes: DataFrame, path: str) -> DataFrame:
    return children(nodes, path).where("node_type = 'group'")


def child_arrays(nodes: DataFrame, path: str) -> DataFrame:
    return children(nodes, path).where("node_type = 'array'")


def traverse(nodes: DataFrame, path: str = "/") -> DataFrame:
    """A subtree with its root, in path order."""
    return nodes.where((F.col("path") == path) | F.col("path").startswith(path if path == "/" else path + "/")).orderBy("path")


def tree_lines(nodes: DataFrame) -> DataFrame:
    """path, line: indented names, with shape and type of arrays."""
    shape = F.get_json_object("meta", "$.shape")
    kind = F.coalesce(F.get_json_object("meta", "$.data_type.name"), F.get_json_object("meta", "$.data_type"), F.get_json_object("meta", "$.dtype"))
    tail = F.when(F.col("node_type") == "array", F.concat(F.lit(" "), F.regexp_replace(shape, ",(?! )", ", "), F.lit(" "), kind)).otherwise("")
    text = F.when(F.col("path") == "/", F.lit("/")).otherwise(F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), tail))
    return nodes.select("path", text.alias("line"))


def tree(nodes: DataFrame) -> str:
    """The tree as one text; a hierarchy's nodes fit the driver, as its metadata does."""
    return "\n".join(r["line"] for r in tree_lines(nodes).orderBy("path").toLocalIterator())


def consolidate(nodes: DataFrame, path: str = "/") -> dict:
    """Metadata documents below a path, by relative path."""
    below = children(nodes, path, recursive=True).select("path", "meta")
    cut = 1 if path == "/" else len(path) + 1
    return {r["path"][cut:]: json.loads(r["meta"]) for r in below.orderBy("path").toLocalIterator()}
