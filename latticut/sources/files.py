"""Partition and tree files.

A partition file has one whole number a line, line i the part of vertex i; comments and blank lines are left out.
A tree file has a line a level, leaves first: a parent and a weight for each node. Nodes are numbered within their
level, a parent is a number within the next one, and -1 stands for none. A level is one line, so it is one row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graphs import numbered as numbered_lines
from .graphs import read_lines


def parse_partition(lines: DataFrame) -> DataFrame:
    """id and part."""
    rows = numbered_lines(lines.where(F.trim("line") != ""))
    return rows.select(F.col("n").cast("long").alias("id"), F.trim("line").cast("long").alias("part"))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    return parse_partition(read_lines(spark, path))


def labels_of(edges_vertices: DataFrame, partition: DataFrame) -> DataFrame:
    """id and part of a graph's vertices; those that the partition leaves out have a null part."""
    return edges_vertices.select("id").join(partition, "id", "left")


def parts_of(partition: DataFrame) -> DataFrame:
    """parts: one more than the highest number."""
    return partition.agg((F.max("part") + 1).alias("parts"))


def write_partition(labels: DataFrame, path: str) -> None:
    """A line for each vertex in the order of ids, which are to run from 0 without gaps."""
    labels.orderBy("id").select(F.col("part").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def parse_tree(lines: DataFrame) -> DataFrame:
    """level, node, parent (null at the top) and weight."""
    levels = numbered_lines(lines.where(F.trim("line") != "")).select(F.col("n").cast("int").alias("level"), F.split(F.trim("line"), "\\s+").alias("f"))
    nodes = levels.select("level", "f", F.explode(F.sequence(F.lit(0), (F.size("f") / 2).cast("int") - 1)).alias("k"))
    field = lambda k: F.element_at("f", (k + 1).cast("int")).cast("long")
    parent = field(F.col("k") * 2)
    return nodes.select("level", F.col("k").cast("long").alias("node"), F.when(parent >= 0, parent).alias("parent"), field(F.col("k") * 2 + 1).alias("weight"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return parse_tree(read_lines(spark, path))


def numbered(tree: DataFrame) -> DataFrame:
    """The tree with nodes numbered from 0 within their level, in the order of their ids."""
    at = tree.select("level", "node", (F.row_number().over(W.partitionBy("level").orderBy("node")) - 1).cast("long").alias("number"))
    up = at.select((F.col("level") - 1).alias("level"), F.col("node").alias("parent"), F.col("number").alias("above"))
    return tree.join(at, ["level", "node"]).join(up, ["level", "parent"], "left").select("level", F.col("number").alias("node"), F.col("above").alias("parent"), "weight")


def tree_lines(tree: DataFrame) -> DataFrame:
    """level and value: a line a level."""
    pair = F.struct("node", F.concat_ws(" ", F.coalesce("parent", F.lit(-1)), F.col("weight")).alias("text"))
    return numbered(tree).groupBy("level").agg(F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["text"]), " ").alias("value"))


def write_tree(tree: DataFrame, path: str) -> None:
    tree_lines(tree).orderBy("level").select("value").coalesce(1).write.mode("overwrite").text(path)
