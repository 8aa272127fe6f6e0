"""Experiments as tables: parameters, grids of them, scores of given partitions, quality of a tree's cuts, and report rows that are appended to CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cuts, samples
from ..sources import files
from ..sources.graphs import vertices
from . import tree as trees


@dataclass(frozen=True)
class Evaluation:
    """What is scored: the graph's name, what made the partition, and how long that took."""

    name: str = ""
    algo: str = ""
    time: float = 0.0


@dataclass(frozen=True)
class Quality:
    """How a tree's cuts are measured: samples of each size, drawn as ball or uniform."""

    sizes: tuple[int, ...] = (10, 100, 1_000, 10_000, 100_000)
    repetitions: int = 50
    phi: float = 0.2
    boost: float = 1.0
    potential: float = 1e-6
    seed: int = 1


#: Numbers of parts, seeds and parameters of the experiments.
PARTS = (2, 4, 8, 16, 32, 64, 128)
POTENTIALS = tuple(10.0**k for k in range(2, -10, -1))
PHIS = (0.4, 0.3, 0.2, 0.1, 0.05, 0.025, 0.01)


def grid(spark: SparkSession, **values) -> DataFrame:
    """A row for each combination of values, by name. The values are few and given."""
    out = spark.range(0, 1, 1, 1).select()
    for name, each in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in each])).alias(name))
    return out


def benchmark_grid(spark: SparkSession, seeds: int = 10) -> DataFrame:
    return grid(spark, seed=range(1, seeds + 1), phi=[0.0], parts=PARTS, timeout=[1200])


def threshold_grid(spark: SparkSession, tries: int = 10) -> DataFrame:
    return grid(spark, potential=POTENTIALS, attempt=range(tries), timeout=[1200])


def quality_grid(spark: SparkSession, tries: int = 5) -> DataFrame:
    return grid(spark, phi=PHIS, potential=[1e-5], attempt=range(tries), timeout=[300])


def hierarchy_row(value: DataFrame, name: str, kind: str, phi: float, potential: float, parts: int, decomposition_ms: int, solving_ms: int, actual: float) -> DataFrame:
    """value: one row with the objective on the tree, value."""
    return value.select(F.lit(name).alias("Graph Name"), F.lit(kind).alias("Experiment Type"), F.lit(phi).alias("Phi"), F.lit(potential).alias("Potential"), F.lit(parts).alias("Parts"), F.lit(decomposition_ms).alias("Decomposition Time"), F.lit(solving_ms).alias("Solving Time"), F.col("value").alias("Value"), F.lit(actual).alias("Actual"))


def decomposition_row(edges: DataFrame, labels: DataFrame, name: str, phi: float, potential: float, time_ns: int) -> DataFrame:
    """Cut edges and components over vertices of a decomposition."""
    return cuts.totals(edges, labels).select(F.lit(name).alias("Graph Name"), F.lit(phi).alias("Phi"), F.lit(potential).alias("Potential"), F.lit(time_ns).alias("Time"), F.col("edge_ratio").alias("Edge Ratio"), F.col("node_ratio").alias("Node Ratio"))


def comparison_row(edges: DataFrame, partition: DataFrame, what: Evaluation = Evaluation()) -> DataFrame:
    """The normalised cut of a given partition (id, part) of a graph. A part without vertices makes it NaN, a vertex without a part is an error."""
    labels = files.labels_of(vertices(edges), partition)
    scored = labels.select("id", F.when(F.col("part").isNull(), F.raise_error(F.lit("a vertex has no part"))).otherwise(F.col("part")).alias("part"))
    stats = cuts.part_stats(edges, scored)
    value = stats.agg(F.sum(F.col("cut") / F.nullif("volume", F.lit(0))).alias("value"), F.count("*").alias("_found"))
    both = files.parts_of(partition).crossJoin(value)
    whole = F.when(F.col("_found") < F.col("parts"), F.lit(float("nan"))).otherwise(F.col("value"))
    return both.select(F.lit(what.name).alias("Graph Name"), F.lit(what.algo).alias("Experiment Type"), F.col("parts").alias("Parts"), F.lit(what.time).alias("Time"), whole.alias("Value"))


def quality_rows(found: DataFrame, name: str, phi: float, potential: float, time_us: int) -> DataFrame:
    """found: see quality."""
    return found.select(F.lit(name).alias("Graph Name"), F.lit(phi).alias("Phi"), F.lit(potential).alias("Potential"), F.lit(time_us).alias("Running Time"), F.col("size").alias("Size"), F.col("value").alias("Value"), F.col("actual").alias("Actual"), F.col("ratio").alias("Ratio"))


def statistics_row(edges: DataFrame, name: str) -> DataFrame:
    s = cuts.degree_stats(edges)
    return s.select(F.lit(name).alias("Graph Name"), F.col("vertices").alias("Vertices"), F.col("edges").alias("Edges"), F.col("max_degree").alias("Max Degree"), F.col("avg_degree").alias("Avg Degree"), F.col("p25").alias("25th"), F.col("p50").alias("50th"), F.col("p75").alias("75th"), F.col("p90").alias("90th"), F.col("std").alias("STD"))


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows behind those that are there; every file has the header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def quality(edges: DataFrame, tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """sample, size, value (the least cut of the tree), actual (the cut of the graph) and ratio of each sample (sample, size, id) of vertices."""
    true = cuts.set_cuts(edges, chosen).select("sample", F.col("cut").alias("actual"))
    least = trees.least_tree_cut(tree, chosen.select("sample", "id")).select("sample", F.col("cut").alias("value"))
    sizes = chosen.groupBy("sample").agg(F.first("size").alias("size"))
    return sizes.join(least, "sample").join(true, "sample").select("sample", "size", "value", "actual", (F.col("value") / F.nullif("actual", F.lit(0))).alias("ratio"))


def quality_loop(edges: DataFrame, tree: DataFrame, params: Quality = Quality(), of=samples.draw) -> DataFrame:
    """quality of repetitions uniform samples of each size, all at once."""
    return quality(edges, tree, samples.uniform_samples(vertices(edges), list(params.sizes), params.repetitions, of))
