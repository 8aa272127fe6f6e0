"""Scores of partitions, contraction, and refinement quantities, as joins and aggregates.

edges: (src, dst, w) with src < dst; labels: (id, part). Every vertex of an edge has a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.graphs import adjacency


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Both directions with the labels of both ends, ps and pd."""
    one = labels.select(F.col("id").alias("src"), F.col("part").alias("ps"))
    two = labels.select(F.col("id").alias("dst"), F.col("part").alias("pd"))
    return edges.join(one, "src").join(two, "dst").select(F.expr("stack(2, src, dst, w, ps, pd, dst, src, w, pd, ps) AS (src, dst, w, ps, pd)"))


def part_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """size, volume and cut of each part; labels of vertices without edges count to the size."""
    from_each = labelled(edges, labels).groupBy(F.col("ps").alias("part")).agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("ps") != F.col("pd"), F.col("w")).otherwise(0)).alias("cut"))
    sizes = labels.groupBy("part").agg(F.count("*").alias("size"))
    return sizes.join(from_each, "part", "left").select("part", "size", F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("cut", F.lit(0)).alias("cut"))


def scores(stats: DataFrame) -> DataFrame:
    """Cut size, sparsity and conductance (both by the smaller side), and normalised cut of a partition's stats."""
    sums = stats.agg(F.sum("cut").alias("_twice"), F.min("size").alias("_size"), F.min("volume").alias("_volume"), F.sum(F.col("cut") / F.nullif("volume", F.lit(0))).alias("normalized_cut"))
    half = F.col("_twice") / 2
    return sums.select(half.alias("cut_size"), (half / F.nullif("_size", F.lit(0))).alias("sparsity"), (half / F.nullif("_volume", F.lit(0))).alias("conductance"), "normalized_cut")


def contracted(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between parts with summed weights, and vertices with the volumes inside."""
    cut = labelled(edges, labels).where("ps < pd").groupBy(F.col("ps").alias("src"), F.col("pd").alias("dst")).agg(F.sum("w").alias("w"))
    return cut, part_stats(edges, labels).select(F.col("part").alias("id"), F.col("volume").alias("vertex_weight"))


def attachments(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weight from each vertex to each part next to it, and the vertex's own part."""
    return labelled(edges, labels).groupBy("src", "ps", "pd").agg(F.sum("w").alias("weight"))


def gains(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """internal and external degree, gain of the best move, and the best other part (ties to the lowest; null if none)."""
    near = attachments(edges, labels)
    other = F.col("pd") != F.col("ps")
    out = near.groupBy(F.col("src").alias("id"), F.col("ps").alias("part")).agg(
        F.sum(F.when(~other, F.col("weight")).otherwise(0)).alias("internal"),
        F.sum(F.when(other, F.col("weight")).otherwise(0)).alias("external"),
        F.max("weight").alias("_most"),
        F.max(F.when(other, F.struct(F.col("weight"), (-F.col("pd")).alias("neg")))).alias("_best"),
    )
    # staying counts as a move, so no gain is negative
    return out.select("id", "part", "internal", "external", (F.greatest("_most", "internal") - F.col("internal")).alias("gain"), (-F.col("_best.neg")).alias("best_part"))


def boundary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Vertices that may move: as much weight outside as inside, or any outside where the part's volume is at least the mean."""
    volumes = part_stats(edges, labels).select(F.col("part").alias("_p"), "volume", F.floor(F.sum("volume").over(W.partitionBy()) / F.count("*").over(W.partitionBy())).alias("mean"))
    rows = gains(edges, labels).join(volumes, F.col("part") == F.col("_p"))
    return rows.where((F.col("external") >= F.col("internal")) | ((F.col("external") > 0) & (F.col("volume") >= F.col("mean")))).select("id", "part", "internal", "external")


def degree_stats(edges: DataFrame) -> DataFrame:
    """Vertices, edges, and maximum, mean, quartiles (truncated) and deviation of the number of neighbours."""
    degrees = adjacency(edges).groupBy("src").agg(F.count("*").alias("d"))
    q = lambda p: F.percentile("d", F.lit(p)).cast("long")
    return degrees.agg(F.count("*").alias("vertices"), (F.sum("d") / 2).cast("long").alias("edges"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 2).alias("avg_degree"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.stddev_pop("d").alias("std"))


def accessors(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each vertex: its part, number of neighbours, those in its part, degree, degree inside its part, weight of its cut edges, and its part's volume."""
    rows = labelled(edges, labels)
    own = rows["ps"] == rows["pd"]
    found = rows.groupBy(F.col("src").alias("id"), F.col("ps").alias("part")).agg(F.count("*").alias("neighbours"), F.count_if(own).alias("active"), F.sum("w").alias("initial_degree"), F.sum(F.when(own, F.col("w")).otherwise(0)).alias("degree"))
    volumes = found.groupBy("part").agg(F.sum("initial_degree").alias("component_volume"))
    return found.join(volumes, "part").select("id", "part", "neighbours", "active", "initial_degree", "degree", (F.col("initial_degree") - F.col("degree")).alias("cut_edges"), "component_volume")


def totals(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """volume, cut_edges, edge_ratio (of the edges' weight), components and node_ratio (of the vertices) of a labelling."""
    seen = edges.join(labels.select(F.col("id").alias("src"), F.col("part").alias("ps")), "src").join(labels.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    cut = seen.agg((2 * F.sum("w")).alias("volume"), F.sum(F.when(F.col("ps") != F.col("pd"), F.col("w")).otherwise(0)).alias("cut_edges"))
    parts = labels.agg(F.count_distinct("part").alias("components"), F.count("*").alias("_n"))
    return cut.crossJoin(F.broadcast(parts)).select("volume", "cut_edges", (2 * F.col("cut_edges") / F.col("volume")).alias("edge_ratio"), "components", (F.col("components") / F.col("_n")).alias("node_ratio"))


def contracted_vertices(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """id and vertex_weight of the contracted graph."""
    return contracted(edges, labels)[1]


def objective(stats: DataFrame, kind: str) -> DataFrame:
    """value of a partition's stats by sparsity, conductance or normalized_cut; empty parts make a normalised cut NaN, as 0 / 0."""
    if kind not in ("sparsity", "conductance", "normalized_cut"):
        raise ValueError(f"no objective {kind}")
    return scores(stats).select(F.col(kind).cast("double").alias("value"))


def with_empty_parts(stats: DataFrame, parts: int) -> DataFrame:
    """The stats of parts 0 to parts - 1, those without vertices with zeros."""
    all_ = stats.sparkSession.range(parts).select(F.col("id").alias("part"))
    return all_.join(stats, "part", "left").na.fill(0, ["size", "volume", "cut"])


def set_cuts(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """sample and cut: the weight of edges with one end in a sample (sample, id). Samples without a cut edge have 0."""
    both = adjacency(edges).join(samples.select("sample", F.col("id").alias("src")), "src")
    there = samples.select("sample", F.col("id").alias("dst"), F.lit(True).alias("_in"))
    sums = both.join(there, ["sample", "dst"], "left").groupBy("sample").agg(F.sum(F.when(F.col("_in").isNull(), F.col("w")).otherwise(0)).alias("cut"))
    return samples.select("sample").distinct().join(sums, "sample", "left").select("sample", F.coalesce("cut", F.lit(0)).alias("cut"))


def complement(vertices: DataFrame, samples: DataFrame) -> DataFrame:
    """sample and id of the vertices that are not in the sample. samples: few names, any number of ids."""
    names = samples.select("sample").distinct()
    return names.crossJoin(vertices.select("id")).join(samples.select("sample", "id"), ["sample", "id"], "left_anti")


def moved(labels: DataFrame, ids: DataFrame, part: int) -> DataFrame:
    """Labels with the ids in part, whatever is connected."""
    go = ids.select("id", F.lit(part).cast("long").alias("_to"))
    return labels.join(go, "id", "left").select("id", F.coalesce("_to", F.col("part").cast("long")).alias("part"))


def reset(labels: DataFrame) -> DataFrame:
    return labels.select("id", F.lit(0).cast("long").alias("part"))


def after_move(edges: DataFrame, labels: DataFrame, ids: DataFrame, part: int) -> DataFrame:
    """part, size, volume and cut of each part after a move, from those before and the edges at what moves."""
    new = moved(labels, ids, part)
    at = labelled(edges, labels).join(ids.select(F.col("id").alias("_m")), F.col("src") == F.col("_m"), "left").join(ids.select(F.col("id").alias("_o")), F.col("dst") == F.col("_o"), "left")
    at = at.where(F.col("_m").isNotNull() | F.col("_o").isNotNull())
    ns = F.when(F.col("_m").isNotNull(), F.lit(part)).otherwise(F.col("ps"))
    nd = F.when(F.col("_o").isNotNull(), F.lit(part)).otherwise(F.col("pd"))
    sign = lambda p, q, s: F.struct(p.cast("long").alias("part"), (F.lit(s) * F.when(p != q, F.col("w")).otherwise(0)).alias("cut"), (F.lit(s) * F.col("w")).alias("volume"))
    delta = at.select(F.explode(F.array(sign(F.col("ps"), F.col("pd"), -1), sign(ns, nd, 1))).alias("d")).groupBy("d.part").agg(F.sum("d.cut").alias("dc"), F.sum("d.volume").alias("dv"))
    sizes = new.groupBy("part").agg(F.count("*").alias("size"))
    old = part_stats(edges, labels).select(F.col("part").cast("long").alias("part"), "volume", "cut")
    both = old.join(delta, "part", "full").select("part", (F.coalesce("volume", F.lit(0)) + F.coalesce("dv", F.lit(0))).alias("volume"), (F.coalesce("cut", F.lit(0)) + F.coalesce("dc", F.lit(0))).alias("cut"))
    return both.join(sizes, "part").select("part", "size", "volume", "cut")


def gain_to(edges: DataFrame, labels: DataFrame, part: int) -> DataFrame:
    """id and gain: weight to the part less weight to the own one, of each vertex."""
    rows = labelled(edges, labels)
    to = F.sum(F.when(F.col("pd") == part, F.col("w")).otherwise(0)) - F.sum(F.when(F.col("pd") == F.col("ps"), F.col("w")).otherwise(0))
    return rows.groupBy(F.col("src").alias("id")).agg(to.alias("gain"))
