"""Flows and cuts between vertex sets: virtual terminals, capacities, greatest flows of many samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import local
from ..sources.graphs import vertices

#: Ids of the virtual source and sink, and the capacity of their edges in graphs without weights.
SOURCE, SINK, WIDE = -1, -2, 1000


def with_terminals(edges: DataFrame, sources: DataFrame, sinks: DataFrame, weighted: bool = True) -> DataFrame:
    """The graph with a source joined to all sources (id) and a sink to all sinks, by their degrees, or by WIDE without weights."""
    degrees = vertices(edges)
    ends = []
    for terminal, ids in ((SOURCE, sources), (SINK, sinks)):
        to = ids.select("id").join(degrees, "id", "left")
        ends.append(to.select(F.lit(terminal).cast("long").alias("src"), F.col("id").alias("dst"), (F.coalesce("degree", F.lit(0)) if weighted else F.lit(WIDE).cast("long")).alias("w")))
    return edges.select("src", "dst", "w").unionByName(ends[0]).unionByName(ends[1])


def without_terminals(edges: DataFrame) -> DataFrame:
    return edges.where("src >= 0 AND dst >= 0")


def capacities(edges: DataFrame, n: int) -> DataFrame:
    """Edges of vertices 0 to n - 1 count 1; those of virtual ones, below 0 or from n on, count WIDE."""
    virtual = (F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n)
    return edges.select("src", "dst", F.when(virtual, F.lit(WIDE)).otherwise(F.lit(1)).cast("long").alias("w"))


def _checked(edges: DataFrame, most: int) -> DataFrame:
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"a flow is found in one task, so a graph has {most} edges at most; contract it, or use tree.least_tree_cut")
    return edges


def max_flows(edges: DataFrame, terminals: DataFrame, most: int = 1_000_000) -> DataFrame:
    """sample and flow: the greatest flow from a sample's sources to its sinks. terminals: sample, id, source (boolean).

    Samples are dealt to tasks; each has the whole graph, whose size is checked.
    """
    return _solved(edges, terminals, most, "flow double", lambda sample, flow, side: pd.DataFrame({"sample": [sample], "flow": [flow]}))


def least_cut_sides(edges: DataFrame, terminals: DataFrame, most: int = 1_000_000) -> DataFrame:
    """sample and id of the vertices on the sources' side of a least cut."""
    return _solved(edges, terminals, most, "id bigint", lambda sample, flow, side: pd.DataFrame({"sample": sample, "id": sorted(side)}))


def _solved(edges: DataFrame, terminals: DataFrame, most: int, schema: str, of) -> DataFrame:
    names = terminals.select((F.col("sample") + 0).alias("sample")).distinct()
    rows = _checked(edges, most).select("src", "dst", "w").crossJoin(F.broadcast(names))

    def run(graph: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        sources, sinks = (set(ends.loc[ends["source"] == s, "id"]) for s in (True, False))
        flow, side = local.max_flow(list(zip(graph["src"], graph["dst"], graph["w"], strict=True)), sources, sinks)
        return of(ends["sample"].iloc[0], flow, side)

    kept = terminals.select("sample", "id", "source")
    return kept.groupBy("sample").cogroup(rows.groupBy("sample")).applyInPandas(lambda a, b: run(b, a), f"sample bigint, {schema}")
