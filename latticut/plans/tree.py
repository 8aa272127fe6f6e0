"""Cuts of the hierarchy's tree: closure, greedy and dynamic k-way normalised cuts, labels, nodes that must not move, least cuts.

tree: (level, node, parent, weight, subtree_size, subtree_volume), parents one level up, null at the top.
A cut is a list of its edges, each named by its lower end (level, node); there are fewer than parts of them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.storage import checkpointed
from . import local

#: Siblings merged in one task; a power of two, so that blocks merge in the pairs that all of them would.
BLOCK = 1024
CELLS = "cost array<double>, cut array<double>, volume array<double>, best array<array<bigint>>"


def depth(tree: DataFrame) -> int:
    return tree.agg(F.max("level")).first()[0]


def closure(tree: DataFrame) -> DataFrame:
    """level, node, alevel, anode: each node with itself and all above it."""
    links = tree.where("parent is not null").select(F.col("level").alias("alevel"), F.col("node").alias("anode"), "parent")
    here = checkpointed(tree.select("level", "node", F.col("level").alias("alevel"), F.col("node").alias("anode")))
    out = here
    for _ in range(depth(tree)):
        here = checkpointed(here.join(links, ["alevel", "anode"]).select("level", "node", (F.col("alevel") + 1).alias("alevel"), F.col("parent").alias("anode")))
        out = out.unionByName(here)
    return out


def children(tree: DataFrame) -> DataFrame:
    """level, node and the sorted list of its children."""
    return tree.where("parent is not null").groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("children"))


def to_graph(tree: DataFrame) -> DataFrame:
    """The tree as weighted edges; ids count the nodes level by level, by node."""
    sizes = tree.groupBy("level").agg(F.count("*").alias("n"))
    starts = sizes.select("level", (F.sum("n").over(W.orderBy("level")) - F.col("n")).alias("start"))
    ids = tree.withColumn("i", F.row_number().over(W.partitionBy("level").orderBy("node")) - 1).join(F.broadcast(starts), "level").select("level", "node", "parent", "weight", (F.col("start") + F.col("i")).alias("id"))
    up = ids.select((F.col("level") - 1).alias("level"), F.col("node").alias("parent"), F.col("id").alias("dst"))
    return ids.join(up, ["level", "parent"]).select(F.col("id").alias("src"), "dst", F.col("weight").cast("long").alias("w"))


def greedy_cut(tree: DataFrame, parts: int, pairs: DataFrame | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Normalised cut of up to parts parts: each round cuts the edge that adds least.

    A node's state is the volume and cut of what hangs below it in its own part. Only the edge that
    is chosen and the parts' sums (fewer than parts rows) come to the driver.
    """
    pairs = closure(tree) if pairs is None else pairs
    state = checkpointed(tree.select("level", "node", "parent", F.col("weight").cast("double").alias("w"), F.col("subtree_volume").cast("double").alias("vol"), F.lit(0.0).alias("cut"), F.lit(0).alias("label")))
    whole = state.where("parent is null").agg(F.sum("vol")).first()[0] or 0.0
    sums, chosen, cost = [(0.0, whole)], [], 0.0
    while len(sums) < parts:
        values = [c / v if v else 0.0 for c, v in sums]
        rows = [(i, c, v, sum(values) - values[i]) for i, (c, v) in enumerate(sums)]
        comps = state.sparkSession.createDataFrame(rows, "label int, _cut double, _vol double, _rest double")
        open_ = state.where("parent is not null").join(F.broadcast(comps), "label").where("vol > 0 and _vol - vol > 0")
        if chosen:
            open_ = open_.where(~F.struct("level", "node").isin([F.struct(F.lit(a).alias("level"), F.lit(b).alias("node")) for a, b in chosen]))
        value = (F.col("w") + F.col("cut")) / F.col("vol") + (F.col("w") + F.col("_cut") - F.col("cut")) / (F.col("_vol") - F.col("vol")) + F.col("_rest")
        best = open_.agg(F.min(F.struct(value.alias("value"), "level", "node", "label", "w", "vol", "cut")).alias("b")).first()["b"]
        if best is None:
            break
        cost, old, new = best["value"], best["label"], len(sums)
        chosen.append((best["level"], best["node"]))
        if new + 1 == parts:  # no round is left that would look at the state
            break
        below = pairs.where((F.col("alevel") == best["level"]) & (F.col("anode") == best["node"])).select("level", "node", F.lit(True).alias("_below"))
        above = pairs.where((F.col("level") == best["level"]) & (F.col("node") == best["node"]) & (F.col("alevel") > best["level"])).select(F.col("alevel").alias("level"), F.col("anode").alias("node"), F.lit(True).alias("_above"))
        mine = F.col("label") == old
        up = mine & F.col("_above").isNotNull()
        state = checkpointed(
            state.join(below, ["level", "node"], "left").join(F.broadcast(above), ["level", "node"], "left").select(
                "level", "node", "parent", "w",
                F.when(up, F.col("vol") - best["vol"]).otherwise(F.col("vol")).alias("vol"),
                F.when(up, F.col("cut") + best["w"] - best["cut"]).otherwise(F.col("cut")).alias("cut"),
                F.when(mine & F.col("_below").isNotNull(), F.lit(new)).otherwise(F.col("label")).alias("label"),
            )
        )
        sums[old] = (sums[old][0] + best["w"] - best["cut"], sums[old][1] - best["vol"])
        sums.append((best["cut"] + best["w"], best["vol"]))
    return cost, chosen


def _as_rows(frame: pd.DataFrame, cells: list[list[tuple]]) -> pd.DataFrame:
    for i, name in enumerate(("cost", "cut", "volume", "best")):
        frame[name] = [[list(c[i]) if i == 3 else float(c[i]) for c in row] for row in cells]
    return frame


def dynamic_cut(tree: DataFrame, parts: int) -> tuple[float, list[tuple[int, int]]]:
    """Normalised cut of exactly parts parts by a dynamic program, level by level; (inf, []) if there are too few nodes.

    A cell has the cost of the parts that are closed and the cut and volume of the one that is still
    open; the cheapest cell a number of cuts stays, so the cut need not be the least. Siblings are merged in blocks, so a node with very many children is shared out.
    """
    top = depth(tree)
    base = tree.select("level", "node", "parent", F.col("weight").cast("double").alias("weight"), F.col("subtree_volume").cast("double").alias("_volume"))

    def cut_parents(batches):
        for pdf in batches:
            cells = [local.with_parent_cut(local._cells(r.cost, r.cut, r.volume, r.best), r.level, r.node, r.weight, parts) for r in pdf.itertuples()]
            yield _as_rows(pdf[["node", "parent", "rank"]].copy(), cells)

    def fold(rows: DataFrame, under_root: bool) -> DataFrame:
        while True:
            most = rows.agg(F.max("rank")).first()[0] or 0
            final = under_root and most < BLOCK

            def merge(pdf: pd.DataFrame) -> pd.DataFrame:
                cells = [local._cells(r.cost, r.cut, r.volume, r.best) for r in pdf.sort_values("rank").itertuples()]
                return _as_rows(pdf.iloc[[0]][["parent", "block"]].copy(), [local.merged(cells, parts, final)])  # noqa: B023

            blocks = rows.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long"))
            out = blocks.groupBy("parent", "block").applyInPandas(merge, f"parent bigint, block bigint, {CELLS}")
            rows = checkpointed(out.select("parent", F.col("block").alias("rank"), "cost", "cut", "volume", "best"))
            if most < BLOCK:
                return rows

    single = tree.where(F.col("level") == top).count() == 1
    none = "array(cast(array() as array<bigint>))"
    here = base.where("level = 0").select("*", F.expr("array(0D)").alias("cost"), F.expr("array(0D)").alias("cut"), F.expr("array(_volume)").alias("volume"), F.expr(none).alias("best"))
    for level in range(top):
        ranked = here.withColumn("rank", F.row_number().over(W.partitionBy("parent").orderBy("node")).cast("long") - 1)
        cut = ranked.select("level", "node", "parent", "rank", "weight", "cost", "cut", "volume", "best").mapInPandas(cut_parents, f"node bigint, parent bigint, rank bigint, {CELLS}")
        above = fold(cut, single and level == top - 1).withColumnRenamed("parent", "node")
        here = checkpointed(base.where(F.col("level") == level + 1).join(above, "node").select("level", "node", "parent", "weight", "_volume", "cost", "cut", "volume", "best"))
    # several tops are the children of one root, without edges to cut
    last = here.withColumn("rank", F.row_number().over(W.orderBy("node")).cast("long") - 1).withColumn("parent", F.lit(-1).cast("long"))
    root = fold(last.select("parent", "rank", "cost", "cut", "volume", "best"), not single).first()
    cells = local._cells(root["cost"], root["cut"], root["volume"], root["best"]) if root else []
    if len(cells) < parts or math.isinf(local.whole_cost(cells[parts - 1])):
        return math.inf, []
    best = cells[parts - 1][3]
    return local.whole_cost(cells[parts - 1]), list(zip(best[::2], best[1::2], strict=True))


def edge_table(tree: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """level, node, color of a cut's edges; colors count from 1, from the top down."""
    rows = [(a, b, i + 1) for i, (a, b) in enumerate(sorted(edges, key=lambda e: (-e[0], e[1])))]
    return tree.sparkSession.createDataFrame(rows, "level int, node bigint, color int")


def labels_of_cut(tree: DataFrame, edges: list[tuple[int, int]], pairs: DataFrame | None = None, level: int = 0) -> DataFrame:
    """id and part of the nodes of a level: the color of the nearest cut edge at or above it, else 0."""
    pairs = closure(tree) if pairs is None else pairs
    cut = edge_table(tree, edges).select(F.col("level").alias("alevel"), F.col("node").alias("anode"), "color")
    near = pairs.where(F.col("level") == level).join(F.broadcast(cut), ["alevel", "anode"]).groupBy("node").agg(F.min_by("color", "alevel").alias("color"))
    return tree.where(F.col("level") == level).join(near, "node", "left").select(F.col("node").alias("id"), F.coalesce("color", F.lit(0)).cast("long").alias("part"))


def taboo_nodes(tree: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """level and node of parents all of whose children are cut off or are such parents themselves."""
    cut = edge_table(tree, edges).select("level", "node")
    out, gone = None, cut.where("level = 0")
    for level in range(depth(tree)):
        marks = gone.select("node").distinct().withColumn("_gone", F.lit(1))
        kids = tree.where((F.col("level") == level) & F.col("parent").isNotNull()).join(marks, "node", "left")
        full = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.count("_gone").alias("g")).where("n = g")
        found = checkpointed(full.select(F.lit(level + 1).alias("level"), "node"))
        out = found if out is None else out.unionByName(found)
        gone = found.unionByName(cut.where(F.col("level") == level + 1))
    return cut.limit(0) if out is None else out


def project(tree: DataFrame, labels: DataFrame, level: int, leaders: DataFrame) -> DataFrame:
    """Labels (id, part) of level + 1 on its children at level; leaders (node, color) of the level start parts of their own."""
    up = labels.select(F.col("id").alias("parent"), F.col("part").alias("_part"))
    return tree.where(F.col("level") == level).join(up, "parent", "left").join(F.broadcast(leaders.select("node", "color")), "node", "left").select(F.col("node").alias("id"), F.coalesce("color", "_part", F.lit(0)).cast("long").alias("part"))


def least_tree_cut(tree: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each sample (sample, id) of leaves, the least cut of the tree that parts it from the other leaves; leaves may be cut off at their volume.

    Two sums a node, the cost below it if it is on the sample's side or on the other, rolled up level by level for all samples at once.
    """
    names = samples.select("sample").distinct()
    leaves = tree.where("level = 0").crossJoin(F.broadcast(names)).join(samples.select("sample", F.col("id").alias("node"), F.lit(True).alias("_in")), ["sample", "node"], "left")
    volume, inside = F.col("subtree_volume").cast("double"), F.col("_in").isNotNull()
    here = leaves.select("sample", "node", "parent", "weight", F.when(inside, 0.0).otherwise(volume).alias("s"), F.when(inside, volume).otherwise(0.0).alias("t"))
    for level in range(depth(tree)):
        up = here.groupBy("sample", F.col("parent").alias("node")).agg(F.sum(F.least("s", F.col("t") + F.col("weight"))).alias("s"), F.sum(F.least("t", F.col("s") + F.col("weight"))).alias("t"))
        here = checkpointed(tree.where(F.col("level") == level + 1).join(up, "node").select("sample", "node", "parent", "weight", "s", "t"))
    return here.groupBy("sample").agg(F.sum(F.least("s", "t")).alias("cut"))


def resized(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """A tree (level, node, parent, weight) with subtree_size and subtree_volume rolled up from its leaves' degrees (id, degree)."""
    here = tree.where("level = 0").join(leaves.select(F.col("id").alias("node"), "degree"), "node", "left").select("level", "node", "parent", "weight", F.lit(1).cast("long").alias("subtree_size"), F.coalesce("degree", F.lit(0)).alias("subtree_volume"))
    out = here
    for level in range(depth(tree)):
        sums = here.groupBy(F.col("parent").alias("node")).agg(F.sum("subtree_size").alias("subtree_size"), F.sum("subtree_volume").alias("subtree_volume"))
        here = checkpointed(tree.where(F.col("level") == level + 1).select("level", "node", "parent", "weight").join(sums, "node").select(out.columns))
        out = out.unionByName(here)
    return out


def finalized(tree: DataFrame) -> DataFrame:
    """The tree with one root: several tops get a root -1 above them, by edges of weight 0."""
    top = depth(tree)
    tops = tree.where(F.col("level") == top)
    if tops.count() <= 1:
        return tree
    root = tops.agg(F.lit(top + 1).alias("level"), F.lit(-1).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("weight"), F.sum("subtree_size").alias("subtree_size"), F.sum("subtree_volume").alias("subtree_volume"))
    below = tree.withColumns({"parent": F.when(F.col("level") == top, F.lit(-1)).otherwise(F.col("parent")), "weight": F.when(F.col("level") == top, F.lit(0)).otherwise(F.col("weight"))})
    return below.select(root.columns).unionByName(root)


def _below(pairs: DataFrame, level: int, node: int) -> DataFrame:
    return pairs.where((F.col("alevel") == level) & (F.col("anode") == node)).select("level", "node")


def painted(labels: DataFrame, pairs: DataFrame, level: int, node: int, label: int, match: int | None = None, avoid: list[tuple[int, int]] = ()) -> DataFrame:
    """Labels (level, node, label) with the subtree of a node painted. pairs: the tree's closure.

    match: only where all nodes from there up to the subtree's top have this label; avoid: subtrees that are left out.
    """
    stops = _stopped(labels, pairs, match, avoid)
    under = _below(pairs, level, node)
    inside = pairs.join(under, ["level", "node"], "left_semi").join(under.select(F.col("level").alias("alevel"), F.col("node").alias("anode")), ["alevel", "anode"], "left_semi")
    blocked = inside.join(stops, ["alevel", "anode"], "left_semi").select("level", "node").distinct()
    go = under.join(blocked, ["level", "node"], "left_anti").withColumn("_go", F.lit(label).cast("long"))
    return checkpointed(labels.join(go, ["level", "node"], "left").select("level", "node", F.coalesce("_go", F.col("label").cast("long")).alias("label")))


def _stopped(labels: DataFrame, pairs: DataFrame, match: int | None, avoid: list[tuple[int, int]]) -> DataFrame:
    """alevel and anode of the nodes at which painting stops."""
    named = labels.select(F.col("level").alias("alevel"), F.col("node").alias("anode"), "label")
    other = named.where(F.lit(False) if match is None else F.col("label") != match).select("alevel", "anode")
    left = labels.sparkSession.createDataFrame(list(avoid), "alevel int, anode bigint").select(F.col("alevel").cast(labels.schema["level"].dataType).alias("alevel"), "anode")
    return other.unionByName(left)


def added_above(values: DataFrame, pairs: DataFrame, level: int, node: int, amount: Column, labels: DataFrame | None = None, match: int | None = None) -> DataFrame:
    """values (level, node, value) with amount, an expression of value, for the nodes above a node. With labels and match: only up to the first with another label."""
    up = pairs.where((F.col("level") == level) & (F.col("node") == node) & (F.col("alevel") > level)).select(F.col("alevel").alias("level"), F.col("anode").alias("node"))
    if match is not None:
        marked = up.join(labels, ["level", "node"])
        first = marked.where(F.col("label") != match).agg(F.min("level").alias("_first"))
        up = marked.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col("level") < F.col("_first"))).select("level", "node")
    return values.join(up.withColumn("_up", F.lit(True)), ["level", "node"], "left").select("level", "node", F.when(F.col("_up"), amount).otherwise(F.col("value")).alias("value"))


def bipartition(tree: DataFrame, level: int, node: int, pairs: DataFrame | None = None) -> DataFrame:
    """id and part of the leaves: 1 below the node, else 0."""
    return labels_of_cut(tree, [(level, node)], pairs)


def tops(tree: DataFrame) -> DataFrame:
    """level, node and top: the highest node above each, as level and number. Nodes of one top are connected."""
    pairs = closure(tree)
    return pairs.groupBy("level", "node").agg(F.max(F.struct("alevel", "anode")).alias("t")).select("level", "node", F.col("t.alevel").alias("top_level"), F.col("t.anode").alias("top"))


def connected(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of leaves (s, t) and whether the tree joins them by edges of a weight above 0."""
    cut = tree.withColumn("parent", F.when(F.col("weight") > 0, F.col("parent")))
    ends = tops(cut).where("level = 0").select("node", "top_level", "top")
    one, two = (ends.select(F.col("node").alias(c), F.struct("top_level", "top").alias(f"_{c}")) for c in ("s", "t"))
    return pairs.join(one, "s").join(two, "t").select("s", "t", (F.col("_s") == F.col("_t")).alias("connected"))


def layers(tree: DataFrame) -> DataFrame:
    """level, size, volume and weight of each level."""
    return tree.groupBy("level").agg(F.count("*").alias("size"), F.sum("subtree_volume").alias("volume"), F.sum("weight").alias("weight"))
