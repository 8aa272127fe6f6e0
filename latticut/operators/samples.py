"""Vertex subsets to measure a tree's cuts on: uniform ones, and balls around a vertex.

Rows are ordered by a drawn number. Ranks are counted by ranges of that number first, so no task sorts a
whole sample; ranges that lie beyond the size are left out before sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .traverse import bfs_levels

#: Drawn numbers are whole, from 0 to below this.
SPAN = 1 << 31


def draw(id_: Column, sample: Column) -> Column:
    return F.pmod(F.xxhash64(id_, sample), F.lit(SPAN))


def first_rows(rows: DataFrame, by: list[str], order: list[str], size: Column, ranges: int = 1024) -> DataFrame:
    """The size first rows of each group by, in the order of columns order, then of _draw, then of id; with their rank from 1."""
    ranged = rows.withColumn("_range", F.floor(F.col("_draw") / SPAN * ranges))
    keys = [*by, *order, "_range"]
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy(*order, "_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    near = ranged.join(offsets, keys).where(F.col("_before") < size)
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*keys).orderBy("_draw", "id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= size).drop("_range", "_before", "_draw")


def uniform_samples(vertices: DataFrame, sizes: list[int], repetitions: int = 1, of: Callable[[Column, Column], Column] = draw) -> DataFrame:
    """sample, size and id of repetitions samples of each size; sample numbers run through sizes first.

    A size above half of the vertices stands for what is left of them, so a sample is never the larger side.
    """
    ids = vertices.select("id").distinct()
    n = ids.count()
    wanted = [(min(s, n - s)) for s in sizes if 0 < s < n]
    if not wanted:
        return ids.limit(0).select(F.lit(0).cast("long").alias("sample"), F.lit(0).cast("long").alias("size"), "id")
    plan = F.explode(F.array(*[F.struct(F.lit(k + r * len(wanted)).cast("long").alias("sample"), F.lit(s).cast("long").alias("size")) for r in range(repetitions) for k, s in enumerate(wanted)]))
    rows = ids.withColumn("_s", plan).select("id", "_s.sample", "_s.size").withColumn("_draw", of(F.col("id"), F.col("sample")))
    return first_rows(rows, ["sample"], [], F.col("size")).select("sample", "size", "id")


def ball(edges: DataFrame, start: DataFrame, size: int, of: Callable[[Column, Column], Column] = draw, seed: int = 0) -> DataFrame:
    """id and level of the size vertices nearest to the start (id); of the last level, those with the least drawn numbers."""
    found = bfs_levels(edges, start).withColumn("_draw", of(F.col("id"), F.lit(seed))).withColumn("_all", F.lit(0))
    return first_rows(found, ["_all"], ["level"], F.lit(size)).select("id", "level")
