"""Graphs as DataFrames, from text formats, tables and generators.

Edges are undirected and simple: one row (src, dst, w) with src < dst, ids and weights long. adjacency()
has both directions. Readers work line by line on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts and suppliers share one id space: a part's id is its key plus this.
PART_BASE = 1_000_000_000_000


def canonical(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges of rows (u, v): self loops go, directions and repeats are merged. weight: a column to sum, else each edge weighs 1."""
    ends = pairs.where("u <> v").select(F.least("u", "v").cast("long").alias("src"), F.greatest("u", "v").cast("long").alias("dst"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w"))
    return ends.groupBy("src", "dst").agg((F.sum("w") if weight else F.first("w")).alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.expr("stack(2, src, dst, w, dst, src, w) AS (src, dst, w)"))


def vertices(edges: DataFrame) -> DataFrame:
    """id and degree (weighted) of each vertex that has an edge."""
    return adjacency(edges).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def supply_graph(spark: SparkSession, sf_dir: str, least: int = 1, ranged: bool = False) -> DataFrame:
    """Suppliers and parts, joined by the number of lines that sell the part from the supplier, if that is at least least. ranged: edges of near ids lie together."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_BASE).alias("dst"))
    lines = lines.repartitionByRange("src", "dst") if ranged else lines
    return lines.groupBy("src", "dst").agg(F.count("*").alias("w")).where(F.col("w") >= least)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, k and line, without comments: at is where the line's block begins in its file, k rises inside a block. Lines are read apart, however large the file."""
    at = F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "\\r$", "").alias("line"))
    return rows.where(~F.col("line").startswith("%"))


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines that are at hand, as of standard input, in the shape of read_lines."""
    rows = [("", 0, k, x.rstrip("\r\n")) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, at long, k long, line string").where(~F.col("line").startswith("%"))


def numbered(lines: DataFrame) -> DataFrame:
    """n, from 0 in the order of each file, and line. Lines are counted by block first, so no task has a whole file."""
    counts = lines.groupBy("file", "at").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    rows = lines.join(counts.select("file", "at", F.coalesce(before, F.lit(0)).alias("_before")), ["file", "at"])
    return rows.select("file", (F.col("_before") + F.row_number().over(W.partitionBy("file", "at").orderBy("k")) - 1).alias("n"), "line")


def _body(lines: DataFrame) -> DataFrame:
    """The lines behind each file's first."""
    header = lines.groupBy("file").agg(F.min(F.struct("at", "k")).alias("_head"))
    return lines.join(header, "file").where(F.struct("at", "k") > F.col("_head")).drop("_head")


def parse_mtx(lines: DataFrame) -> DataFrame:
    """Matrix-Market edges: the first line that is no comment is the header, values are ignored, ids become 0-based."""
    fields = _body(lines.where(F.trim("line") != "")).select(F.split(F.trim("line"), "\\s+").alias("f"))
    return canonical(fields.select((F.col("f")[0].cast("long") - 1).alias("u"), (F.col("f")[1].cast("long") - 1).alias("v")))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    return parse_mtx(read_lines(spark, path))


def parse_chaco(lines: DataFrame) -> DataFrame:
    """Directed adjacency (src, dst, w) as the file has it: line i lists the neighbours of vertex i; blank lines are isolated vertices."""
    rows = numbered(_body(lines))
    near = rows.select("n", F.explode(F.filter(F.split("line", "\\s+"), lambda x: x != "")).alias("dst"))
    return near.select(F.col("n").cast("long").alias("src"), (F.col("dst").cast("long") - 1).alias("dst"), F.lit(1).cast("long").alias("w"))


def read_chaco(spark: SparkSession, path: str) -> DataFrame:
    return parse_chaco(read_lines(spark, path))


def from_rows(rows: DataFrame) -> DataFrame:
    """Edges of adjacency rows (src, neighbours array, and weights array if there is one), each edge in both of its ends' rows or in one."""
    if "weights" in rows.columns:
        pairs = rows.select("src", F.explode(F.arrays_zip("neighbours", "weights")).alias("e")).select("src", F.col("e.neighbours").alias("dst"), F.col("e.weights").alias("w"))
    else:
        pairs = rows.select("src", F.explode("neighbours").alias("dst"), F.lit(1).alias("w"))
    ends = pairs.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), F.col("w").cast("long").alias("w"))
    return ends.groupBy("src", "dst").agg(F.max("w").alias("w"))


def to_rows(edges: DataFrame) -> DataFrame:
    """Adjacency rows: src, its neighbours in order and the weights beside them."""
    near = adjacency(edges).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("e"))
    return near.select("src", F.transform("e", lambda x: x["dst"]).alias("neighbours"), F.transform("e", lambda x: x["w"]).alias("weights"))


def extended(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The graph with further edges (u, v, w), weights of the same pair summed."""
    return canonical(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").unionByName(more.select("u", "v", "w")), "w")


def mtx_lines(edges: DataFrame, n: int) -> DataFrame:
    """a, b and value: the header, then a line for each direction, in the order of (a, b)."""
    both = adjacency(edges).select("src", "dst")
    rows = both.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value"))
    head = both.agg(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.concat_ws(" ", F.lit(n), F.lit(n), F.count("*")).alias("value"))
    return rows.unionByName(head)


def chaco_lines(edges: DataFrame, n: int) -> DataFrame:
    """id and value: the header (-1), then each vertex's neighbours, in the order of ids."""
    near = adjacency(edges).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.col("dst") + 1)), " ").alias("value"))
    rows = edges.sparkSession.range(n).join(near, F.col("id") == F.col("src"), "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    head = edges.agg(F.lit(-1).cast("long").alias("id"), F.concat_ws(" ", F.lit(n), F.count("*")).alias("value"))
    return rows.unionByName(head)


def edge_list_lines(edges: DataFrame, n: int, one_indexed: bool = False) -> DataFrame:
    """a, b and value: a header n m, then each edge once."""
    add = int(one_indexed)
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src") + add, F.col("dst") + add).alias("value"))
    head = edges.agg(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.concat_ws(" ", F.lit(n), F.count("*")).alias("value"))
    return rows.unionByName(head)


def discover(spark: SparkSession, folder: str, pattern: str = "*.{mtx,chaco}", without: tuple[str, ...] = ("_coord", "_area", "_population", "_Gcoord", "_b.")) -> DataFrame:
    """path and length of the graph files below a folder, but for those whose names hold one of without."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    for word in without:
        found = found.where(~F.contains(name, F.lit(word)))
    return found


def small_square(catalogue: DataFrame, limit: int = 200_000) -> DataFrame:
    """Rows of a catalogue (rows, cols, nnz) of square matrices with limit entries at most."""
    return catalogue.where((F.col("rows") == F.col("cols")) & (F.col("nnz") <= limit))


def mtx_to_chaco(spark: SparkSession, source: str, n: int, path: str) -> None:
    write_chaco(read_mtx(spark, source), n, path)


def write_mtx(edges: DataFrame, n: int, path: str) -> None:
    """Header n n volume, then both directions, 1-based, in order."""
    mtx_lines(edges, n).orderBy("a", "b").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_chaco(edges: DataFrame, n: int, path: str) -> None:
    """Header n m, then each vertex's neighbours, 1-based; isolated vertices have blank lines."""
    chaco_lines(edges, n).orderBy("id").select("value").coalesce(1).write.mode("overwrite").text(path)


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """n x n points with edges to the right, down and along the diagonal."""
    at = spark.range(n * n).select((F.col("id") / n).cast("long").alias("r"), (F.col("id") % n).alias("c"))
    ends = at.select("r", "c", F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (1, 1))])).alias("d"))
    inside = ends.where((F.col("r") + F.col("d.dr") < n) & (F.col("c") + F.col("d.dc") < n))
    return inside.select((F.col("r") * n + F.col("c")).alias("src"), ((F.col("r") + F.col("d.dr")) * n + F.col("c") + F.col("d.dc")).alias("dst"), F.lit(1).cast("long").alias("w"))


def cliques(spark: SparkSession, n: int, k: int, path: bool = False) -> DataFrame:
    """k cliques of n vertices; path: each clique's last vertex is joined to the next one's first."""
    inside = spark.range(k * n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o")).select("src", ((F.col("src") / n).cast("long") * n + F.col("o")).alias("dst")).where("src < dst")
    if path:
        inside = inside.union(spark.range(k - 1).select((F.col("id") * n + n - 1).alias("src"), (F.col("id") * n + n).alias("dst")))
    return inside.select("src", "dst", F.lit(1).cast("long").alias("w"))


def fur(spark: SparkSession, n: int) -> DataFrame:
    """A clique of n vertices, each with a pendant."""
    return cliques(spark, n, 1).union(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"), F.lit(1).cast("long").alias("w")))


def margulis(spark: SparkSession, n: int) -> DataFrame:
    """The expander on pairs modulo n: (a, b) is joined to (a, a + b), (a, b - a), (a + b, b), (a - b, b), and to its four neighbours by one."""
    p = spark.range(n * n).select("id", (F.col("id") / n).cast("long").alias("a"), (F.col("id") % n).alias("b"))
    moves = ["a, a + b", "a, b - a", "a + b, b", "a - b, b", "a + 1, b", "a - 1, b", "a, b + 1", "a, b - 1"]
    to = F.array(*[F.expr(f"pmod({m.split(', ')[0]}, {n}) * {n} + pmod({m.split(', ')[1]}, {n})") for m in moves])
    return canonical(p.select(F.col("id").alias("u"), F.explode(to).alias("v")))


def furred(edges: DataFrame, n: int) -> DataFrame:
    """The graph on vertices 0 to n - 1, with a pendant n + v for each vertex v."""
    pendants = edges.sparkSession.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"), F.lit(1).cast("long").alias("w"))
    return edges.unionByName(pendants)


def _cycle(spark: SparkSession, n: int, seed: int, block: int = 65536) -> DataFrame:
    """Edges (u, v) of the cycle through all vertices in the order of their hashes.

    Blocks of the order are made by ranges of the hash, so each is sorted by itself; a block's last vertex leads to the next one's first.
    """
    blocks = max(1, n // block)
    drawn = spark.range(n).select("id", F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("b", F.floor((F.col("h") / 2.0**64 + 0.5) * blocks))
    inner = drawn.select(F.col("id").alias("u"), F.lead("id").over(W.partitionBy("b").orderBy("h", "id")).alias("v")).where("v IS NOT NULL")
    ends = drawn.groupBy("b").agg(F.min(F.struct("h", "id")).alias("first"), F.max(F.struct("h", "id")).alias("last"))
    order = W.partitionBy(F.lit(0)).orderBy("b")  # a row a block
    after = F.coalesce(F.lead("first.id").over(order), F.first("first.id").over(order))
    return inner.unionByName(ends.select(F.col("last.id").alias("u"), after.alias("v")))


def random_regular(spark: SparkSession, n: int, seed: int = 1, tries: int = 1000) -> DataFrame:
    """floor(floor(ln n) / 2) + 1 random cycles through all n vertices that share no edge."""
    cycles, found = int(math.log(n)) // 2 + 1, None
    for k in range(cycles):
        for attempt in range(tries):
            one = canonical(_cycle(spark, n, (seed * cycles + k) * tries + attempt))
            both = one if found is None else found.unionByName(one).distinct()
            if both.count() == (k + 1) * n:
                found = both
                break
        else:
            raise ValueError(f"no {cycles} cycles without a common edge found on {n} vertices")
    return found


def random_sparse(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Each vertex draws half of ceil(ln n) others, all at once, so that degrees are about ln n; draws of one pair are one edge."""
    draws = math.ceil(math.ceil(math.log(n)) / 2)
    to = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k")
    drawn = spark.range(n).select(F.col("id").alias("u"), to).select("u", F.pmod(F.col("u") + 1 + F.pmod(F.xxhash64("u", "k", F.lit(seed)), F.lit(n - 1)), F.lit(n)).alias("v"))
    return canonical(drawn)


#: Drawn numbers are below this.
DRAWN = 1_000_003


def draw(a: Column, b: Column, seed: int = 1) -> Column:
    """A number from 0 to below DRAWN, the same in any engine."""
    return F.pmod(a * 7919 + b * 104729 + seed * 1299709 + (a % 1009) * (b % 997), F.lit(DRAWN))


def random_cliques(spark: SparkSession, n: int, k: int, percent: int = 100, links: int = 0, seed: int = 1) -> DataFrame:
    """k cliques of n vertices that keep each edge with a probability of percent, and links random edges between different cliques."""
    kept = cliques(spark, n, k).where(draw(F.col("src"), F.col("dst"), seed) * 100 < percent * DRAWN)
    return _linked(spark, kept, n, k, links, seed)


def _linked(spark: SparkSession, edges: DataFrame, n: int, k: int, links: int, seed: int) -> DataFrame:
    """The edges of k parts of n vertices, and links more between vertices that are drawn in different parts."""
    if not links or k < 2:
        return edges
    i = F.col("id")
    part = (draw(i, i * 0 + 1, seed) % k).alias("p")
    drawn = spark.range(links).select(part, (draw(i, i * 0 + 2, seed) % (k - 1)).alias("q"), (draw(i, i * 0 + 3, seed) % n).alias("x"), (draw(i, i * 0 + 4, seed) % n).alias("y"))
    other = F.when(F.col("q") >= F.col("p"), F.col("q") + 1).otherwise(F.col("q"))
    more = canonical(drawn.select((F.col("p") * n + F.col("x")).alias("u"), (other * n + F.col("y")).alias("v")))
    return edges.unionByName(more)


def margulis_parts(spark: SparkSession, n: int, k: int, links: int = 0, seed: int = 1) -> DataFrame:
    """k expanders on n * n vertices each, and links random edges between different ones."""
    one = margulis(spark, n)
    shift = spark.range(k).select((F.col("id") * n * n).alias("_at"))
    parts = one.crossJoin(F.broadcast(shift)).select((F.col("src") + F.col("_at")).alias("src"), (F.col("dst") + F.col("_at")).alias("dst"), "w")
    return _linked(spark, parts, n * n, k, links, seed)
