"""Queries on single operators: readers and writers, accessors, moves, walks, searches, generators, reports; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cuts, flow, traverse, walks
from .plans import experiments
from .queries import _E, _G, _S, _X, _A, _V, _edges, _l, _labels, _SWEEP, _values
from .sources import files, graphs

N = 20


def _text(rows, at, k):
    """Lines in the shape that readers give."""
    return rows.select(F.lit("").alias("file"), F.col(at).cast("long").alias("at"), F.col(k).cast("long").alias("k"), F.col("value").alias("line"))


def s1_mtx(spark, d):
    """Written as Matrix-Market lines and read back; weights are lost."""
    e = _edges(spark, d)
    return graphs.parse_mtx(_text(graphs.mtx_lines(e, 0), "a", "b"))


def k1_mtx_lines(spark, d):
    return graphs.mtx_lines(_edges(spark, d), 9).select("value")


def s4_chaco(spark, d):
    e = graphs.lattice(spark, N)
    return graphs.parse_chaco(_text(graphs.chaco_lines(e, N * N).withColumn("k", F.lit(0)), "id", "k"))


def k2_chaco_lines(spark, d):
    return graphs.chaco_lines(graphs.lattice(spark, N), N * N).select("id", "value")


def g9_edge_list_lines(spark, d):
    return graphs.edge_list_lines(graphs.lattice(spark, N), N * N).select("value")


def s2_lines_at_hand(spark, d):
    return graphs.parse_mtx(graphs.lines_of(spark, ["%%MatrixMarket", "% c", "4 4 5", "1 2 0.5", "2 1", "% mid", "3 3", "2 3 ", "4 1"]))


def _partition(spark):
    rows = spark.range(N * N).select(F.col("id").alias("at"), F.lit(0).alias("k"), (F.col("id") * F.col("id") % 7).cast("string").alias("value"))
    return files.parse_partition(_text(rows, "at", "k"))


def s6_partition(spark, d):
    return _partition(spark)


def s7_partition_of_graph(spark, d):
    return files.labels_of(graphs.vertices(graphs.cliques(spark, 25, 20)), _partition(spark))


def a16_parts(spark, d):
    return files.parts_of(_partition(spark))


def s12_small_square(spark, d):
    """Of parts as a catalogue: rows and columns from the size, entries from the key."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("nnz"), F.col("p_size").cast("long").alias("rows"), (F.col("p_partkey") % 50 + 1).cast("long").alias("cols"))
    return graphs.small_square(parts, 1000)


def p2_rows(spark, d):
    """Adjacency rows and back, with weights."""
    return graphs.from_rows(graphs.to_rows(_edges(spark, d)))


def p4_adjacency_rows(spark, d):
    rows = graphs.to_rows(_edges(spark, d))
    return rows.select("src", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"), F.array_join(F.col("weights").cast("array<string>"), ",").alias("weights"))


def p5_extended(spark, d):
    """The graph with the edges at the first ten suppliers once more."""
    e = _edges(spark, d)
    return graphs.extended(e, e.where("src <= 10").select(F.col("dst").alias("u"), F.col("src").alias("v"), "w"))


def p7_accessors(spark, d):
    e = _edges(spark, d)
    return cuts.accessors(e, _labels(e, 8))


def c19_totals(spark, d):
    e = _edges(spark, d)
    return cuts.totals(e, _labels(e, 8)).select("volume", "cut_edges", F.round("edge_ratio", 9).alias("edge_ratio"), "components", F.round("node_ratio", 9).alias("node_ratio"))


def c17_vertex_weights(spark, d):
    e = _edges(spark, d)
    return cuts.contracted_vertices(e, _labels(e, 50))


def a6_sparsity(spark, d):
    e = _edges(spark, d)
    return cuts.objective(cuts.part_stats(e, _labels(e, 2)), "sparsity")


def a5_empty_parts(spark, d):
    e = _edges(spark, d)
    return cuts.with_empty_parts(cuts.part_stats(e, _labels(e, 8)), 10)


def a7_set_cuts(spark, d):
    e = _edges(spark, d)
    return cuts.set_cuts(e, graphs.vertices(e).select((F.col("id") % 9).alias("sample"), "id").where("sample < 4"))


def j11_complement(spark, d):
    v = graphs.vertices(_edges(spark, d))
    return cuts.complement(v, v.select((F.col("id") % 9).alias("sample"), "id").where("sample < 2"))


def c11_moved(spark, d):
    e = _edges(spark, d)
    v = graphs.vertices(e)
    return cuts.moved(_labels(e, 8), v.where("id % 11 = 3").select("id"), 99)


def c12_reset(spark, d):
    return cuts.reset(_labels(_edges(spark, d), 8))


def r6_after_move(spark, d):
    e = _edges(spark, d)
    return cuts.after_move(e, _labels(e, 8), graphs.vertices(e).where("id % 11 = 3").select("id"), 5)


def r9_gain_to(spark, d):
    e = _edges(spark, d)
    return cuts.gain_to(e, _labels(e, 8), 3)


def c3_three_steps(spark, d):
    e = _edges(spark, d)
    v = _values(e)
    return walks.walk(walks.active(e, v.select("id", "comp")), v, 3).select("id", F.round("x", 6).alias("x"))


def c4_recentred(spark, d):
    return walks.recentred(_values(_edges(spark, d))).select("id", "comp", F.round("x", 6).alias("x"))


def c7_boosted_cuts(spark, d):
    e = _edges(spark, d)
    return walks.best_cuts(walks.sweep(e, _values(e), boost=4.0)).select("comp", F.col("rank").cast("long").alias("rank"), F.round("sparsity", 9).alias("sparsity"), "size")


def c8_balanced_cuts(spark, d):
    e = _edges(spark, d)
    return walks.balanced_cuts(walks.sweep(e, _values(e)), 100.0).select("comp", F.col("rank").cast("long").alias("rank"), F.round("sparsity", 9).alias("sparsity"), "size")


def c9_sides(spark, d):
    e = _edges(spark, d)
    swept = walks.sweep(e, _values(e))
    return walks.sides(swept, walks.best_cuts(swept)).select("id", "comp", F.col("side").cast("long").alias("side"))


def t6_bfs_tree(spark, d):
    e = _edges(spark, d)
    return traverse.bfs_tree(e, e.agg(F.min("src").alias("id"))).select("id", F.col("level").cast("long").alias("level"), "parent")


def t3_connected(spark, d):
    e = graphs.cliques(spark, 7, 30)
    return traverse.connected(e, spark.range(200).select(F.col("id").alias("s"), (F.col("id") + 5).alias("t")))


def t5_residual_levels(spark, d):
    """Arcs from suppliers to parts have their weight as capacity; flow fills those of every other pair, and makes arcs back."""
    e = _edges(spark, d)
    full = (F.col("src") + F.col("dst")) % 2 == 0
    there = e.select("src", "dst", F.col("w").alias("capacity"), F.when(full, F.col("w")).otherwise(0).alias("flow"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("capacity"), F.when(full, -F.col("w")).otherwise(0).alias("flow"))
    return traverse.residual_levels(there.unionByName(back), e.agg(F.min("src").alias("id"))).select("id", F.col("level").cast("long").alias("level"))


def p12_terminals(spark, d):
    e = _edges(spark, d)
    v = graphs.vertices(e)
    return flow.with_terminals(e, v.where("id % 97 = 1").select("id"), v.where("id % 97 = 2").select("id"))


def p13_without_terminals(spark, d):
    e = _edges(spark, d)
    return flow.without_terminals(flow.with_terminals(e, e.agg(F.min("src").alias("id")), e.agg(F.max("dst").alias("id"))))


def p9_capacities(spark, d):
    return flow.capacities(graphs.fur(spark, 60), 60)


def g5_random_cliques(spark, d):
    return graphs.random_cliques(spark, 20, 12, 60, 40)


def g8_margulis_parts(spark, d):
    return graphs.margulis_parts(spark, 12, 4, 30)


def g14_converted(spark, d):
    """Matrix-Market lines of a lattice, read and written as Chaco lines."""
    read = graphs.parse_mtx(_text(graphs.mtx_lines(graphs.lattice(spark, N), N * N), "a", "b"))
    return graphs.chaco_lines(read, N * N).select("id", "value")


def g16_threshold_grid(spark, d):
    return experiments.threshold_grid(spark, 2).select(F.round(F.log10("potential")).cast("long").alias("power"), *[F.col(c).cast("long").alias(c) for c in ("attempt", "timeout")])


def g17_quality_grid(spark, d):
    return experiments.quality_grid(spark, 2).select("phi", *[F.col(c).cast("long").alias(c) for c in ("attempt", "timeout")])


def g15_benchmark_grid(spark, d):
    return experiments.benchmark_grid(spark, 3).select(*[F.col(c).cast("long").alias(c) for c in ("seed", "parts", "timeout")], "phi")


def g20_squares(spark, d):
    return spark.range(50).select("id", F.pow("id", F.lit(2)).cast("long").alias("square"))


def k6_decomposition_row(spark, d):
    e = _edges(spark, d)
    return experiments.decomposition_row(e, _labels(e, 8), "supply", 0.1, 1e-4, 5).select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in ("Graph Name", "Phi", "Time")], F.round("`Edge Ratio`", 9).alias("edge_ratio"), F.round("`Node Ratio`", 9).alias("node_ratio"))


def k7_comparison_row(spark, d):
    e = _edges(spark, d)
    row = experiments.comparison_row(e, _labels(e, 8), experiments.Evaluation("supply", "modulo", 1.5))
    return row.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in ("Graph Name", "Experiment Type", "Parts", "Time")], F.round("Value", 9).alias("value"))


def k9_statistics_row(spark, d):
    row = experiments.statistics_row(_edges(spark, d), "supply")
    return row.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in row.columns])


QUERIES = {f.__name__: f for f in (s1_mtx, k1_mtx_lines, s4_chaco, k2_chaco_lines, g9_edge_list_lines, s2_lines_at_hand, s6_partition, s7_partition_of_graph, a16_parts, s12_small_square, p2_rows, p4_adjacency_rows, p5_extended, p7_accessors, c19_totals, c17_vertex_weights, a6_sparsity, a5_empty_parts, a7_set_cuts, j11_complement, c11_moved, c12_reset, r6_after_move, r9_gain_to, c3_three_steps, c4_recentred, c7_boosted_cuts, c8_balanced_cuts, c9_sides, t6_bfs_tree, t3_connected, t5_residual_levels, p12_terminals, p13_without_terminals, p9_capacities, g5_random_cliques, g8_margulis_parts, g14_converted, g16_threshold_grid, g17_quality_grid, g15_benchmark_grid, g20_squares, k6_decomposition_row, k7_comparison_row, k9_statistics_row)}

_LATTICE = f"le AS (SELECT CAST(id AS BIGINT) AS src, CAST(id + dr * {N} + dc AS BIGINT) AS dst FROM (SELECT range AS id, range // {N} AS r, range % {N} AS c FROM range({N * N})), (VALUES (0, 1), (1, 0), (1, 1)) m(dr, dc) WHERE r + dr < {N} AND c + dc < {N}), la AS (SELECT src, dst FROM le UNION ALL SELECT dst, src FROM le)"
_CHACO = f"WITH {_LATTICE} SELECT CAST(-1 AS BIGINT) AS id, '{N * N} ' || count(*) AS value FROM le UNION ALL SELECT CAST(range AS BIGINT), coalesce((SELECT string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst) FROM la WHERE src = range), '') FROM range({N * N})"
_M = "(l.id % 11 = 3)"


def _draw(a: str, b: str, seed: int = 1) -> str:
    return f"(({a} * 7919 + {b} * 104729 + {seed * 1299709} + ({a} % 1009) * ({b} % 997)) % {graphs.DRAWN})"


def _linked(n: int, k: int, links: int) -> str:
    p, q = f"{_draw('range', '1')} % {k}", f"{_draw('range', '2')} % {k - 1}"
    return f"dr AS (SELECT {p} AS p, {q} AS q, {_draw('range', '3')} % {n} AS x, {_draw('range', '4')} % {n} AS y FROM range({links})), lk AS (SELECT p * {n} + x AS u, (CASE WHEN q >= p THEN q + 1 ELSE q END) * {n} + y AS v FROM dr), ll AS (SELECT DISTINCT CAST(least(u, v) AS BIGINT) AS src, CAST(greatest(u, v) AS BIGINT) AS dst FROM lk)"


_MARG = "pp AS (SELECT range AS u, range // 12 AS a, range % 12 AS b FROM range(144)), qq AS (SELECT u, a AS x, a + b AS y FROM pp UNION ALL SELECT u, a, b - a + 12 FROM pp UNION ALL SELECT u, a + b, b FROM pp UNION ALL SELECT u, a - b + 12, b FROM pp UNION ALL SELECT u, a + 1, b FROM pp UNION ALL SELECT u, a + 11, b FROM pp UNION ALL SELECT u, a, b + 1 FROM pp UNION ALL SELECT u, a, b + 11 FROM pp), rr AS (SELECT u, (x % 12) * 12 + y % 12 AS v FROM qq), mm AS (SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM rr WHERE u <> v)"
_BOOST = _SWEEP.replace("degree) OVER", "boosted) OVER").replace("r AS (SELECT *", "bo AS (SELECT a.src AS id, CAST(sum(CASE WHEN a.src % 3 = a.dst % 3 THEN w ELSE 4 * w END) AS BIGINT) AS boosted FROM a GROUP BY 1), r AS (SELECT x.*, boosted").replace("ORDER BY x, id) AS rank FROM x)", "ORDER BY x.x, x.id) AS rank FROM x JOIN bo ON x.id = bo.id)")
_RATED = "t AS (SELECT comp, rank, size, cut / least(vol, whole - vol) AS sparsity FROM sw WHERE rank < size AND least(vol, whole - vol) > 0), o AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY sparsity, rank) AS n FROM t)"


def _step(k: int) -> str:
    return f"i{k} AS (SELECT c.src, sum(w * x) / sum(w) AS inflow FROM c JOIN x{k} ON c.dst = x{k}.id GROUP BY c.src), x{k + 1} AS (SELECT id, CASE WHEN inflow IS NULL THEN x ELSE 0.1 * x + 0.9 * inflow END AS x FROM x{k} LEFT JOIN i{k} ON x{k}.id = i{k}.src)"


_MIN = "(SELECT min(src) FROM e)"
ORACLE_SQL = {
    "s1_mtx": f"WITH {_E} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e",
    "k1_mtx_lines": f"WITH {_E}, {_A} SELECT (src + 1) || ' ' || (dst + 1) AS value FROM a UNION ALL SELECT '9 9 ' || count(*) FROM a",
    "s4_chaco": f"WITH {_LATTICE} SELECT src, dst, CAST(1 AS BIGINT) AS w FROM la",
    "k2_chaco_lines": _CHACO,
    "g9_edge_list_lines": f"WITH {_LATTICE} SELECT src || ' ' || dst AS value FROM le UNION ALL SELECT '{N * N} ' || count(*) FROM le",
    "s2_lines_at_hand": "SELECT CAST(u AS BIGINT) AS src, CAST(v AS BIGINT) AS dst, CAST(1 AS BIGINT) AS w FROM (VALUES (0, 1), (1, 2), (0, 3)) x(u, v)",
    "s6_partition": f"SELECT CAST(range AS BIGINT) AS id, CAST(range * range % 7 AS BIGINT) AS part FROM range({N * N})",
    "s7_partition_of_graph": f"SELECT CAST(range AS BIGINT) AS id, CASE WHEN range < {N * N} THEN CAST(range * range % 7 AS BIGINT) END AS part FROM range(500)",
    "a16_parts": f"SELECT CAST(max(range * range % 7) + 1 AS BIGINT) AS parts FROM range({N * N})",
    "s12_small_square": "SELECT CAST(p_partkey AS BIGINT) AS nnz, CAST(p_size AS BIGINT) AS rows, CAST(p_partkey % 50 + 1 AS BIGINT) AS cols FROM part WHERE p_size = p_partkey % 50 + 1 AND p_partkey <= 1000",
    "p2_rows": f"WITH {_E} SELECT * FROM e",
    "p4_adjacency_rows": f"WITH {_E}, {_A} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours, string_agg(CAST(w AS VARCHAR), ',' ORDER BY dst) AS weights FROM a GROUP BY src",
    "p5_extended": f"WITH {_E} SELECT src, dst, CASE WHEN src <= 10 THEN 2 * w ELSE w END AS w FROM e",
    "p7_accessors": f"WITH {_E}, {_A}, {_V}, {_l(8)}, x AS (SELECT src AS id, ps AS part, count(*) AS neighbours, count(*) FILTER (WHERE ps = pd) AS active, CAST(sum(w) AS BIGINT) AS initial_degree, CAST(sum(CASE WHEN ps = pd THEN w ELSE 0 END) AS BIGINT) AS degree FROM b GROUP BY 1, 2) SELECT *, initial_degree - degree AS cut_edges, CAST(sum(initial_degree) OVER (PARTITION BY part) AS BIGINT) AS component_volume FROM x",
    "c19_totals": f"WITH {_E}, {_A}, {_V}, {_l(8)}, x AS (SELECT CAST(sum(w) AS BIGINT) AS volume, CAST(sum(CASE WHEN ps <> pd THEN w ELSE 0 END) // 2 AS BIGINT) AS cut_edges FROM b) SELECT volume, cut_edges, round(2 * cut_edges / volume, 9) AS edge_ratio, (SELECT count(DISTINCT part) FROM l) AS components, round((SELECT count(DISTINCT part) / count(*) FROM l), 9) AS node_ratio FROM x",
    "c17_vertex_weights": f"WITH {_E}, {_A}, {_V} SELECT id % 50 AS id, CAST(sum(degree) AS BIGINT) AS vertex_weight FROM v GROUP BY 1",
    "a6_sparsity": f"WITH {_E}, {_A}, {_V}, {_l(2)}, {_S} SELECT sum(cut) / 2 / min(size) AS value FROM st",
    "a5_empty_parts": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_S} SELECT CAST(range AS BIGINT) AS part, coalesce(size, 0) AS size, coalesce(volume, 0) AS volume, coalesce(cut, 0) AS cut FROM range(10) LEFT JOIN st ON part = range",
    "a7_set_cuts": f"WITH {_E}, {_A} SELECT src % 9 AS sample, CAST(sum(CASE WHEN src % 9 <> dst % 9 THEN w ELSE 0 END) AS BIGINT) AS cut FROM a WHERE src % 9 < 4 GROUP BY 1",
    "j11_complement": f"WITH {_E}, {_A}, {_V} SELECT CAST(s AS BIGINT) AS sample, id FROM v, (VALUES (0), (1)) x(s) WHERE id % 9 <> s",
    "c11_moved": f"WITH {_E}, {_A}, {_V} SELECT id, CAST(CASE WHEN {_M} THEN 99 ELSE id % 8 END AS BIGINT) AS part FROM v l",
    "c12_reset": f"WITH {_E}, {_A}, {_V} SELECT id, CAST(0 AS BIGINT) AS part FROM v",
    "r6_after_move": f"WITH {_E}, {_A}, {_V}, l AS (SELECT id, CASE WHEN id % 11 = 3 THEN 5 ELSE id % 8 END AS part FROM v), b AS (SELECT a.*, x.part AS ps, y.part AS pd FROM a JOIN l x ON x.id = a.src JOIN l y ON y.id = a.dst), {_S} SELECT CAST(part AS BIGINT) AS part, size, volume, cut FROM st",
    "r9_gain_to": f"WITH {_E}, {_A}, {_V}, {_l(8)} SELECT src AS id, CAST(sum(CASE WHEN pd = 3 THEN w ELSE 0 END) - sum(CASE WHEN pd = ps THEN w ELSE 0 END) AS BIGINT) AS gain FROM b GROUP BY src",
    "c3_three_steps": f"WITH {_E}, {_A}, {_V}, {_X}, c AS (SELECT * FROM a WHERE src % 3 = dst % 3), x0 AS (SELECT id, x FROM x), {_step(0)}, {_step(1)}, {_step(2)} SELECT id, round(x, 6) AS x FROM x3",
    "c4_recentred": f"WITH {_E}, {_A}, {_V}, {_X} SELECT id, comp, round(x - avg(x) OVER (PARTITION BY comp), 6) AS x FROM x",
    "c7_boosted_cuts": f"{_BOOST}, {_RATED} SELECT comp, rank, round(CAST(sparsity AS DOUBLE), 9) AS sparsity, size FROM o WHERE n = 1",
    "c8_balanced_cuts": f"{_SWEEP}, {_RATED}, m AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY sparsity, rank) AS k FROM t WHERE rank - 1 BETWEEN size // 4 AND size // 2 + size // 4), z AS (SELECT o.comp, o.size, CASE WHEN (o.rank - 1 < o.size // 4 OR o.rank - 1 > o.size // 2 + o.size // 4) AND m.sparsity < 100 THEN m.rank ELSE o.rank END AS rank FROM o LEFT JOIN m ON m.comp = o.comp AND m.k = 1 WHERE o.n = 1) SELECT z.comp, z.rank, round(CAST(t.sparsity AS DOUBLE), 9) AS sparsity, z.size FROM z JOIN t ON t.comp = z.comp AND t.rank = z.rank",
    "c9_sides": f"{_SWEEP}, {_RATED} SELECT sw.id, sw.comp, CAST(CASE WHEN sw.rank <= o.rank THEN 1 ELSE 0 END AS BIGINT) AS side FROM sw LEFT JOIN o ON o.comp = sw.comp AND o.n = 1",
    "t6_bfs_tree": f"WITH RECURSIVE {_E}, {_A}, r AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS level FROM e UNION SELECT a.dst, level + 1 FROM r JOIN a ON a.src = r.id WHERE level < 12), m AS (SELECT id, min(level) AS level FROM r GROUP BY id) SELECT m.id, m.level, min(u.id) AS parent FROM m LEFT JOIN a ON a.src = m.id LEFT JOIN m u ON u.id = a.dst AND u.level = m.level - 1 GROUP BY 1, 2",
    "t3_connected": "SELECT CAST(range AS BIGINT) AS s, CAST(range + 5 AS BIGINT) AS t, range // 7 = (range + 5) // 7 AS connected FROM range(200)",
    "t5_residual_levels": f"WITH RECURSIVE {_E}, f AS (SELECT src, dst FROM e WHERE (src + dst) % 2 <> 0 UNION ALL SELECT dst, src FROM e WHERE (src + dst) % 2 = 0), r AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS level FROM e UNION SELECT f.dst, level + 1 FROM r JOIN f ON f.src = r.id WHERE level < 14) SELECT id, min(level) AS level FROM r GROUP BY id",
    "p12_terminals": f"WITH {_E}, {_A}, {_V} SELECT * FROM e UNION ALL SELECT CAST(-1 AS BIGINT), id, degree FROM v WHERE id % 97 = 1 UNION ALL SELECT CAST(-2 AS BIGINT), id, degree FROM v WHERE id % 97 = 2",
    "p13_without_terminals": f"WITH {_E} SELECT * FROM e",
    "p9_capacities": "SELECT a.range AS src, b.range AS dst, CAST(CASE WHEN b.range >= 60 THEN 1000 ELSE 1 END AS BIGINT) AS w FROM range(60) a, range(120) b WHERE (a.range < b.range AND b.range < 60) OR b.range = a.range + 60",
    "g5_random_cliques": f"WITH {_linked(20, 12, 40)} SELECT a.range AS src, b.range AS dst, CAST(1 AS BIGINT) AS w FROM range(240) a, range(240) b WHERE a.range < b.range AND a.range // 20 = b.range // 20 AND {_draw('a.range', 'b.range')} * 100 < 60 * {graphs.DRAWN} UNION ALL SELECT src, dst, 1 FROM ll",
    "g8_margulis_parts": f"WITH {_MARG}, {_linked(144, 4, 30)} SELECT src + 144 * range AS src, dst + 144 * range AS dst, CAST(1 AS BIGINT) AS w FROM mm, range(4) UNION ALL SELECT src, dst, 1 FROM ll",
    "g14_converted": _CHACO,
    "g16_threshold_grid": "SELECT CAST(2 - a.range AS BIGINT) AS power, b.range AS attempt, CAST(1200 AS BIGINT) AS timeout FROM range(12) a, range(2) b",
    "g17_quality_grid": "SELECT CAST(phi AS DOUBLE) AS phi, range AS attempt, CAST(300 AS BIGINT) AS timeout FROM (VALUES (0.4), (0.3), (0.2), (0.1), (0.05), (0.025), (0.01)) x(phi), range(2)",
    "g15_benchmark_grid": "SELECT range AS seed, CAST(0 AS DOUBLE) AS phi, CAST(parts AS BIGINT) AS parts, CAST(1200 AS BIGINT) AS timeout FROM range(1, 4), (VALUES (2), (4), (8), (16), (32), (64), (128)) x(parts)",
    "g20_squares": "SELECT range AS id, CAST(range * range AS BIGINT) AS square FROM range(50)",
    "k6_decomposition_row": f"WITH {_E}, {_A}, {_V}, {_l(8)} SELECT 'supply' AS graph_name, CAST(0.1 AS DOUBLE) AS phi, CAST(5 AS INTEGER) AS time, round(sum(CASE WHEN ps <> pd THEN w ELSE 0 END) / sum(w), 9) AS edge_ratio, round((SELECT count(DISTINCT part) / count(*) FROM l), 9) AS node_ratio FROM b",
    "k7_comparison_row": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_S} SELECT 'supply' AS graph_name, 'modulo' AS experiment_type, CAST(max(part) + 1 AS BIGINT) AS parts, CAST(1.5 AS DOUBLE) AS time, round(sum(cut / volume), 9) AS value FROM st",
    "k9_statistics_row": f"WITH {_E}, {_A}, d AS (SELECT src, count(*) AS d FROM a GROUP BY src) SELECT 'supply' AS graph_name, count(*) AS vertices, CAST(sum(d) / 2 AS BIGINT) AS edges, max(d) AS max_degree, round(avg(d), 2) AS avg_degree, CAST(floor(quantile_cont(d, 0.25)) AS BIGINT) AS \"25th\", CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS \"50th\", CAST(floor(quantile_cont(d, 0.75)) AS BIGINT) AS \"75th\", CAST(floor(quantile_cont(d, 0.9)) AS BIGINT) AS \"90th\", stddev_pop(d) AS std FROM d",
}
