"""One query an operator, on graphs made of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cuts, samples, traverse, walks
from .plans import hierarchy, packs, tree
from .sources import graphs

_E = f"e AS (SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(l_partkey + {graphs.PART_BASE} AS BIGINT) AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2)"
_A = "a AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)"
_V = "v AS (SELECT src AS id, CAST(sum(w) AS BIGINT) AS degree FROM a GROUP BY src)"


def _l(k: int) -> str:
    return f"l AS (SELECT id, id % {k} AS part FROM v), b AS (SELECT a.*, a.src % {k} AS ps, a.dst % {k} AS pd FROM a)"


_S = "s AS (SELECT ps AS part, CAST(sum(w) AS BIGINT) AS volume, CAST(sum(CASE WHEN ps <> pd THEN w ELSE 0 END) AS BIGINT) AS cut FROM b GROUP BY ps), z AS (SELECT part, count(*) AS size FROM l GROUP BY part), st AS (SELECT z.part, size, volume, cut FROM z JOIN s ON z.part = s.part)"
_G = "n AS (SELECT src, ps, pd, CAST(sum(w) AS BIGINT) AS weight FROM b GROUP BY 1, 2, 3), g AS (SELECT src AS id, ps AS part, CAST(sum(CASE WHEN ps = pd THEN weight ELSE 0 END) AS BIGINT) AS internal, CAST(sum(CASE WHEN ps <> pd THEN weight ELSE 0 END) AS BIGINT) AS external, max(weight) AS most, arg_max(pd, weight * 100 - pd) FILTER (WHERE ps <> pd) AS best FROM n GROUP BY 1, 2)"
_X = "x AS (SELECT id, id % 3 AS comp, CAST((id * 7919) % 1009 AS DOUBLE) AS x, degree FROM v)"


def _edges(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    return graphs.supply_graph(spark, sf_dir, least)


def _labels(edges: DataFrame, k: int) -> DataFrame:
    return graphs.vertices(edges).select("id", (F.col("id") % k).alias("part"))


def _values(edges: DataFrame) -> DataFrame:
    return graphs.vertices(edges).select("id", (F.col("id") % 3).alias("comp"), ((F.col("id") * 7919) % 1009).cast("double").alias("x"))


def p1_edges(spark, d):
    return _edges(spark, d)


def p7_vertices(spark, d):
    return graphs.vertices(_edges(spark, d))


def a9_degree_stats(spark, d):
    return cuts.degree_stats(_edges(spark, d))


def a1_part_stats(spark, d):
    e = _edges(spark, d)
    return cuts.part_stats(e, _labels(e, 8))


def a4_two_way_scores(spark, d):
    e = _edges(spark, d)
    return cuts.scores(cuts.part_stats(e, _labels(e, 2)))


def a5_normalized_cut(spark, d):
    e = _edges(spark, d)
    return cuts.scores(cuts.part_stats(e, _labels(e, 8))).select("normalized_cut")


def c16_contract(spark, d):
    e = _edges(spark, d)
    return cuts.contracted(e, _labels(e, 50))[0]


def r7_gains(spark, d):
    e = _edges(spark, d)
    return cuts.gains(e, _labels(e, 8))


def f5_boundary(spark, d):
    e = _edges(spark, d)
    return cuts.boundary(e, _labels(e, 8))


def t1_components(spark, d):
    return traverse.components(_edges(spark, d))


def t1_components_in_parts(spark, d):
    e = _edges(spark, d)
    return traverse.components(e, _labels(e, 5))


def t4_bfs_levels(spark, d):
    e = _edges(spark, d)
    return traverse.bfs_levels(e, e.agg(F.min("src").alias("id"))).select("id", F.col("level").cast("long").alias("level"))


def f2_active_edges(spark, d):
    e = _edges(spark, d)
    return walks.active(e, _values(e).select("id", "comp"))


def c2_walk_step(spark, d):
    e = _edges(spark, d)
    v = _values(e)
    return walks.walk_step(walks.active(e, v.select("id", "comp")), v).select("id", "comp", F.round("x", 6).alias("x"))


def c5_potentials(spark, d):
    e = _edges(spark, d)
    return walks.potentials(e, _values(e)).select("comp", "spread", F.round("l2", 2).alias("l2"), F.round("weighted_l2", 1).alias("weighted_l2"))


def c6_sweep(spark, d):
    e = _edges(spark, d)
    return walks.sweep(e, _values(e)).select("comp", F.col("rank").cast("long").alias("rank"), "id", "cut", "vol")


def c6_best_cuts(spark, d):
    e = _edges(spark, d)
    return walks.best_cuts(walks.sweep(e, _values(e))).select("comp", F.col("rank").cast("long").alias("rank"), F.round("sparsity", 9).alias("sparsity"), "size")


def g7_lattice(spark, d):
    return graphs.lattice(spark, 40)


def g6_clique_path(spark, d):
    return graphs.cliques(spark, 20, 10, path=True)


def g10_fur(spark, d):
    return graphs.fur(spark, 60)


def _star_tree(spark, d):
    """Parts as the children of one root."""
    e = _edges(spark, d)
    stats = cuts.part_stats(e, _labels(e, 50))
    leaves = stats.select(F.lit(0).alias("level"), F.col("part").alias("node"), F.lit(0).cast("long").alias("parent"), F.col("cut").alias("weight"), F.col("size").alias("subtree_size"), F.col("volume").alias("subtree_volume"))
    root = stats.agg(F.lit(1).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("weight"), F.sum("size").alias("subtree_size"), F.sum("volume").alias("subtree_volume"))
    return leaves.unionByName(root)


def _edge(found):
    return found.select(F.round("cost", 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def q1_sparsest_tree_edge(spark, d):
    return _edge(hierarchy.best_tree_edge(_star_tree(spark, d)))


def q2_low_conductance_tree_edge(spark, d):
    return _edge(hierarchy.best_tree_edge(_star_tree(spark, d), "subtree_volume"))


def q3_two_way_tree_cut(spark, d):
    t = _star_tree(spark, d)
    cost, cut = tree.greedy_cut(t, 2)
    return tree.edge_table(t, cut).select(F.round(F.lit(cost), 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def q4_greedy_tree_cut(spark, d):
    t = _star_tree(spark, d)
    cost, cut = tree.greedy_cut(t, 4)
    return tree.edge_table(t, cut).select(F.round(F.lit(cost), 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def q5_dynamic_tree_cut(spark, d):
    t = _star_tree(spark, d)
    cost, cut = tree.dynamic_cut(t, 4)
    return tree.edge_table(t, cut).select(F.round(F.lit(cost), 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def q9_labels_of_cut(spark, d):
    return tree.labels_of_cut(_star_tree(spark, d), [(0, 3), (0, 7)])


def p11_tree_graph(spark, d):
    return tree.to_graph(_star_tree(spark, d))


def j7_closure(spark, d):
    return tree.closure(_star_tree(spark, d)).select(F.col("level").cast("long").alias("level"), "node", F.col("alevel").cast("long").alias("alevel"), "anode")


def m1_least_tree_cut(spark, d):
    t = _star_tree(spark, d)
    return tree.least_tree_cut(t, t.where("level = 0").select((F.col("node") % 5).alias("sample"), F.col("node").alias("id")))


def g8_margulis(spark, d):
    return graphs.margulis(spark, 30)


def c13_decompose(spark, d):
    return hierarchy.decompose(graphs.supply_graph(spark, d, ranged=True), 0.1)


def c18_hierarchy(spark, d):
    return hierarchy.hierarchy(graphs.supply_graph(spark, d, ranged=True))


def r13_normalized_cut(spark, d):
    """The whole way: hierarchy, greedy cut of its tree into four, refined level by level, scored on the input."""
    h = hierarchy.expand(graphs.supply_graph(spark, d, ranged=True))
    return packs.part_stats(h.graphs[0], hierarchy.solve(h, 4))


def _drawn(id_, sample):
    """Numbers that SQL can draw, too."""
    return F.pmod(id_ * 7919 + sample * 104729, F.lit(1000003)) * 2147


def g1_uniform_samples(spark, d):
    return samples.uniform_samples(graphs.vertices(_edges(spark, d)), [10, 100, 200], repetitions=2, of=_drawn)


def g2_ball(spark, d):
    e = _edges(spark, d)
    return samples.ball(e, e.agg(F.min("src").alias("id")), 100, of=_drawn).select("id", F.col("level").cast("long").alias("level"))


def g11_margulis_fur(spark, d):
    return graphs.furred(graphs.margulis(spark, 30), 900)


QUERIES = {f.__name__: f for f in (p1_edges, p7_vertices, a9_degree_stats, a1_part_stats, a4_two_way_scores, a5_normalized_cut, c16_contract, r7_gains, f5_boundary, t1_components, t1_components_in_parts, t4_bfs_levels, f2_active_edges, c2_walk_step, c5_potentials, c6_sweep, c6_best_cuts, g7_lattice, g6_clique_path, g10_fur, q1_sparsest_tree_edge, q2_low_conductance_tree_edge, q3_two_way_tree_cut, q4_greedy_tree_cut, q5_dynamic_tree_cut, q9_labels_of_cut, p11_tree_graph, j7_closure, m1_least_tree_cut, g8_margulis, g1_uniform_samples, g2_ball, g11_margulis_fur, c13_decompose, c18_hierarchy, r13_normalized_cut)}

_SWEEP = f"""WITH {_E}, {_A}, {_V}, {_X}, r AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY x, id) AS rank FROM x),
d AS (SELECT a.src AS id, sum(CASE WHEN y.rank > x.rank THEN w ELSE -w END) AS delta FROM a JOIN r x ON a.src = x.id JOIN r y ON a.dst = y.id WHERE x.comp = y.comp GROUP BY 1),
sw AS (SELECT r.comp, rank, r.id, CAST(sum(coalesce(delta, 0)) OVER q AS BIGINT) AS cut, CAST(sum(degree) OVER q AS BIGINT) AS vol, sum(degree) OVER (PARTITION BY comp) AS whole, count(*) OVER (PARTITION BY comp) AS size
FROM r LEFT JOIN d ON r.id = d.id WINDOW q AS (PARTITION BY comp ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""



def _spread(edges: str, rounds: int = 10) -> str:
    """Least labels of neighbours, so many times: more than the diameter of these dense graphs."""
    step = lambda k: f"l{k + 1} AS MATERIALIZED (SELECT x.id, least(x.comp, coalesce(min(y.comp), x.comp)) AS comp FROM l{k} x LEFT JOIN {edges} ON {edges}.src = x.id LEFT JOIN l{k} y ON y.id = {edges}.dst GROUP BY x.id, x.comp)"
    return ", ".join(["l0 AS (SELECT id, id AS comp FROM v)", *map(step, range(rounds))]) + f" SELECT id, comp FROM l{rounds}"


ORACLE_SQL = {
    "p1_edges": f"WITH {_E} SELECT * FROM e",
    "p7_vertices": f"WITH {_E}, {_A}, {_V} SELECT * FROM v",
    "a9_degree_stats": f"WITH {_E}, {_A}, d AS (SELECT src, count(*) AS d FROM a GROUP BY src) SELECT count(*) AS vertices, CAST(sum(d) / 2 AS BIGINT) AS edges, max(d) AS max_degree, round(avg(d), 2) AS avg_degree, CAST(floor(quantile_cont(d, 0.25)) AS BIGINT) AS p25, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(d, 0.75)) AS BIGINT) AS p75, CAST(floor(quantile_cont(d, 0.9)) AS BIGINT) AS p90, stddev_pop(d) AS std FROM d",
    "a1_part_stats": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_S} SELECT * FROM st",
    "a4_two_way_scores": f"WITH {_E}, {_A}, {_V}, {_l(2)}, {_S} SELECT CAST(sum(cut) / 2 AS DOUBLE) AS cut_size, sum(cut) / 2 / min(size) AS sparsity, sum(cut) / 2 / min(volume) AS conductance, sum(cut / volume) AS normalized_cut FROM st",
    "a5_normalized_cut": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_S} SELECT sum(cut / volume) AS normalized_cut FROM st",
    "c16_contract": f"WITH {_E}, {_A}, {_V}, {_l(50)} SELECT ps AS src, pd AS dst, CAST(sum(w) AS BIGINT) AS w FROM b WHERE ps < pd GROUP BY 1, 2",
    "r7_gains": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_G} SELECT id, part, internal, external, greatest(most, internal) - internal AS gain, best AS best_part FROM g",
    "f5_boundary": f"WITH {_E}, {_A}, {_V}, {_l(8)}, {_S}, {_G}, m AS (SELECT floor(sum(volume) / count(*)) AS mean FROM st) SELECT id, g.part, internal, external FROM g JOIN st ON g.part = st.part, m WHERE external >= internal OR (external > 0 AND volume >= mean)",
    "t1_components": f"WITH {_E}, {_A}, {_V}, {_spread('a')}",
    "t1_components_in_parts": f"WITH {_E}, {_A}, {_V}, c AS (SELECT * FROM a WHERE src % 5 = dst % 5), {_spread('c')}",
    "t4_bfs_levels": f"WITH RECURSIVE {_E}, {_A}, r AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS level FROM e UNION SELECT a.dst, level + 1 FROM r JOIN a ON a.src = r.id WHERE level < 12) SELECT id, min(level) AS level FROM r GROUP BY id",
    "f2_active_edges": f"WITH {_E}, {_A} SELECT * FROM a WHERE src % 3 = dst % 3",
    "c2_walk_step": f"WITH {_E}, {_A}, {_V}, {_X}, c AS (SELECT * FROM a WHERE src % 3 = dst % 3), i AS (SELECT c.src, sum(w * x) / sum(w) AS inflow FROM c JOIN x ON c.dst = x.id GROUP BY c.src) SELECT id, comp, round(CASE WHEN inflow IS NULL THEN x ELSE 0.1 * x + 0.9 * inflow END, 6) AS x FROM x LEFT JOIN i ON x.id = i.src",
    "c5_potentials": f"WITH {_E}, {_A}, {_V}, {_X}, m AS (SELECT *, avg(x) OVER (PARTITION BY comp) AS mean FROM x) SELECT comp, max(x) - min(x) AS spread, round(sum((x - mean) * (x - mean)), 2) AS l2, round(sum(degree * (x - mean) * (x - mean)), 1) AS weighted_l2 FROM m GROUP BY comp",
    "c6_sweep": f"{_SWEEP} SELECT comp, rank, id, cut, vol FROM sw",
    "c6_best_cuts": f"{_SWEEP}, t AS (SELECT comp, rank, size, cut / least(vol, whole - vol) AS sparsity FROM sw WHERE rank < size AND least(vol, whole - vol) > 0), o AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY sparsity, rank) AS n FROM t) SELECT comp, rank, round(CAST(sparsity AS DOUBLE), 9) AS sparsity, size FROM o WHERE n = 1",
    **{
        name: f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S}, t AS (SELECT part AS node, cut / least({by}, (SELECT sum({by}) FROM st) - {by}) AS cost FROM st) SELECT round(CAST(cost AS DOUBLE), 9) AS cost, CAST(0 AS BIGINT) AS level, node FROM t ORDER BY t.cost, node LIMIT 1"
        for name, by in (("q1_sparsest_tree_edge", "size"), ("q2_low_conductance_tree_edge", "volume"))
    },
    "g7_lattice": "WITH p AS (SELECT range AS id, range // 40 AS r, range % 40 AS c FROM range(1600)) SELECT id AS src, id + dr * 40 + dc AS dst, CAST(1 AS BIGINT) AS w FROM p, (VALUES (0, 1), (1, 0), (1, 1)) m(dr, dc) WHERE r + dr < 40 AND c + dc < 40",
    "g6_clique_path": "SELECT a.range AS src, b.range AS dst, CAST(1 AS BIGINT) AS w FROM range(200) a, range(200) b WHERE a.range < b.range AND (a.range // 20 = b.range // 20 OR (a.range % 20 = 19 AND b.range = a.range + 1))",
    "g10_fur": "SELECT a.range AS src, b.range AS dst, CAST(1 AS BIGINT) AS w FROM range(60) a, range(120) b WHERE (a.range < b.range AND b.range < 60) OR b.range = a.range + 60",
    "q3_two_way_tree_cut": f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S}, t AS (SELECT part AS node, cut / volume + cut / ((SELECT sum(volume) FROM st) - volume) AS cost FROM st) SELECT round(CAST(cost AS DOUBLE), 9) AS cost, CAST(0 AS BIGINT) AS level, node FROM t ORDER BY t.cost, node LIMIT 1",
    "q9_labels_of_cut": f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S} SELECT part AS id, CAST(CASE part WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS BIGINT) AS part FROM st",
    "p11_tree_graph": f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S} SELECT row_number() OVER (ORDER BY part) - 1 AS src, (SELECT count(*) FROM st) AS dst, cut AS w FROM st",
    "j7_closure": f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S} SELECT CAST(0 AS BIGINT) AS level, part AS node, CAST(l AS BIGINT) AS alevel, CAST(CASE l WHEN 0 THEN part ELSE 0 END AS BIGINT) AS anode FROM st, (VALUES (0), (1)) x(l) UNION ALL SELECT 1, 0, 1, 0",
    "m1_least_tree_cut": f"WITH {_E}, {_A}, {_V}, {_l(50)}, {_S}, p AS (SELECT sample, sum(CASE WHEN part % 5 = sample THEN 0 ELSE least(volume, cut) END) AS s, sum(CASE WHEN part % 5 = sample THEN least(volume, cut) ELSE 0 END) AS t FROM st, (SELECT DISTINCT part % 5 AS sample FROM st) x GROUP BY sample) SELECT sample, CAST(least(s, t) AS DOUBLE) AS cut FROM p",
    "g8_margulis": "WITH p AS (SELECT range AS u, range // 30 AS a, range % 30 AS b FROM range(900)), q AS (SELECT u, a AS x, a + b AS y FROM p UNION ALL SELECT u, a, b - a + 30 FROM p UNION ALL SELECT u, a + b, b FROM p UNION ALL SELECT u, a - b + 30, b FROM p UNION ALL SELECT u, a + 1, b FROM p UNION ALL SELECT u, a + 29, b FROM p UNION ALL SELECT u, a, b + 1 FROM p UNION ALL SELECT u, a, b + 29 FROM p), r AS (SELECT u, (x % 30) * 30 + y % 30 AS v FROM q) SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst, CAST(1 AS BIGINT) AS w FROM r WHERE u <> v",
}
_DRAWN = "(id * 7919 + {} * 104729) % 1000003"
ORACLE_SQL |= {
    "g1_uniform_samples": f"WITH {_E}, {_A}, {_V}, q AS (SELECT CAST(k + 3 * r AS BIGINT) AS sample, CAST(least(s, (SELECT count(*) FROM v) - s) AS BIGINT) AS size FROM (VALUES (0, 10), (1, 100), (2, 200)) x(k, s), (VALUES (0), (1)) y(r)), o AS (SELECT sample, size, id, row_number() OVER (PARTITION BY sample ORDER BY {_DRAWN.format('sample')}, id) AS n FROM v, q) SELECT sample, size, id FROM o WHERE n <= size",
    "g2_ball": f"WITH RECURSIVE {_E}, {_A}, r AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS level FROM e UNION SELECT a.dst, level + 1 FROM r JOIN a ON a.src = r.id WHERE level < 12), m AS (SELECT id, min(level) AS level FROM r GROUP BY id), o AS (SELECT *, row_number() OVER (ORDER BY level, {_DRAWN.format('0')}, id) AS n FROM m) SELECT id, level FROM o WHERE n <= 100",
    "g11_margulis_fur": ORACLE_SQL["g8_margulis"] + " UNION ALL SELECT range, range + 900, 1 FROM range(900)",
}
