"""Queries on the natural hierarchy of customers and suppliers: vertices, nations, regions, one root; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cuts, flow
from .plans import experiments, hierarchy, tree
from .queries import _drawn
from .sources import files, graphs

BASE = graphs.PART_BASE


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers, joined by the number of lines sold."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("l_suppkey").cast("long").alias("src"), (F.col("o_custkey") + BASE).cast("long").alias("dst")).agg(F.count("*").alias("w"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """id, nation and region of suppliers and customers."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    people = read("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").alias("n")).unionByName(read("customer").select((F.col("c_custkey") + BASE).cast("long").alias("id"), F.col("c_nationkey").alias("n")))
    return people.join(read("nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r")), "n").select("id", F.col("n").cast("long").alias("nation"), F.col("r").cast("long").alias("region"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    e, places = _trade(spark, d), _places(spark, d)
    base = graphs.vertices(e).join(places, "id")
    at = lambda level, node, parent, weight, size, volume: [F.lit(level).alias("level"), node.alias("node"), parent.cast("long").alias("parent"), weight.cast("long").alias("weight"), size.cast("long").alias("subtree_size"), volume.cast("long").alias("subtree_volume")]
    out = base.select(*at(0, F.col("id"), F.col("nation"), F.col("degree"), F.lit(1), F.col("degree")))
    up = {"nation": base.select("nation", "region").distinct().select(F.col("nation").alias("part"), F.col("region").alias("up")), "region": base.select(F.col("region").alias("part"), F.lit(0).alias("up")).distinct()}
    for level, name in ((1, "nation"), (2, "region")):
        stats = cuts.part_stats(e, base.select("id", F.col(name).alias("part"))).join(up[name], "part")
        out = out.unionByName(stats.select(*at(level, F.col("part"), F.col("up"), F.col("cut"), F.col("size"), F.col("volume"))))
    return out.unionByName(base.agg(F.count("*").alias("n"), F.sum("degree").alias("v")).select(*at(3, F.lit(0).cast("long"), F.lit(None), F.lit(0), F.col("n"), F.col("v"))))


def _edge(found: DataFrame) -> DataFrame:
    return found.select(F.round("cost", 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def a10_tree_rollup(spark, d):
    """A tree without sizes, rolled up from its leaves."""
    bare = _tree(spark, d).select("level", "node", "parent", "weight")
    return tree.resized(bare, graphs.vertices(_trade(spark, d))).select(F.col("level").cast("long").alias("level"), "node", "parent", "weight", "subtree_size", "subtree_volume")


def a11_children(spark, d):
    return tree.children(_tree(spark, d)).where("level > 1").select(F.col("level").cast("long").alias("level"), "node", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def j7_tree_closure(spark, d):
    return tree.closure(_tree(spark, d)).select(F.col("level").cast("long").alias("level"), "node", F.col("alevel").cast("long").alias("alevel"), "anode")


def p11_hierarchy_graph(spark, d):
    return tree.to_graph(_tree(spark, d)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")


def q1_sparsest_edge(spark, d):
    return _edge(hierarchy.best_tree_edge(_tree(spark, d)))


def q2_low_conductance_edge(spark, d):
    return _edge(hierarchy.best_tree_edge(_tree(spark, d), "subtree_volume"))


def q3_two_way_cut(spark, d):
    t = _tree(spark, d)
    cost, cut = tree.greedy_cut(t, 2)
    return tree.edge_table(t, cut).select(F.round(F.lit(cost), 9).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def q4_greedy_three_parts(spark, d):
    t = _tree(spark, d)
    cost, cut = tree.greedy_cut(t, 3)
    return tree.edge_table(t, cut).select(F.round(F.lit(cost), 8).alias("cost"), F.col("level").cast("long").alias("level"), "node")


def _nations_of(t: DataFrame, region: int) -> list[tuple[int, int]]:
    """A cut at the nations of a region, which are few."""
    return [(1, r["node"]) for r in t.where((F.col("level") == 1) & (F.col("parent") == region)).select("node").collect()]


def q6_taboo_nodes(spark, d):
    t = _tree(spark, d)
    return tree.taboo_nodes(t, [*_nations_of(t, 0), (2, 1), (1, _nations_of(t, 2)[0][1])]).select(F.col("level").cast("long").alias("level"), "node")


def q7_painted(spark, d):
    """Region 1 painted 1; region 2 painted 2 but for nation 8; the whole painted 3 where it is still 0."""
    t = _tree(spark, d)
    pairs = tree.closure(t)
    labels = t.select("level", "node", F.lit(0).cast("long").alias("label"))
    labels = tree.painted(labels, pairs, 2, 1, 1)
    labels = tree.painted(labels, pairs, 2, 2, 2, avoid=[(1, 8)])
    labels = tree.painted(labels, pairs, 3, 0, 3, match=0)
    return labels.select(F.col("level").cast("long").alias("level"), "node", "label")


def q8_added_above(spark, d):
    """One more above nation 3; then ten times that up to the first label that is not 0."""
    t = _tree(spark, d)
    pairs, values = tree.closure(t), t.select("level", "node", F.col("subtree_size").alias("value"))
    values = tree.added_above(values, pairs, 1, 3, F.col("value") + 1)
    labels = t.select("level", "node", (F.col("level") == 3).cast("long").alias("label"))
    values = tree.added_above(values, pairs, 1, 3, F.col("value") * 10, labels, 0)
    return values.where("level > 0").select(F.col("level").cast("long").alias("level"), "node", "value")


def q9_region_or_not(spark, d):
    return tree.bipartition(_tree(spark, d), 2, 3)


def q10_finalized(spark, d):
    return tree.finalized(_tree(spark, d).where("level < 3").withColumn("parent", F.when(F.col("level") < 2, F.col("parent")))).where("level > 0").select(F.col("level").cast("long").alias("level"), "node", "parent", F.col("weight").cast("long").alias("weight"), "subtree_size", "subtree_volume")


def q11_layers(spark, d):
    return tree.layers(_tree(spark, d)).select(F.col("level").cast("long").alias("level"), "size", "volume", "weight")


def t8_tree_connected(spark, d):
    """Suppliers and the next one, in a tree whose edges above region 1 weigh nothing."""
    t = _tree(spark, d).withColumn("weight", F.when((F.col("level") == 2) & (F.col("node") == 1), 0).otherwise(F.col("weight")))
    ids = _places(spark, d).where(F.col("id") < BASE).join(t.where("level = 0").select(F.col("node").alias("id")), "id").select(F.col("id").alias("s"))
    pairs = ids.join(ids.select((F.col("s") - 1).alias("s"), F.col("s").alias("t")), "s")
    return tree.connected(t, pairs)


def s8_tree_lines(spark, d):
    """The tree as lines, read back: nodes are numbered inside their level."""
    lines = files.tree_lines(_tree(spark, d)).select(F.lit("").alias("file"), F.col("level").cast("long").alias("at"), F.lit(0).cast("long").alias("k"), F.col("value").alias("line"))
    return files.parse_tree(lines).select(F.col("level").cast("long").alias("level"), "node", "parent", "weight")


def r1_projected(spark, d):
    """Labels of regions carried down to nations; nations 2 and 7 start parts of their own."""
    t = _tree(spark, d)
    labels = t.where("level = 2").select(F.col("node").alias("id"), F.col("node").alias("part"))
    leaders = spark.createDataFrame([(2, 10), (7, 11)], "node bigint, color int")
    return tree.project(t, labels, 1, leaders)


def m1_least_cut(spark, d):
    """Samples of every fifth vertex of the tree's leaves, by number."""
    t = _tree(spark, d)
    return tree.least_tree_cut(t, t.where("level = 0").select((F.col("node") % 5).alias("sample"), F.col("node").alias("id")))


def g3_quality(spark, d):
    """Least cuts of the tree beside true cuts, of two samples of each size."""
    found = experiments.quality_loop(_trade(spark, d), _tree(spark, d), experiments.Quality(sizes=(10, 100, 400), repetitions=2), _drawn)
    return found.select("sample", "size", "value", "actual", F.round("ratio", 9).alias("ratio"))


def _regions(spark, d):
    return cuts.contracted(_trade(spark, d), _places(spark, d).select("id", F.col("region").alias("part")).join(graphs.vertices(_trade(spark, d)).select("id"), "id"))[0]


def _terminals(spark, rows):
    return spark.createDataFrame([(s, i, source) for s, sources, sinks in rows for source, ids in ((True, sources), (False, sinks)) for i in ids], "sample bigint, id bigint, source boolean")


def m2_max_flow(spark, d):
    """Between each region and the next one."""
    return flow.max_flows(_regions(spark, d), _terminals(spark, [(k, [k], [k + 1]) for k in range(4)]))


def m3_max_flow_of_sets(spark, d):
    return flow.max_flows(_regions(spark, d), _terminals(spark, [(0, [0, 1], [3]), (1, [0], [2, 3, 4]), (2, [1, 4], [0, 2])]))


QUERIES = {f.__name__: f for f in (a10_tree_rollup, a11_children, j7_tree_closure, p11_hierarchy_graph, q1_sparsest_edge, q2_low_conductance_edge, q3_two_way_cut, q4_greedy_three_parts, q6_taboo_nodes, q7_painted, q8_added_above, q9_region_or_not, q10_finalized, q11_layers, t8_tree_connected, s8_tree_lines, r1_projected, m1_least_cut, g3_quality, m2_max_flow, m3_max_flow_of_sets)}

_T = f"""e AS (SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(o_custkey + {BASE} AS BIGINT) AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
a AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), v AS (SELECT src AS id, CAST(sum(w) AS BIGINT) AS degree FROM a GROUP BY src),
p AS (SELECT id, CAST(n AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, s_nationkey AS n FROM supplier UNION ALL SELECT CAST(c_custkey + {BASE} AS BIGINT), c_nationkey FROM customer) x JOIN nation ON n = n_nationkey),
b AS (SELECT id, degree, nation, region FROM v JOIN p USING (id)),
c AS (SELECT x.nation AS n1, y.nation AS n2, x.region AS r1, y.region AS r2, w FROM a JOIN p x ON a.src = x.id JOIN p y ON a.dst = y.id),
t AS (SELECT CAST(0 AS BIGINT) AS level, id AS node, nation AS parent, degree AS weight, CAST(1 AS BIGINT) AS subtree_size, degree AS subtree_volume FROM b
UNION ALL SELECT 1, nation, any_value(region), (SELECT CAST(sum(w) AS BIGINT) FROM c WHERE n1 = nation AND n2 <> nation), count(*), CAST(sum(degree) AS BIGINT) FROM b GROUP BY nation
UNION ALL SELECT 2, region, 0, (SELECT CAST(sum(w) AS BIGINT) FROM c WHERE r1 = region AND r2 <> region), count(*), CAST(sum(degree) AS BIGINT) FROM b GROUP BY region
UNION ALL SELECT 3, 0, NULL, 0, count(*), CAST(sum(degree) AS BIGINT) FROM b)"""
_CL = "cl AS (SELECT level, node, level AS alevel, node AS anode FROM t UNION ALL SELECT l.level, l.node, 1, l.parent FROM t l WHERE l.level = 0 UNION ALL SELECT 0, id, 2, region FROM b UNION ALL SELECT 0, id, 3, 0 FROM b UNION ALL SELECT 1, node, 2, parent FROM t WHERE level = 1 UNION ALL SELECT 1, node, 3, 0 FROM t WHERE level = 1 UNION ALL SELECT 2, node, 3, 0 FROM t WHERE level = 2)"
_NUM = "o AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY node) - 1 AS i FROM t), st AS (SELECT level, CAST(sum(count(*)) OVER (ORDER BY level) - count(*) AS BIGINT) AS start FROM t GROUP BY level)"
_LEAST = """s0 AS (SELECT m.sample, b.nation, b.region, b.degree, x.id IS NOT NULL AS inside FROM b CROSS JOIN (SELECT DISTINCT sample FROM sm) m LEFT JOIN sm x ON x.id = b.id AND x.sample = m.sample),
s1 AS (SELECT sample, nation, any_value(region) AS region, sum(least(CASE WHEN inside THEN 0 ELSE degree END, (CASE WHEN inside THEN degree ELSE 0 END) + degree)) AS s, sum(least(CASE WHEN inside THEN degree ELSE 0 END, (CASE WHEN inside THEN 0 ELSE degree END) + degree)) AS t FROM s0 GROUP BY 1, 2),
s2 AS (SELECT sample, region, sum(least(s, s1.t + weight)) AS s, sum(least(s1.t, s + weight)) AS t FROM s1 JOIN t n ON n.level = 1 AND n.node = nation GROUP BY 1, 2),
s3 AS (SELECT sample, sum(least(s, s2.t + weight)) AS s, sum(least(s2.t, s + weight)) AS t FROM s2 JOIN t n ON n.level = 2 AND n.node = region GROUP BY 1),
lc AS (SELECT sample, CAST(least(s, t) AS DOUBLE) AS cut FROM s3)"""
_SAMPLES = "q AS (SELECT CAST(k + 3 * r AS BIGINT) AS sample, CAST(least(s, (SELECT count(*) FROM v) - s) AS BIGINT) AS size FROM (VALUES (0, 10), (1, 100), (2, 400)) x(k, s), (VALUES (0), (1)) y(r)), so AS (SELECT sample, size, id, row_number() OVER (PARTITION BY sample ORDER BY (id * 7919 + sample * 104729) % 1000003, id) AS n FROM v, q), sm AS (SELECT sample, size, id FROM so WHERE n <= size)"
_BEST = "SELECT round(CAST(cost AS DOUBLE), 9) AS cost, level, node FROM x ORDER BY x.cost, level, node LIMIT 1"
_MASKS = "rw AS (SELECT r1, r2, CAST(sum(w) AS BIGINT) AS w FROM c WHERE r1 < r2 GROUP BY 1, 2), mk AS (SELECT range AS m FROM range(32)), mc AS (SELECT m, CAST(sum(CASE WHEN (m >> r1) % 2 <> (m >> r2) % 2 THEN w ELSE 0 END) AS DOUBLE) AS cut FROM rw, mk GROUP BY m)"


def _flow(rows: list[tuple[int, list[int], list[int]]]) -> str:
    one = lambda k, s, t: f"SELECT CAST({k} AS BIGINT) AS sample, min(cut) AS flow FROM mc WHERE {' AND '.join([f'(m >> {i}) % 2 = 1' for i in s] + [f'(m >> {i}) % 2 = 0' for i in t])}"
    return f"WITH {_T}, {_MASKS} " + " UNION ALL ".join(one(*r) for r in rows)


ORACLE_SQL = {
    "a10_tree_rollup": f"WITH {_T} SELECT * FROM t",
    "a11_children": f"WITH {_T} SELECT level + 1 AS level, parent AS node, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS children FROM t WHERE parent IS NOT NULL AND level > 0 GROUP BY level, parent",
    "j7_tree_closure": f"WITH {_T}, {_CL} SELECT level, node, CAST(alevel AS BIGINT) AS alevel, anode FROM cl",
    "p11_hierarchy_graph": f"WITH {_T}, {_NUM} SELECT CAST(o.i + x.start AS BIGINT) AS src, CAST(u.i + y.start AS BIGINT) AS dst, o.weight AS w FROM o JOIN st x ON x.level = o.level JOIN o u ON u.level = o.level + 1 AND u.node = o.parent JOIN st y ON y.level = u.level",
    "q1_sparsest_edge": f"WITH {_T}, x AS (SELECT weight / least(subtree_size, (SELECT count(*) FROM b) - subtree_size) AS cost, level, node FROM t WHERE level < 3) {_BEST}",
    "q2_low_conductance_edge": f"WITH {_T}, x AS (SELECT weight / least(subtree_volume, (SELECT sum(degree) FROM b) - subtree_volume) AS cost, level, node FROM t WHERE level < 3) {_BEST}",
    "q3_two_way_cut": f"WITH {_T}, x AS (SELECT weight / subtree_volume + weight / ((SELECT sum(degree) FROM b) - subtree_volume) AS cost, level, node FROM t WHERE level < 3) {_BEST}",
    "q4_greedy_three_parts": f"""WITH {_T}, {_CL}, al AS (SELECT CAST(sum(degree) AS DOUBLE) AS vol FROM b),
x AS (SELECT weight / subtree_volume + weight / ((SELECT vol FROM al) - subtree_volume) AS cost, level, node FROM t WHERE level < 3),
one AS (SELECT x.level, x.node, t.weight AS w1, t.subtree_volume AS v1 FROM x JOIN t USING (level, node) ORDER BY x.cost, x.level, x.node LIMIT 1),
bl AS (SELECT cl.level, cl.node FROM cl, one WHERE alevel = one.level AND anode = one.node), ab AS (SELECT alevel AS level, anode AS node FROM cl, one WHERE cl.level = one.level AND cl.node = one.node AND alevel > one.level),
y AS (SELECT t.level, t.node, CASE WHEN bl.node IS NOT NULL THEN weight / subtree_volume + (weight + w1) / nullif(v1 - subtree_volume, 0) + w1 / (vol - v1)
 ELSE (weight + CASE WHEN ab.node IS NULL THEN 0 ELSE w1 END) / (subtree_volume - CASE WHEN ab.node IS NULL THEN 0 ELSE v1 END) + (weight + w1 - CASE WHEN ab.node IS NULL THEN 0 ELSE w1 END) / nullif(vol - v1 - subtree_volume + CASE WHEN ab.node IS NULL THEN 0 ELSE v1 END, 0) + w1 / v1 END AS cost
 FROM t CROSS JOIN one CROSS JOIN al LEFT JOIN bl ON bl.level = t.level AND bl.node = t.node LEFT JOIN ab ON ab.level = t.level AND ab.node = t.node WHERE t.level < 3 AND NOT (t.level = one.level AND t.node = one.node)),
two AS (SELECT * FROM y WHERE cost IS NOT NULL ORDER BY cost, level, node LIMIT 1)
SELECT round(CAST(two.cost AS DOUBLE), 8) AS cost, z.level, z.node FROM two, (SELECT level, node FROM one UNION ALL SELECT level, node FROM two) z""",
    "q6_taboo_nodes": f"WITH {_T} SELECT CAST(2 AS BIGINT) AS level, CAST(0 AS BIGINT) AS node FROM t WHERE level = 2 AND node = 0",
    "q7_painted": f"WITH {_T}, {_CL}, g AS (SELECT level, node, max(CASE WHEN alevel = 2 THEN anode END) AS region, bool_or(alevel = 1 AND anode = 8) AS eight FROM cl GROUP BY 1, 2) SELECT level, node, CAST(CASE WHEN region = 1 THEN 1 WHEN region = 2 AND NOT eight THEN 2 WHEN region = 2 AND eight THEN 0 ELSE 3 END AS BIGINT) AS label FROM g",
    "q8_added_above": f"WITH {_T}, u AS (SELECT parent AS region FROM t WHERE level = 1 AND node = 3) SELECT level, node, CAST(CASE WHEN level = 3 THEN subtree_size + 1 WHEN level = 2 AND node = (SELECT region FROM u) THEN 10 * (subtree_size + 1) ELSE subtree_size END AS BIGINT) AS value FROM t WHERE level > 0",
    "q9_region_or_not": f"WITH {_T} SELECT id, CAST(CASE WHEN region = 3 THEN 1 ELSE 0 END AS BIGINT) AS part FROM b",
    "q10_finalized": f"WITH {_T} SELECT level, CASE level WHEN 3 THEN -1 ELSE node END AS node, CASE level WHEN 2 THEN -1 ELSE parent END AS parent, CASE WHEN level = 1 THEN weight ELSE 0 END AS weight, subtree_size, subtree_volume FROM t WHERE level > 0",
    "q11_layers": f"WITH {_T} SELECT level, count(*) AS size, CAST(sum(subtree_volume) AS BIGINT) AS volume, CAST(sum(weight) AS BIGINT) AS weight FROM t GROUP BY level",
    "t8_tree_connected": f"WITH {_T} SELECT x.id AS s, y.id AS t, (x.region = 1) = (y.region = 1) AS connected FROM b x JOIN b y ON y.id = x.id + 1 WHERE y.id < {BASE}",
    "s8_tree_lines": f"WITH {_T}, {_NUM} SELECT o.level, CAST(o.i AS BIGINT) AS node, CAST(u.i AS BIGINT) AS parent, o.weight FROM o LEFT JOIN o u ON u.level = o.level + 1 AND u.node = o.parent",
    "r1_projected": f"WITH {_T} SELECT node AS id, CAST(CASE node WHEN 2 THEN 10 WHEN 7 THEN 11 ELSE parent END AS BIGINT) AS part FROM t WHERE level = 1",
    "m1_least_cut": f"WITH {_T}, sm AS (SELECT id % 5 AS sample, id FROM b), {_LEAST} SELECT * FROM lc",
    "g3_quality": f"WITH {_T}, {_SAMPLES}, {_LEAST}, tc AS (SELECT x.sample, CAST(sum(CASE WHEN y.id IS NULL THEN w ELSE 0 END) AS BIGINT) AS actual FROM a JOIN sm x ON a.src = x.id LEFT JOIN sm y ON a.dst = y.id AND y.sample = x.sample GROUP BY 1) SELECT sample, q.size, cut AS value, actual, round(cut / actual, 9) AS ratio FROM lc JOIN tc USING (sample) JOIN q USING (sample)",
    "m2_max_flow": _flow([(k, [k], [k + 1]) for k in range(4)]),
    "m3_max_flow_of_sets": _flow([(0, [0, 1], [3]), (1, [0], [2, 3, 4]), (2, [1, 4], [0, 2])]),
}
