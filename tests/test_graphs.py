"""Readers, writers, generators and scores on small graphs with known answers."""

from pyspark.sql import functions as F

from latticut.operators import cuts, traverse, walks
from latticut.sources import graphs


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_mtx(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket\n% c\n4 4 5\n1 2 0.5\n2 1\n% mid\n3 3\n2 3 \n4 1\n")
    assert pairs(graphs.read_mtx(spark, str(path))) == [(0, 1), (0, 3), (1, 2)]


def test_chaco_with_isolated(spark, tmp_path):
    path = tmp_path / "g.chaco"
    path.write_text("% c\n4 2\n2 \n1 4\n\n2\n")
    assert pairs(graphs.read_chaco(spark, str(path))) == [(0, 1), (1, 0), (1, 3), (3, 1)]


def test_written_mtx_is_read_back(spark, tmp_path):
    edges = graphs.lattice(spark, 3)
    graphs.write_mtx(edges, 9, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.txt")
    assert part.read_text().splitlines()[0] == f"9 9 {2 * edges.count()}"
    assert pairs(graphs.read_mtx(spark, str(part))) == pairs(edges)


def test_generators(spark):
    assert graphs.lattice(spark, 4).count() == 2 * 4 * 3 + 9
    assert graphs.cliques(spark, 5, 3, path=True).count() == 3 * 10 + 2
    assert graphs.fur(spark, 5).count() == 10 + 5


def test_clique_path_scores(spark):
    n, k = 5, 4
    edges = graphs.cliques(spark, n, k, path=True)
    labels = graphs.vertices(edges).select("id", F.floor(F.col("id") / n).alias("part"))
    got = cuts.scores(cuts.part_stats(edges, labels)).first()
    assert got["cut_size"] == k - 1
    assert abs(got["normalized_cut"] - (2 / (n * (n - 1) + 1) + 2 * (k - 2) / (n * (n - 1) + 2))) < 1e-12


def test_components_and_levels(spark):
    edges = graphs.cliques(spark, 4, 3)
    assert {r["id"]: r["comp"] for r in traverse.components(edges).collect()} == {i: i // 4 * 4 for i in range(12)}
    path = graphs.canonical(spark.createDataFrame([(i, i + 1) for i in range(12)], "u long, v long"))
    assert {r["comp"] for r in traverse.components(path).collect()} == {0}
    assert {r["id"]: r["level"] for r in traverse.bfs_levels(path, spark.range(1)).collect()} == {i: i for i in range(13)}


def test_sweep_finds_the_bridge(spark):
    edges = graphs.cliques(spark, 5, 2, path=True)
    values = graphs.vertices(edges).select("id", F.lit(0).alias("comp"), F.col("id").cast("double").alias("x"))
    best = walks.best_cuts(walks.sweep(edges, values)).first()
    assert best["rank"] == 5 and abs(best["sparsity"] - 1 / 21) < 1e-12


def test_walk_keeps_isolated_values(spark):
    edges = graphs.cliques(spark, 3, 1)
    values = spark.createDataFrame([(0, 0, 3.0), (1, 0, 0.0), (2, 0, 0.0), (9, 9, 7.0)], "id long, comp long, x double")
    got = {r["id"]: r["x"] for r in walks.walk_step(walks.active(edges, values.select("id", "comp")), values).collect()}
    assert got[9] == 7.0 and abs(got[0] - 0.3) < 1e-12 and abs(got[1] - 0.9 * 1.5) < 1e-12
