"""Partition and tree files, samples and random generators."""

import math

import pytest

from latticut.operators import samples, traverse
from latticut.sources import files, graphs


def part_file(folder):
    (part,) = folder.glob("part-*.txt")
    return str(part)


def test_partition_is_read_back(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("% c\n2\n\n0\n 1 \n")
    found = files.read_partition(spark, str(path))
    assert sorted(map(tuple, found.collect())) == [(0, 2), (1, 0), (2, 1)]
    files.write_partition(found, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_partition(spark, part_file(tmp_path / "out")).collect())) == [(0, 2), (1, 0), (2, 1)]


def test_tree_is_read_back(spark, tmp_path):
    rows = [(0, 10, 100, 3), (0, 20, 200, 4), (0, 30, 100, 5), (1, 100, 7, 2), (1, 200, 7, 2), (2, 7, None, 0)]
    files.write_tree(spark.createDataFrame(rows, "level int, node long, parent long, weight long"), str(tmp_path / "t"))
    assert open(part_file(tmp_path / "t")).read().splitlines() == ["0 3 1 4 0 5", "0 2 0 2", "-1 0"]
    got = files.read_tree(spark, part_file(tmp_path / "t")).collect()
    assert sorted(got) == [(0, 0, 0, 3), (0, 1, 1, 4), (0, 2, 0, 5), (1, 0, 0, 2), (1, 1, 0, 2), (2, 0, None, 0)]


def test_uniform_samples(spark):
    found = samples.uniform_samples(spark.range(100), [10, 70, 100], repetitions=3).collect()
    sizes = {}
    for r in found:
        sizes.setdefault((r["sample"], r["size"]), set()).add(r["id"])
    assert {k: len(v) for k, v in sizes.items()} == {(s, 10 if s % 2 == 0 else 30): 10 if s % 2 == 0 else 30 for s in range(6)}
    assert len({tuple(sorted(v)) for v in sizes.values()}) == 6
    assert samples.uniform_samples(spark.range(0), [3]).count() == 0


def test_ball(spark):
    edges = graphs.lattice(spark, 6)
    got = samples.ball(edges, spark.range(1), 6).collect()
    # the corner, its three neighbours, and two of the next level
    assert sorted(r["level"] for r in got) == [0, 1, 1, 1, 2, 2]
    assert samples.ball(edges, spark.range(1), 1000).count() == 36


def test_cycle_of_many_blocks(spark):
    cycle = graphs._cycle(spark, 500, 3, block=20).collect()
    after = {r["u"]: r["v"] for r in cycle}
    at, seen = 0, []
    for _ in range(500):
        seen.append(at)
        at = after[at]
    assert at == 0 and sorted(seen) == list(range(500)) and len(cycle) == 500


def test_random_graphs(spark):
    n = 60
    edges = graphs.random_regular(spark, n)
    degree = 2 * (int(math.log(n)) // 2 + 1)
    assert {r["degree"] for r in graphs.vertices(edges).collect()} == {degree}
    assert traverse.components(edges).select("comp").distinct().count() == 1
    assert graphs.furred(edges, n).count() == edges.count() + n
    sparse = graphs.random_sparse(spark, n)
    assert sparse.where("src >= dst OR src < 0 OR dst >= 60").count() == 0 and graphs.vertices(sparse).count() == n


def test_files_are_found_and_converted(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.mtx", "a/x_coord.mtx", "y.chaco", "z_b.mtx", "other.txt"):
        (tmp_path / name).write_text("3 3 2\n1 2\n3 2\n")
    assert sorted(r["path"].rpartition("/")[2] for r in graphs.discover(spark, str(tmp_path)).collect()) == ["x.mtx", "y.chaco"]
    graphs.mtx_to_chaco(spark, str(tmp_path / "a/x.mtx"), 3, str(tmp_path / "out"))
    assert open(part_file(tmp_path / "out")).read().splitlines() == ["3 2", "2", "1 3", "2"]


def test_large_files_are_read_in_parts(spark, tmp_path):
    n = 3000
    path = tmp_path / "p.txt"
    path.write_text("% head\n" + "".join(f"{k * 7 % 13}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    got = {r["id"]: r["part"] for r in files.read_partition(spark, str(path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: k * 7 % 13 for k in range(n)}


def test_missing_files_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        graphs.read_mtx(spark, str(tmp_path / "none.mtx")).count()
