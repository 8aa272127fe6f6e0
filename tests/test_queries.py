"""Queries on a small lineitem, against plain versions."""

import pytest

from latticut import queries
from latticut.sources import graphs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two groups of four suppliers and four parts each, every pair once, and a repeated pair in the first; (folder, vertices, pairs)."""
    pairs = {(g * 4 + s, g * 4 + p) for g in range(2) for s in range(4) for p in range(4)}
    rows = [*sorted(pairs), (0, 0)]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    return path, {s for s, _ in pairs} | {p + graphs.PART_BASE for _, p in pairs}, pairs


def test_components_have_pairs_that_occur_once(spark, small):
    path, ids, pairs = small
    got = {r["id"]: r["comp"] for r in queries.QUERIES["t1_components"](spark, path).collect()}
    assert got == {i: i % graphs.PART_BASE // 4 * 4 for i in ids}
    comp = {i: i for i in ids}
    for _ in ids:
        for s, p in pairs:
            if s % 5 == (p + graphs.PART_BASE) % 5:
                comp[s] = comp[p + graphs.PART_BASE] = min(comp[s], comp[p + graphs.PART_BASE])
    assert {r["id"]: r["comp"] for r in queries.QUERIES["t1_components_in_parts"](spark, path).collect()} == comp


def test_decomposition_hierarchy_and_cut_have_pairs_that_occur_once(spark, small):
    path, ids, pairs = small
    found = queries.QUERIES["c13_decompose"](spark, path).collect()
    assert {r["id"]: r["comp"] for r in found} == {i: i % graphs.PART_BASE // 4 * 4 for i in ids} and len(found) == len(ids)
    tree = queries.QUERIES["c18_hierarchy"](spark, path)
    assert {r["node"] for r in tree.where("level = 0").collect()} == ids
    (root,) = tree.where("parent IS NULL").collect()
    assert (root["subtree_size"], root["subtree_volume"]) == (len(ids), 2 * len(pairs) + 2)
    parts = queries.QUERIES["r13_normalized_cut"](spark, path).collect()
    assert sum(r["size"] for r in parts) == len(ids) and sum(r["volume"] for r in parts) == 2 * len(pairs) + 2
