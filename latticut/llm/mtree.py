"""Exact top-k inner products by best-first search in M-trees.

A vector x gets one more component, sqrt(M^2 - |x|^2), where M is the longest length in its tree;
then the squared distance to a query (with 0 there) is |q|^2 + M^2 - 2 q.x, so the nearest vectors
have the highest products. Nodes are pages with a centre, a covering radius and the distance to their
parent's centre. A search takes the page with the least possible distance first; children whose stored
distance proves them too far, by the triangle inequality, are dropped without computing anything.
Components are integers, so products are exact; bounds have a margin beyond rounding.

Vectors are dealt to trees of bounded size by a hash of their id. Each tree is built once and written as pages;
queries are dealt to blocks, and each block reads each tree's pages and searches them. The best of all trees are
kept. Vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors of different lengths aren't compared, those of no components have products of 0. A query's candidates are
all vectors with another id, repeated rows each for itself; equal scores go to the smaller id. A query id that
repeats counts once, by its first vector in order of components. Empty tables give an empty result; other columns
are left out, so names can't clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import written

#: Vectors of a page at most, children of a node, and bytes of a written row.
PAGE, FANOUT, PAGE_BYTES = 512, 12, 4 << 20


@dataclass
class Node:
    """A page while the tree is built: the vectors below are first to last, children in ascending order of their distance."""

    centre: np.ndarray
    radius: float
    away: float
    first: int
    last: int
    children: list["Node"]


#: What a tree is made of, array by array. Of each node: centre, radius, distance to the parent's centre, the first and
#: last vector below and the first and last child; of each vector, in the order of pages: components, id, distance to its page's centre.
ARRAYS = {"centre": np.float64, "radius": np.float64, "away": np.float64, "span": np.int64, "below": np.int64, "whole": np.int64, "ids": np.int64, "near": np.float64}


class MTree:
    """Vectors lie in the order of the leaves, so that a page is one slice; so do the children of a node."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        norms = (vectors * vectors).sum(axis=1)
        top = int(norms.max(initial=0))
        self.points = np.column_stack([vectors.astype(np.float64), np.sqrt((top - norms).astype(np.float64))])
        self.order: list[np.ndarray] = []
        self.fringe: list[np.ndarray] = []
        self.laid = 0
        nodes, at = [self._build(np.arange(len(vectors)), None)], 0
        below = []
        while at < len(nodes):
            below.append((len(nodes), len(nodes) + len(nodes[at].children)))
            nodes += nodes[at].children
            at += 1
        order = np.concatenate(self.order)
        self.arrays = {
            "centre": np.stack([n.centre for n in nodes]),
            "radius": np.array([n.radius for n in nodes]),
            "away": np.array([n.away for n in nodes]),
            "span": np.array([(n.first, n.last) for n in nodes]),
            "below": np.array(below),
            "whole": vectors[order],
            "ids": ids[order],
            "near": np.concatenate(self.fringe),
        }
        del self.points, self.order, self.fringe
        self._open()

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], size: int) -> "MTree":
        """A tree from its arrays, laid flat; vectors have size components."""
        tree = cls.__new__(cls)
        shapes = {"centre": (-1, size + 1), "span": (-1, 2), "below": (-1, 2), "whole": (len(arrays["ids"]), size)}
        tree.arrays = {k: v.reshape(shapes.get(k, -1)) for k, v in arrays.items()}
        tree._open()
        return tree

    def _open(self) -> None:
        self.whole, self.ids = self.arrays["whole"], self.arrays["ids"]
        self.floats = self.whole.astype(np.float64)
        self.top = int((self.whole * self.whole).sum(axis=1).max(initial=0))

    def _distances(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        d = self.points[rows] - centre
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, above: np.ndarray | None) -> Node:
        centre = self.points[rows].mean(axis=0) if len(rows) else np.zeros(self.points.shape[1])
        away = self._distances(rows, centre)
        node = Node(centre, float(away.max(initial=0.0)), 0.0 if above is None else float(np.sqrt(((centre - above) ** 2).sum())), self.laid, self.laid, [])
        if len(rows) <= PAGE:
            order = np.argsort(away, kind="stable")
            self.order.append(rows[order])
            self.fringe.append(away[order])
            self.laid += len(rows)
        else:
            parts = self._split(rows, away)
            if max(len(p) for p in parts) > 0.75 * len(rows):  # copies, or one far vector after another: shells keep the tree low
                parts = np.array_split(rows[np.argsort(away, kind="stable")], FANOUT)
            node.children = sorted((self._build(p, centre) for p in parts), key=lambda c: c.away)
        node.last = self.laid
        return node

    def _split(self, rows: np.ndarray, away: np.ndarray) -> list[np.ndarray]:
        """By the nearest of pivots that lie far from one another."""
        pivots = [int(rows[away.argmax()])]
        near = self._distances(rows, self.points[pivots[0]])
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < FANOUT and near.max() > 1e-9:
            pivots.append(int(rows[near.argmax()]))
            d = self._distances(rows, self.points[pivots[-1]])
            closer = d < near
            owner[closer] = len(pivots) - 1
            near = np.where(closer, d, near)
        return [rows[owner == k] for k in range(len(pivots)) if (owner == k).any()]

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first."""
        floats = query.astype(np.float64)
        point = np.append(floats, 0.0)
        length = int(query @ query)
        base = length + self.top
        # no sum of products of whole numbers goes beyond half of base: doubles are exact up to 2**53
        vectors, asked = (self.floats, floats) if base < 1 << 53 else (self.whole, query)
        centre, radius, away, span, below, near = (self.arrays[n] for n in ("centre", "radius", "away", "span", "below", "near"))
        best: list[tuple[int, int]] = []  # (score, -id), the worst on top
        bound = np.inf
        queue: list[tuple[float, int, float]] = [(0.0, 0, float(np.sqrt(((centre[0] - point) ** 2).sum())))]
        while queue:
            least, node, distance = heapq.heappop(queue)
            if least > bound:
                break
            (a, b), (c, d) = span[node], below[node]
            if c == d:  # a page of vectors
                if bound < np.inf:
                    low, high = (int(x) for x in np.searchsorted(near[a:b], [distance - bound, distance + bound]))
                    a, b = a + low, min(a + high + 1, b)
                scores = vectors[a:b] @ asked
                good = np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(len(scores))
                for j in good:
                    one = (int(scores[j]), -int(self.ids[a + j]))
                    if -one[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
                if len(best) == k:
                    bound = np.sqrt(max(0, base - 2 * best[0][0])) * (1 + 1e-9) + 1e-6 + 1e-9 * float(np.sqrt(base))
                continue
            live = c + np.flatnonzero(np.abs(distance - away[c:d]) - radius[c:d] <= bound)
            gap = centre[live] - point
            gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            for j, x in zip(live.tolist(), gap.tolist(), strict=True):
                low = max(least, x - radius[j])
                if low <= bound:
                    heapq.heappush(queue, (low, j, x))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v, floor(scale * component) as array<long>, of the rows that take part."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(~odd)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, tree_rows: int = 65536, block_rows: int = 2048) -> DataFrame:
    """query_id, rank from 1, vec_id and score of each query's k best. queries: rows of the same shape.

    tree_rows, block_rows: most vectors of a tree and queries of a block; blocks are smaller where there would be fewer groups than cores.
    """
    found, asked = integer_vectors(rows, id_col, vector_col, scale), integer_vectors(queries, id_col, vector_col, scale)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    trees = max(1, -(-rows.count() // tree_rows))
    n_queries = queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // block_rows), min(-(-cores // trees), n_queries // 64))
    keys = ["tree", F.size("v").alias("size")]

    def matrices(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = group.column("vec_id").to_numpy()
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        return flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64), ids

    def build(group: pa.Table) -> pa.Table:
        arrays = {n: a.astype(ARRAYS[n]).tobytes() for n, a in MTree(*matrices(group)).arrays.items()}
        pages = [(n, at // PAGE_BYTES, a[at : at + PAGE_BYTES]) for n, a in arrays.items() for at in range(0, max(len(a), 1), PAGE_BYTES)]
        name, part, data = (list(x) for x in zip(*pages, strict=True))
        same = lambda c: pa.array([group.column(c)[0].as_py()] * len(pages), pa.int32())
        return pa.table({"tree": same("tree"), "size": same("size"), "name": pa.array(name), "part": pa.array(part, pa.int32()), "data": pa.array(data, pa.binary())})

    def search(pages: pa.Table, group: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if pages.num_rows and group.num_rows:
            parts = sorted(zip(*(pages.column(c).to_pylist() for c in ("name", "part", "data")), strict=True))
            laid = {n: b"".join(d for m, _, d in parts if m == n) for n in ARRAYS}
            tree = MTree.of({n: np.frombuffer(laid[n], t) for n, t in ARRAYS.items()}, group.column("size")[0].as_py())
            for query, own in zip(*matrices(group), strict=True):
                out += [(int(own), i, s) for s, i in tree.search(query, int(own), k)]
        table = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({n: pa.array(table[:, c], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    dealt = found.withColumn("tree", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(trees)).cast("int"))
    pages = written(dealt.select("vec_id", "v", *keys).groupBy("tree", "size").applyInArrow(build, "tree int, size int, name string, part int, data binary"), "mtrees")
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("vec_id", "v", "block", *keys)
    by = ["tree", "block", "size"]
    each = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
