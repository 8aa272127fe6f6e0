"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to shards by a hash; in a shard they are taken by length, longest first. Bins are ordered by what
is left of their capacity, and each carries bitmaps of the sources and duplicate clusters inside. A document goes to
the tightest bin that holds it and conflicts with nothing: the search starts at the first bin with enough room and
goes on to successors until a bin is compatible; only if none is does a new bin open. A bin holds one document of a
duplicate cluster, and at most per_source of a source, so no source fills a sequence.

A document longer than the capacity is cut into pieces of the capacity, each a bin of its own, and a
last piece that is packed like any document. Null and empty texts have length 0 and are packed, too;
a null source is a source of its own, a null id is an id like others. Every input row has its pieces in the output:
rows that agree in id, length, source and cluster are counted first and dealt to all shards, so no number of repeats
fills one. Ties in length are taken in the order of ids, null ids last, then by source, cluster and copy; ties in room
go to the bin that was opened first. Other columns are left out, so names can't clash; an empty table gives an empty
result. Lengths count words of whole texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import shuffle_parts, text_column

#: Copies that are numbered together.
COPIES = 1 << 16
WORD_GAP = "[\\x20\\x09-\\x0D]+"


class Bins:
    """Open bins, ordered by (room, number)."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        #: a bit a cluster; for each of per_source levels, a bit a source that has as many documents inside
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.having: Counter[int] = Counter()

    def open(self, length: int, source: int, cluster: int) -> int:
        number = len(self.clusters)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self._add(number, self.capacity - length, source, cluster)
        return number

    def _add(self, number: int, room: int, source: int, cluster: int) -> None:
        self.clusters[number] |= 1 << cluster
        levels = self.sources[number]
        for k in range(self.per_source):
            if not levels[k] >> source & 1:
                levels[k] |= 1 << source
                break
        if room > 0:
            insort(self.order, (room, number))
        # bins in order that have the cluster, so that a search in vain needn't be made
        self.having[cluster] += room > 0

    def place(self, length: int, source: int, cluster: int) -> int:
        if self.having[cluster] < len(self.order):
            for k in range(bisect_left(self.order, (length, -1)), len(self.order)):
                room, number = self.order[k]
                if not (self.clusters[number] >> cluster & 1 or self.sources[number][-1] >> source & 1):
                    del self.order[k]
                    if room == length:
                        self._closed(number)
                    self._add(number, room - length, source, cluster)
                    return number
        return self.open(length, source, cluster)

    def _closed(self, number: int) -> None:
        bits = self.clusters[number]
        while bits:
            low = bits & -bits
            self.having[low.bit_length() - 1] -= 1
            bits ^= low


def pack_shard(lengths: list[int], sources: list, clusters: list, ids: list, capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """(row, piece, offset, length, bin) of every piece, in the order of packing."""
    numbers: dict = {}
    source_bit = [numbers.setdefault(s, len(numbers)) for s in sources]
    groups: dict = {}
    cluster_bit = [groups.setdefault(c, len(groups)) for c in clusters]
    order = sorted(range(len(lengths)), key=lambda k: (-(lengths[k] % capacity or min(lengths[k], capacity)), -lengths[k], ids[k] is None, ids[k] or 0, sources[k] or "", clusters[k], k))
    bins, out = Bins(capacity, per_source), []
    for k in order:
        left, piece, offset = lengths[k], 0, 0
        while left > capacity:
            out.append((k, piece, offset, capacity, bins.open(capacity, source_bit[k], cluster_bit[k])))
            left, piece, offset = left - capacity, piece + 1, offset + capacity
        out.append((k, piece, offset, left, bins.place(left, source_bit[k], cluster_bit[k])))
    return out


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != ""))


def cluster_of(text: Column) -> Column:
    """Exact copies but for case and white space are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), WORD_GAP, " ")))


def similar_cluster(text: Column, width: int = 5) -> Column:
    """Texts with the same least hash of their shingles (runs of width words) are one cluster; those without a shingle by their words."""
    hashed = F.transform(F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != ""), lambda w: F.xxhash64(w))

    def least(h: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, F.array_min(shingles)).otherwise(F.xxhash64(h))

    return F.transform(F.array(hashed), least)[0]


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, shard_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """doc id, piece, offset, length (in words, unless given), bin_id, shard and n_words of the whole of every piece.

    bin_id is unique over all shards. Shards have about shard_rows rows each, however many rows there are.
    """
    text = text_column(docs, text_col)
    shards = F.lit(max(1, -(-docs.count() // shard_rows)))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(source_col).cast("string").alias("source"), (words_in(text) if length is None else length).cast("long").alias("length"), (cluster_of(text) if cluster is None else cluster).cast("long").alias("cluster"))
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    # copies are numbered in two steps, so that not even all rows alike are numbered by one task
    runs = same.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES).cast("long")))).repartition(shuffle_parts(docs.sparkSession), *rows.columns, "_run")
    copies = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * COPIES, F.least(F.col("_n"), (F.col("_run") + 1) * COPIES) - 1)))
    rows = copies.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns, "_copy"), shards).alias("shard"))
    names = [id_col, "piece", "offset", "length", "n_words", "bin_id", "shard"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(group: pa.Table) -> pa.Table:
        ids, lengths = group.column(id_col).to_pylist(), group.column("length").to_pylist()
        sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
        packed = pack_shard(lengths, sources, clusters, ids, capacity, per_source)
        shard = group.column("shard")[0].as_py()
        table = np.array(packed, np.int64).reshape(-1, 5)
        columns = [pa.array([ids[k] for k in table[:, 0]], pa.int64()), table[:, 1], table[:, 2], table[:, 3], np.array(lengths, np.int64)[table[:, 0]], (shard << 32) + table[:, 4], np.full(len(table), shard)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.groupBy("shard").applyInArrow(run, f"{id_col} long, piece int, offset long, length long, n_words long, bin_id long, shard long")
