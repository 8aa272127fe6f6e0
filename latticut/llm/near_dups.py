"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles. Sketching throws the whole set into the bins in
rounds, each round by a new hash, and a bin keeps the least value of the first round that reached it;
after as many rounds as bins, round t + j throws everything into bin j, so every bin fills. Equal
sets are one class from the start. Bands of the classes' sketches make candidate buckets; each
bucket's members are verified against one of them, its centre, on their full sets. Members of buckets that
are not all connected then are compared further: all pairs of other components in a bucket of few, and in
larger ones those pairs that share one of the first shingles in one order of all, without which no two sets can be so similar.
So no link is lost because a bucket is large, and large groups don't make all pairs. Components are the
connected classes.

Before full sets are fetched, pairs go that can't be linked: those whose sizes differ too much, and those whose
parity sketches (a bit for each of 1024 hash values, turned by each item) differ in more bits than linked sets have
different items. Both tests are exact. What may be missed is a pair that no band brings together; rows a band are
chosen so that this has a probability below MISSED for a pair at the threshold, and less above.

Null and empty texts, and texts without words, have an empty set and are linked with nothing, nor with each other. A
text of fewer words than a shingle has one shingle, the whole sequence. Texts of any length are read whole. Rows that
repeat a doc_id stay rows of their own, each with the component of its text; a null doc_id is no component's
smallest, unless there is no other. Columns besides the id and the text are left out, unless named in keep, so
names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BASE, Rolling, byte_view, checkpointed, handed_back, lowered, mixed, ragged, small_batches, text_column, thrifty, words_of, written
from .skew import MOST_HOT, attached, salted

BINS = 120
#: Highest probability that a pair at the threshold shares no band.
MISSED = 1e-6
#: Bits of a parity sketch, in words of 64.
PARITY = 16
#: Pairs are made of sets in a bucket of FEW at most, or that share an item which FEW of them have at most. Sets with a more frequent item
#: are compared in blocks of BLOCK sets with BLOCK_ITEMS items in all at most, as much as a task can hold, since
#: sets are sent as often as there are blocks; no pairs but links are made. Both ways find the same links.
FEW, BLOCK, BLOCK_ITEMS = 24, 1024, 1 << 20
#: Items that a block is compared by at once.
COLUMNS = 1024


def band_rows(inter: int, union: int) -> int:
    """Bins a band: as many as miss a pair at the threshold with a probability of MISSED at most."""
    s = inter / union
    return next((r for r in (6, 5, 4, 3, 2) if (1 - s**r) ** (BINS // r) <= MISSED), 1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row laid end to end, and each row's count."""
    data, offsets = byte_view(column)
    data = lowered(data)
    starts, ends, rows = words_of(data, offsets)
    count = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(count, np.int64)
    words = Rolling(data).slices(starts, ends)
    first = np.searchsorted(rows, np.arange(count + 1))
    n = len(words) - width + 1
    grams = np.full(max(n, 0), np.uint64(width))
    for k in range(width if n > 0 else 0):
        grams = mixed(grams * np.uint64(BASE) + words[k : n + k])
    sets = []
    for r in range(count):
        a, b = first[r], first[r + 1]
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.array([1000 + b - a], np.uint64)
            for k in range(a, b):
                h = mixed(h * np.uint64(BASE) + words[k : k + 1])
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """rows x bins of sketch values; rows with an empty set are all zero."""
    rows = len(counts)
    out = np.full(rows * bins, np.iinfo(np.uint64).max)
    full = np.zeros(rows * bins, bool)
    owner = np.repeat(np.arange(rows), counts)
    elements = flat
    open_rows = counts > 0
    for turn in range(2 * bins):
        keep = open_rows[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
        if not len(elements):
            break
        h = mixed(elements + np.uint64((turn + 1) * BASE % 2**64))
        bin_ = ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if turn < bins else turn - bins
        at = owner * bins + bin_
        empty = ~full[at]
        at, h = at[empty], mixed(h[empty])
        np.minimum.at(out, at, h)
        full[at] = True
        open_rows &= ~full.reshape(rows, bins).all(axis=1)
    out = out.reshape(rows, bins)
    out[counts == 0] = 0
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sums(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums of each row's items, which tell sets apart."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat ^ np.uint64(seed)), dtype=np.uint64)])
        out.append(sums[edges[1:]] - sums[edges[:-1]])
    return out[0], out[1]


def parities(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """rows x PARITY: bit j is whether an odd number of the row's items fall on j."""
    bits = PARITY * 64
    at = np.repeat(np.arange(len(counts)), counts) * bits + (mixed(flat) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(counts) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").astype(np.uint64).reshape(len(counts), PARITY)


def signatures(docs: DataFrame, width: int, a_band: int, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, row (a number of its own) and key (by which its text is found again) of each row; n_shingles, f1 and f2 (the set's 128-bit sum), parity and bands."""
    small_batches(docs.sparkSession)
    text, doc = text_column(docs, text_col), F.col(id_col).cast("long")
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], doc.alias("doc_id"), F.monotonically_increasing_id().alias("row"), _key(doc, text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.field("element", pa.int64()))
        for batch in batches:
            flat, counts = shingle_sets(batch.column(batch.num_columns - 1), width)
            values, n = sketches(flat, counts), BINS // a_band
            bands = np.zeros((len(counts), n), np.uint64)
            for k in range(n):
                h = np.full(len(counts), np.uint64(k + 1))
                for j in range(a_band):
                    h = mixed(h * np.uint64(BASE) + values[:, k * a_band + j])
                bands[:, k] = h
            full = counts > 0
            columns = [pa.array(counts), *[pa.array(_signed(x)) for x in _sums(flat, counts)], ragged(_signed(parities(flat, counts)[full].ravel()), np.where(full, PARITY, 0), pa.int64()), ragged(_signed(bands[full].ravel()), np.where(full, n, 0), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[c.cast(longs) if pa.types.is_list(c.type) else c for c in columns]], names=[f.name for f in schema.fields])

    lists = T.ArrayType(T.LongType())
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "f1", "f2")], T.StructField("parity", lists), T.StructField("bands", lists)])
    return rows.mapInArrow(thrifty(run), schema)


def _key(doc: Column, text: Column) -> Column:
    """By which a row's text is found again: its id, or a hash of the text where that is null."""
    return F.coalesce(doc, F.xxhash64(text))


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node and its full set of hashes, for the wanted nodes (node, key, f1, f2) only."""
    text = text_column(docs, text_col)
    rows = docs.select(_key(F.col(id_col).cast("long"), text).alias("key"), text.alias("text")).join(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = shingle_sets(batch.column(1), width)
            same = np.ones(len(counts), bool)
            for s, column in zip(_sums(flat, counts), (2, 3), strict=True):
                same &= _signed(s) == batch.column(column).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(_signed(flat), counts, pa.int64())], names=["node", "items"]).filter(pa.array(same))

    # rows that repeat a key have their own texts, or the same one again
    return rows.select("node", "text", "f1", "f2").mapInArrow(thrifty(run), "node long, items array<long>").dropDuplicates(["node"])


def _likely(n: str, m: str, p: str, q: str, inter: int, union: int) -> Column:
    """Whether sets of n and m items with parities p and q can be linked."""
    unlike = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    # linked sets have no more items that are in one of them only than this
    return (F.least(n, m) * union >= F.greatest(n, m) * inter) & (unlike * (union + inter) <= (F.col(n) + F.col(m)) * (union - inter))


def _counted(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pairs with the number of those of their key, _m; and the keys with it."""
    counts = written(pairs.groupBy(key).agg(F.count("*").alias("_m")), "counts")
    return attached(pairs, counts, [key], "_m", pairs.count(), "inner"), counts


def _verified(pairs: DataFrame, sets: DataFrame, inter: int, union: int) -> DataFrame:
    """The pairs (a, b) with union * |A and B| >= inter * |A or B| on their full sets. An a may have any number of pairs."""
    counted, counts = _counted(pairs, "a")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")).join(counts, "a")
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = salted(counted.select("a", "b", "_m").join(right, "b"), left, "a", "_m")
    sized = both.select("a", "b", (F.size("items_a") + F.size("items_b")).alias("total"), F.size(F.array_intersect("items_a", "items_b")).alias("shared"))
    return sized.where(union * F.col("shared") >= inter * (F.col("total") - F.col("shared"))).select("a", "b")


def _prefixes(sets: DataFrame, inter: int, union: int, rounds: int = 3) -> DataFrame:
    """For each set (node, n, component, items) so many of its first items that two sets which are linked have one of them in common; a row an item.

    Of a linked pair, each set shares at least inter / union of its items with the other, so among the
    first of all items in any order that is the same for all sets, one more than may be missing, there
    is a common one. Items are in the order of their hashes, but those come last that were first in many sets in an
    earlier round, MOST_HOT at most: so prefixes have few of the items that all of a large group have.
    """
    none = F.array().cast("array<long>")
    sets, last = sets.withColumn("items", F.sort_array("items")), sets.sparkSession.range(1).select(none.alias("last"))
    # the least overlap is ceil(n * inter / union)
    length = (F.col("n") - F.ceil(F.col("n") * inter / union) + 1).cast("int")
    for left in range(rounds, 0, -1):
        # one row with a bounded array
        ordered = F.concat(F.array_except("items", "last"), F.array_intersect("items", "last"))
        found = written(sets.crossJoin(F.broadcast(last)).select("node", "n", "component", F.explode(F.slice(ordered, 1, length)).alias("item")), "prefixes")
        often = found.groupBy("item").agg(F.count("*").alias("count")).where(F.col("count") > FEW).orderBy(F.desc("count"), "item").limit(MOST_HOT // rounds)
        if left == 1 or often.isEmpty():
            return found
        last = last.crossJoin(F.broadcast(often.agg(F.collect_list("item").alias("more")))).select(F.array_union("last", "more").alias("last"))


def _linked_in_blocks(rows: DataFrame, sets: DataFrame, inter: int, union: int) -> DataFrame:
    """Links (a, b) between sets of one item and different components, from rows of item, count, whole (items of all its sets), node, component.

    An item's sets are dealt to blocks, and each two blocks meet in one group, which compares all of
    their pairs and returns only links that connect what is not connected yet.
    """
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("whole") / BLOCK_ITEMS)).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = dealt.select("item", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component").join(sets.select("node", "items"), "node")

    def run(group: pa.Table) -> pa.Table:
        node, own, component = (group.column(c).to_numpy() for c in ("node", "own", "component"))
        items = group.column("items").combine_chunks()
        counts = np.diff(items.offsets.to_numpy())
        _, number = np.unique(items.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), counts)
        shared = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for start in range(0, int(number[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(number, [start, start + COLUMNS])
            part = np.zeros((len(node), COLUMNS), np.float32)
            part[owner[a:b], number[a:b] - start] = 1
            shared += part @ part.T
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out, two = [], own.min() != own.max()
        # row by row, so that no second matrix is made
        for i in range(len(node) - 1):
            after = slice(i + 1, None)
            linked = union * shared[i, after] >= inter * (counts[i] + counts[after] - shared[i, after])
            linked &= component[after] != component[i]
            if two:
                linked &= own[after] != own[i]
            for j in np.flatnonzero(linked) + i + 1:
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        table = np.array(out, np.int64).reshape(-1, 2)
        del shared, number, owner, order
        handed_back()
        return pa.table({"a": pa.array(table[:, 0]), "b": pa.array(table[:, 1])})

    return keyed.select("item", "lo", "hi", "own", "node", "component", "items").groupBy("item", "lo", "hi").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and component, its least reachable node, of every node of an edge (a, b); by label propagation with pointer jumping.

    Neither a node with many edges nor a component with many nodes is one task's: see skew.attached.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    total = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("degree"))
    for _ in range(rounds):
        labels = checkpointed(labels)
        given = labels.select(F.col("node").alias("b"), F.col("component").alias("near"), "degree")
        near = attached(both, given, ["b"], "degree", total, "inner").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = checkpointed(labels.join(near, "node").select("node", F.least("component", "near").alias("next"), "component", "degree"))
        pointing = stepped.groupBy("next").agg(F.count("*").alias("_m"))
        jump = pointing.join(stepped.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        new = attached(stepped, jump, ["next"], "_m", total).select("node", F.coalesce(F.least("next", "far"), "next").alias("next"), "component", "degree")
        new = checkpointed(new)
        changed = new.where(F.col("next") < F.col("component")).limit(1).count()
        labels = new.select("node", F.col("next").alias("component"), "degree")
        if not changed:
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, inter: int = 80, union: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and first of every row, and its columns in keep.

    Rows are linked when union * |intersection| >= inter * |union of sets|; inter / union of 0.8 and more.
    component_id: the smallest id of the component; kept: this is the row's id. first: true for one row of each
    component, of the smallest id, and for every row with an empty set.
    """
    signed = written(signatures(docs, width, band_rows(inter, union), id_col, text_col, keep), "signatures")
    full = signed.where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "key")).alias("least")
    classes = full.groupBy("f1", "f2").agg(least, F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"), F.first("bands").alias("bands"))
    # a class is told by 128 bits, its node in the graph of links by 64 of them
    reps = written(classes.withColumn("node", F.col("f1")), "classes")
    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("_m")).where("_m > 1")
    sized = written(attached(banded, buckets, ["band"], "_m", reps.count() * (BINS // band_rows(inter, union)), "inner"), "buckets")
    # a bucket's centre is the member that meets most others in all of its buckets: what others were copied from, rather than one of the copies
    ranked = sized.join(sized.groupBy("node").agg(F.sum("_m").alias("met")), "node")
    centres = ranked.groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("centre"), F.first("_m").alias("_m"))
    members = written(attached(sized.drop("_m"), centres, ["band"], "_m", sized.count(), "inner"), "members")
    star = written(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "star")
    light = reps.select("node", "n", "parity")
    counted, _ = _counted(star, "a")
    ends = counted.join(light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")
    centres = counted.groupBy("a").agg(F.first("_m").alias("_m")).join(light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a")
    likely = salted(ends, centres, "a", "_m").where(_likely("na", "nb", "pa", "pb", inter, union))
    tried = written(likely.select("a", "b"), "tried")
    wanted = members.select("node").distinct().join(reps.select("node", F.col("least.key").alias("key"), "f1", "f2"), "node")
    sets = written(_sets(docs, wanted, width, id_col, text_col), "sets")
    edges = written(_verified(tried, sets, inter, union), "links")
    labels = components(edges)

    # what buckets hold beyond one component is searched for links across components; centres have been compared with all others
    named = written(members.where("node <> centre").select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "named")
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("_m")).where("lo < hi")
    inside = written(attached(named, split.select("band", "_m"), ["band"], "_m", named.count(), "inner"), "split")
    open_ = inside.where(F.col("_m") > FEW).select("node", "component").distinct().join(light.select("node", "n"), "node")
    prefixes = _prefixes(open_.join(sets, "node"), inter, union)
    by_item = prefixes.groupBy("item").agg(F.count("*").alias("count"), F.sum("n").alias("whole"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
    shared = written(attached(prefixes, by_item, ["item"], "count", prefixes.count(), "inner"), "shared")
    few = shared.where(F.col("count") <= FEW).select("item", "node", "component").unionByName(inside.where(F.col("_m") <= FEW).select(F.col("band").alias("item"), "node", "component"))
    x, y = (few.select("item", *[F.col(c).alias(f"{s}{c}") for c in ("node", "component")]) for s in ("x", "y"))
    across = x.join(y, (x["item"] == y["item"]) & (F.col("xnode") < F.col("ynode")) & (F.col("xcomponent") != F.col("ycomponent")))
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = across.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        across = across.join(light.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("parity").alias(f"p{end}")), end)
    rest = written(across.where(_likely("na", "nb", "pa", "pb", inter, union)).select("a", "b"), "across")
    within = _linked_in_blocks(shared.where(F.col("count") > FEW), sets, inter, union)
    more = written(_verified(rest, sets, inter, union).union(within), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    found = written(reps.select("f1", "f2", "node", "least", "copies").join(labels, "node", "left").select("f1", "f2", "least", "copies", F.coalesce("component", "node").alias("component")), "found")
    smallest = found.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("_m"))
    ids = attached(found.select("f1", "f2", "copies", "component"), smallest, ["component"], "_m", found.count(), "inner")
    ids = written(ids.select("f1", "f2", "copies", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "ids")
    rows = signed.drop("parity", "bands", "key")
    out = attached(rows.where("n_shingles > 0"), ids, ["f1", "f2"], "copies", rows.count(), "inner")
    none = rows.where("n_shingles = 0").withColumns({"copies": F.lit(1).cast("long"), "component_id": F.col("doc_id"), "first_row": F.col("row")})
    both = out.select(*none.columns).unionByName(none)
    return both.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("first_row")).alias("first"), *[F.col(f"k_{c}").alias(c) for c in keep])
