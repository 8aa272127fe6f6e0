"""Removal of byte strings that an earlier document has, found by suffix arrays.

Texts are dealt to blocks by a hash of their id. Of the K-byte slices of each window of min_bytes bytes the one with
the least hash is the window's core, so equal windows have equal cores at the same place. Windows in a row that have
the same core make a context: the bytes from the first one's start to the last one's end.

1. Each block sends each core's hash once; those that two documents have come back to the blocks.
2. Each block sends, once for each distinct context of a shared core, its bytes with the smallest and largest
   document id that has it there.
3. A task has all contexts of its cores. Where a core's contexts have several smallest ids, they are laid end to end,
   byte by byte but for the core, which is one symbol, and a suffix array is built by linear grouping. Windows that
   agree are neighbours in it; of each run of neighbours with a whole window in common each gets the smallest id.
4. Blocks get back which windows of each context a smaller id has, and cover their bytes.

Without the first two steps, the suffix arrays would be over all texts; they leave out only windows that no other
document can have. What is sent for a core grows with blocks and distinct contexts, not with copies, so a passage that a
third of all documents have costs each block one row. Suffix arrays are of whole cores up to about BATCH symbols.

Null and empty texts have no bytes. Matches never cross documents, so texts shorter than min_bytes lose nothing, nor
do rows with a null id; rows that repeat an id aren't earlier than one another. Each row gives one row. A text of any
length is read in parts of PART bytes. Columns besides the id and the text are left out unless named in keep, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BASE, Rolling, byte_view, mixed, shuffle_parts, text_column
from .suffixes import suffix_array

#: Bytes of a core.
K = 32
#: Texts are hashed in parts of about so many bytes, to bound a worker's memory.
PART = 1 << 20
#: Symbols of a suffix array, if no core has more; larger ones fall out of the caches.
BATCH = 1 << 14
#: Bits of a hash that are sent besides its bucket. Buckets hold a bounded number of hashes, so two
#: hashes seldom look alike; if they do, they make a candidate more, which the contexts then tell apart.
SENT = np.uint64(39)
NEVER = np.iinfo(np.int64).max
#: Low bits of a window's least key, for the place.
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Cores:
    """Of a part of a block's texts: each core's place, its first and last window's start, its hash and its context's key."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        w = length - K + 1
        self.length, none = length, np.zeros(0, np.int64)
        self.at, self.first, self.last, self.hash, self.key = none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        if len(data) < length:
            return
        rolling = Rolling(data)
        keys = rolling.rough(K)
        # ties go to the place furthest right
        keys &= ~_PLACE
        keys |= _PLACE - np.arange(len(keys), dtype=np.uint64)
        least = _sliding_least(keys, w)
        # windows that cross texts don't count
        sizes = np.diff(offsets)
        inside = np.ones(len(least), bool)
        for end in offsets[1:-1]:
            inside[max(0, end - length + 1) : end] = False
        if (sizes < length).any():
            inside &= ~np.repeat(sizes < length, sizes)[: len(inside)]
        starts = np.flatnonzero(inside)
        if not len(starts):
            return
        least = least[starts]
        # a window's least key has its core's place, so it changes where the core does, or with the text
        fresh = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        self.at, self.first = (_PLACE - (least[fresh] & _PLACE)).astype(np.int64), starts[fresh]
        self.last = starts[np.concatenate([fresh[1:], [len(least)]]) - 1]
        self.hash = rolling.slices(self.at, self.at + K)
        self.key = context_keys(rolling.slices(self.first, self.last + length), self.at - self.first, self.last - self.first)

    def contexts(self, data: np.ndarray, which: np.ndarray) -> np.ndarray:
        """A row each of which: the context's bytes, zeros behind them, then the core's place and the number of windows."""
        wide = 2 * self.length - K
        out = np.zeros((len(which), -(-(wide + 2) // 8) * 8), np.uint8)
        step = np.arange(wide)
        for a in range(0, len(which), 1 << 14):
            part = which[a : a + (1 << 14)]
            index = self.first[part][:, None] + step
            inside = step < (self.last - self.first)[part][:, None] + self.length
            out[a : a + len(part), :wide] = np.where(inside, data[np.minimum(index, len(data) - 1)], 0)
            out[a : a + len(part), wide] = self.at[part] - self.first[part]
            out[a : a + len(part), wide + 1] = self.last[part] - self.first[part] + 1
        return out


def context_keys(of_bytes: np.ndarray, place: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Keys of contexts, from hashes of their bytes, their cores' places and how many windows follow the first."""
    return mixed(of_bytes * np.uint64(BASE) + (place * 256 + more).astype(np.uint64))


def parts_of(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Byte ranges of about PART bytes, and where texts begin and end inside. A longer text is cut; its parts overlap so that each window is in one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, int(np.searchsorted(offsets, offsets[a] + PART, side="right")) - 1)
        if b > a:
            yield int(offsets[a]), int(offsets[b]), offsets[a : b + 1] - offsets[a]
            a = b
            continue
        lo, end = int(offsets[a]), int(offsets[a + 1])
        while lo + length <= end:
            hi = min(end, lo + PART + length - 1)
            yield lo, hi, np.array([0, hi - lo])
            lo += PART
        a += 1


def _split(matrix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, cores' places and numbers of windows of contexts."""
    wide = 2 * length - K
    return matrix[:, :wide], matrix[:, wide].astype(np.int64), matrix[:, wide + 1].astype(np.int64)


def _hashes(matrix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each context's core, and its key."""
    cores, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(matrix), 1 << 13):
        text, place, windows = _split(matrix[a : a + (1 << 13)], length)
        rolling, start = Rolling(np.ascontiguousarray(text).ravel()), np.arange(len(text)) * text.shape[1]
        cores.append(rolling.slices(start + place, start + place + K))
        keys.append(context_keys(rolling.slices(start, start + windows + length - 1), place, windows - 1))
    return np.concatenate(cores), np.concatenate(keys)


def shared_windows(matrix: np.ndarray, cores: np.ndarray, smallest: np.ndarray, length: int) -> np.ndarray:
    """contexts x windows: the smallest id of all contexts that have the window; NEVER where there is no window.

    matrix: distinct contexts, of any cores; smallest: the smallest id that has each.
    """
    _, place, windows = _split(matrix, length)
    out = np.where(np.arange(length - K + 1) < windows[:, None], smallest[:, None], NEVER)
    order = np.argsort(cores, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], cores[order][1:] != cores[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    if not len(order):
        return out
    # contexts whose cores have no other smallest id need no comparing
    unlike = np.minimum.reduceat(smallest[order], first) != np.maximum.reduceat(smallest[order], first)
    sizes = np.diff(np.append(first, len(order)))
    several, group = order[np.repeat(unlike, sizes)], np.repeat(np.cumsum(unlike), sizes)[np.repeat(unlike, sizes)]
    symbols = np.cumsum(windows[several] + length - K + 1)
    a = 0
    while a < len(several):
        # whole cores, one at least
        b = int(np.searchsorted(symbols, (symbols[a - 1] if a else 0) + BATCH, side="right"))
        b = max(int(np.searchsorted(group, group[min(b, len(group) - 1)], side="left")) if b < len(group) else b, int(np.searchsorted(group, group[a], side="right")))
        rows = several[a:b]
        out[rows] = _by_suffixes(matrix[rows], group[a:b] - group[a], smallest[rows], length)
        a = b
    return out


def _by_suffixes(matrix: np.ndarray, core: np.ndarray, smallest: np.ndarray, length: int) -> np.ndarray:
    """shared_windows of some contexts, by the suffix array of their bytes; core: its number.

    A core is one symbol, above all bytes: contexts are compared only with those of the same core. So a window is
    the bytes before its core, the core, and the bytes after it: length - K + 1 symbols.
    """
    text, place, windows = _split(matrix, length)
    n, wide = len(text), text.shape[1]
    ends = windows + length - K  # symbols of each context, without its end
    step = np.arange(wide - K + 2)
    index = step + np.where(step > place[:, None], K - 1, 0)
    laid = np.take_along_axis(text, np.minimum(index, wide - 1), axis=1).astype(np.int32) + 1
    laid[np.arange(n), place] = 257 + core
    laid[step == ends[:, None]] = 0  # the end of a context is below all bytes
    symbols = laid[step <= ends[:, None]]
    starts = np.concatenate([[0], np.cumsum(ends + 1)[:-1]])
    row = np.repeat(np.arange(n), ends + 1)
    offset = np.arange(len(symbols)) - starts[row]
    order = np.array(suffix_array(symbols), np.int64)
    order = order[offset[order] < windows[row[order]]]
    # neighbours with a window in common
    agree = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 14):
        part = symbols[order[a - 1 : a + (1 << 14)][:, None] + np.arange(length - K + 1)]
        agree[a : a + len(part) - 1] = (part[1:] == part[:-1]).all(axis=1)
    runs = np.flatnonzero(~agree)
    low = np.minimum.reduceat(smallest[row[order]], runs)
    out = np.full((n, length - K + 1), NEVER)
    out[row[order], offset[order]] = np.repeat(low, np.diff(np.append(runs, len(order))))
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    return h & ((np.uint64(1) << SENT) - np.uint64(1))


def _five_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), kind) for x in column.to_pylist()]


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = _bucket(h, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(b[part[0]]), part


def _blobs(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, block_bytes: int = 6 << 20, bucket_bytes: int = 12 << 20, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The columns keep (the id, unless given) of every row, and kept (binary; as_text: a string, without characters that were cut), n_bytes, n_removed, n_spans, and the removed spans' starts and ends.

    block_bytes, bucket_bytes: texts a block, and texts whose cores a task compares.
    """
    spark = docs.sparkSession
    length = min_bytes
    if not K < length <= 128:
        raise ValueError(f"min_bytes is from {K + 1} to 128")
    total = docs.select(F.sum(F.octet_length(text_column(docs, text_col)))).first()[0] or 0
    n_blocks = max(shuffle_parts(spark), int(total // block_bytes) + 1)
    n_buckets = max(shuffle_parts(spark), int(total // bucket_bytes) + 1)
    keep = keep or [id_col]
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(id_col).cast("long").alias("_id"), text_column(docs, text_col).alias("_text"))
    # rows without an id are dealt by their text
    blocks = rows.withColumn("block", F.pmod(F.coalesce(F.xxhash64("_id"), F.xxhash64("_text")), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block")

    def texts(group: pa.Table) -> Iterator[tuple[int, np.ndarray, Cores, np.ndarray, np.ndarray]]:
        """Of each part: where it begins, its bytes and cores, which cores are of rows with an id, and their ids."""
        data, offsets = byte_view(group.column("_text"))
        null = group.column("_id").is_null().to_numpy()
        ids = group.column("_id").fill_null(0).to_numpy()
        for lo, hi, offs in parts_of(offsets, length):
            found = Cores(data[lo:hi], offs, length)
            owner = np.searchsorted(offsets, lo + found.at, side="right") - 1
            known = np.flatnonzero(~null[owner])
            yield lo, data[lo:hi], found, known, ids[owner[known]]

    def send_cores(group: pa.Table) -> pa.Table:
        pairs = [np.zeros((2, 0), np.uint64)]
        for _, _, found, known, ids in texts(group):
            pairs.append(np.stack([found.hash[known], ids.view(np.uint64)]))
        h, ids = np.concatenate(pairs, axis=1)
        order = np.argsort(h, kind="stable")
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(h) else np.zeros(0, bool)
        h, out = h[first], {"bucket": [], "block": [], "h": []}
        block = group.column("block")[0].as_py()
        for bucket, part in _by_bucket(h, n_buckets):
            out["bucket"].append(bucket)
            out["block"].append(block)
            out["h"].append(_five_bytes(_short(h[part]) | (several[part].astype(np.uint64) << SENT)))
        return _blobs(out, {"bucket": pa.int32(), "block": pa.int32(), "h": pa.binary()})

    def find_shared(group: pa.Table) -> pa.Table:
        sent = _from_five(b"".join(group.column("h").to_pylist()))
        h, several = _short(sent), (sent >> SENT).astype(np.int64)
        found, at, counts = np.unique(h, return_inverse=True, return_counts=True)
        shared = (counts > 1) | (np.bincount(at, weights=several, minlength=len(found)) > 0)
        mine, out, a = shared[at], {"block": [], "bucket": [], "h": []}, 0
        bucket = group.column("bucket")[0].as_py()
        for block, blob in zip(group.column("block").to_pylist(), group.column("h").to_pylist(), strict=True):
            b = a + len(blob) // 5
            if mine[a:b].any():
                out["block"].append(block)
                out["bucket"].append(bucket)
                out["h"].append(_five_bytes(h[a:b][mine[a:b]]))
            a = b
        return _blobs(out, {"block": pa.int32(), "bucket": pa.int32(), "h": pa.binary()})

    def send_contexts(group: pa.Table, shared: pa.Table) -> pa.Table:
        kinds = {"bucket": pa.int32(), "block": pa.int32(), "low": pa.binary(), "high": pa.binary(), "context": pa.binary()}
        out: dict[str, list] = {k: [] for k in kinds}
        wanted = {bucket: np.sort(_from_five(h)) for bucket, h in zip(shared.column("bucket").to_pylist(), shared.column("h").to_pylist(), strict=True)} if shared.num_rows else {}
        if group.num_rows and len(wanted):
            found: list[tuple] = []
            for _, data, cores, known, ids in texts(group):
                h = cores.hash[known]
                some = np.zeros(len(h), bool)
                for bucket, part in _by_bucket(h, n_buckets):
                    if bucket in wanted:
                        some[part] = np.isin(_short(h[part]), wanted[bucket])
                if some.any():
                    key, one, low, high = _distinct(cores.key[known[some]], np.flatnonzero(some), ids[some], ids[some])
                    found.append((key, h[one], low, high, cores.contexts(data, known[one])))
            if found:
                key, h, low, high, matrix = (np.concatenate(x) for x in zip(*found, strict=True))
                _, one, low, high = _distinct(key, np.arange(len(key)), low, high)
                h, matrix = h[one], matrix[one]
                block = group.column("block")[0].as_py()
                for bucket, part in _by_bucket(h, n_buckets):
                    for k, v in zip(kinds, (bucket, block, _packed(low[part]), _packed(high[part]), _packed(matrix[part])), strict=True):
                        out[k].append(v)
        return _blobs(out, kinds)

    def compare(group: pa.Table) -> pa.Table:
        kinds = {"block": pa.int32(), "context": pa.binary(), "first": pa.binary(), "last": pa.binary(), "low": pa.binary()}
        out: dict[str, list] = {k: [] for k in kinds}
        each = _unpacked(group.column("low"), np.int64)
        low, high = np.concatenate(each), np.concatenate(_unpacked(group.column("high"), np.int64))
        matrix = np.concatenate(_unpacked(group.column("context"), np.uint8)).reshape(len(low), -1)
        h, keys = _hashes(matrix, length)
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        smallest = np.full(len(found), NEVER)
        np.minimum.at(smallest, at, low)
        windows = shared_windows(matrix[first], h[first], smallest, length)
        a = 0
        for block, count in zip(group.column("block").to_pylist(), map(len, each), strict=True):
            b = a + count
            table = np.where(windows[at[a:b]] < high[a:b, None], windows[at[a:b]], NEVER)
            padded = np.full((b - a, table.shape[1] + 2), NEVER)
            padded[:, 1:-1] = table
            change = padded[:, 1:] != padded[:, :-1]
            r, o = np.nonzero(change[:, :-1] & (table < NEVER))
            _, e = np.nonzero(change[:, 1:] & (table < NEVER))
            if len(r):
                for k, v in zip(kinds, (block, keys[a:b][r].tobytes(), _packed(o.astype(np.uint8)), _packed(e.astype(np.uint8)), _packed(table[r, o])), strict=True):
                    out[k].append(v)
            a = b
        return _blobs(out, kinds)

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends")]

    def cover(group: pa.Table, runs: pa.Table) -> pa.Table:
        keys = _joined(runs.column("context"), np.uint64)
        first, last, low = (np.concatenate([np.zeros(0, t), *_unpacked(runs.column(c), t)]) for c, t in (("first", np.uint8), ("last", np.uint8), ("low", np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, first, last, low = keys[order], first[order].astype(np.int64), last[order].astype(np.int64), low[order]
        data, offsets = byte_view(group.column("_text")) if group.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        gone = np.zeros(len(data), bool)
        for lo, part, cores, known, ids in texts(group) if len(keys) and group.num_rows else ():
            a, b = (np.searchsorted(keys, cores.key[known], side=x) for x in ("left", "right"))
            each = np.repeat(np.arange(len(known)), b - a)
            run = np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
            good = low[run] < ids[each]
            start, run = cores.first[known[each[good]]], run[good]
            change = np.bincount(start + first[run], minlength=len(part) + 1) - np.bincount(start + last[run] + length, minlength=len(part) + 1)
            gone[lo : lo + len(part)] |= np.cumsum(change[:-1]) > 0
        kept, numbers, spans = [], [], []
        for x, y in zip(offsets[:-1], offsets[1:], strict=True):
            out = gone[x:y]
            edge = np.diff(np.concatenate([[0], out.view(np.int8), [0]]))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept.append(data[x:y][~out].tobytes() if len(s) else data[x:y].tobytes())
            numbers.append((int(y - x), int((e - s).sum()), len(s)))
            spans.append((s, e))
        lists = lambda k: pa.array([s[k] for s in spans], pa.list_(pa.int64()))
        columns = [group.column(f"k_{c}") for c in keep] + [pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())] + [pa.array([n[k] for n in numbers], pa.int64()) for k in range(3)] + [lists(0), lists(1)]
        return pa.Table.from_arrays(columns, names=[f.name for f in fields])

    sent = blocks.groupBy("block").applyInArrow(send_cores, "bucket int, block int, h binary")
    shared = sent.groupBy("bucket").applyInArrow(find_shared, "block int, bucket int, h binary")
    held = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_contexts, "bucket int, block int, low binary, high binary, context binary")
    runs = held.groupBy("bucket").applyInArrow(compare, "block int, context binary, first binary, last binary, low binary")
    return blocks.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(cover, T.StructType(fields))


def _distinct(key: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """One entry a key, with a row of it, the smallest low and the largest high."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], row[order[first]], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
