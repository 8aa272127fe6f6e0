"""Numbered n-gram features of texts, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .base import BASE, Rolling, byte_view, lowered, mixed, words_of

#: Features are numbered below 2**BITS.
BITS = 18
SIZE = 1 << BITS


def _codes(data: np.ndarray) -> np.ndarray:
    """Letters by case, digits and bytes beyond ASCII are a class each; other bytes stand for themselves."""
    out = data.astype(np.uint64)
    out[(data >= 97) & (data <= 122)] = 300
    out[(data >= 65) & (data <= 90)] = 301
    out[(data >= 48) & (data <= 57)] = 302
    out[data >= 128] = 303
    return out


def _grams(codes: np.ndarray, rows: np.ndarray, orders: tuple[int, ...], tag: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of runs of codes within a row, and their rows."""
    hashes, owners = [], []
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, np.uint64(tag * 16 + n))
        for k in range(n):
            h = mixed(h * np.uint64(BASE) + codes[k : len(codes) - n + 1 + k])
        same = rows[: len(h)] == rows[n - 1 :]
        hashes.append(h[same])
        owners.append(rows[: len(h)][same])
    return hashes, owners


def quality_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each feature, with repeats: words, and runs of up to 3 word shapes.

    A shape is made of the word's first, last and last but one characters by class, whether it has small
    letters, and whether it repeats the word before.
    """
    data, offsets = byte_view(column)
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = Rolling(lowered(data)).slices(starts, ends)
    classes = _codes(data)
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    again = np.zeros(len(words), np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    has_small = (small[ends] > small[starts]).astype(np.uint64)
    single = (ends - starts == 1).astype(np.uint64)
    before = classes[np.maximum(ends - 2, starts)]
    shape = mixed((((classes[starts] * np.uint64(512) + classes[ends - 1]) * np.uint64(512) + before) * np.uint64(8)) + again * np.uint64(4) + has_small * np.uint64(2) + single)
    hashes, owners = _grams(shape, rows, (1, 2, 3), 1)
    more, of = _grams(words, rows, (1,), 2)
    return np.concatenate(owners + of), (np.concatenate(hashes + more) >> np.uint64(64 - BITS)).astype(np.int64)


def toxic_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each feature, with repeats: lower-cased words, their heads of 4, 5 and 6 bytes, and pairs of words."""
    data, offsets = byte_view(column)
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = lowered(data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    # punctuation around a word is not part of it
    index = np.arange(len(data))
    first = np.minimum.accumulate(np.where(letter, index, len(data))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(letter, index, -1))
    starts, ends = first[starts], last[ends - 1] + 1
    good = starts < ends
    starts, ends, rows = starts[good], ends[good], rows[good]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = Rolling(data)
    words = rolling.slices(starts, ends)
    hashes, owners = _grams(words, rows, (1, 2), 3)
    for n in (4, 5, 6):
        long = ends - starts > n
        h = mixed(rolling.slices(starts[long], starts[long] + n) + np.uint64(n))
        hashes.append(h)
        owners.append(rows[long])
    return np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(rows: np.ndarray, numbers: np.ndarray, count: int) -> list[np.ndarray]:
    """Each row's sorted distinct feature numbers."""
    keys = np.unique(rows * SIZE + numbers)
    cuts = np.searchsorted(keys, np.arange(1, count) * SIZE) if count > 1 else []
    return [part % SIZE for part in np.split(keys, cuts)] if count else []


def sums(rows: np.ndarray, numbers: np.ndarray, count: int, weights: np.ndarray) -> np.ndarray:
    """Each row's sum of weights over its distinct features. weights: SIZE, or SIZE x k."""
    table = weights.reshape(SIZE, -1)
    live = (table != 0).any(axis=1)[numbers]
    keys = np.unique(rows[live] * SIZE + numbers[live])
    out = np.zeros((count, table.shape[1]))
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(keys // SIZE, weights=table[keys % SIZE, k], minlength=count)
    return out
