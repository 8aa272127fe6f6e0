"""Helpers shared by the corpus operators: input shape, Arrow byte views, shared storage."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space, \t, \n, \v, \f, \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Arrow batches hold at most so many rows and bytes (or one row), so that a batch of long texts fits a worker.

    Plans read this when they run, so it stays set; settings that are lower already stay as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def handed_back() -> None:
    """Gives what this worker has freed back to the system, as idle workers live on beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which memory is handed back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        handed_back()

    return whole


def _deleted_at_end(spark: SparkSession, path: str) -> None:
    """Hadoop deletes the path when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: spark.checkpoint.dir; in local mode, where that is unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='latticut-')}"
            _deleted_at_end(spark, _own[app])
        found = _own[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
        _deleted_at_end(spark, spark.sparkContext.getCheckpointDir())
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table written to the shared folder: lineage ends there. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _deleted_at_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, name: str):
    """The column as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and len+1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = pa.large_binary() if column.type in (pa.binary(), pa.large_binary()) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the row it is in; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    fresh[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, modulo 2**64."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = 1 << max(16, math.ceil(math.log2(n + 1)))
        for key, by in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, by, np.uint64)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Rolling:
    """Hashes of any slices of one byte array, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def rough(self, k: int) -> np.ndarray:
        """Of each k-byte slice a hash that is good in its high bits."""
        n = len(self.sums) - k
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[:n]
        h ^= h >> np.uint64(29)
        h *= MIX1
        return h

    def windows(self, k: int) -> np.ndarray:
        """The hash of each k-byte slice."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n] + np.uint64(k))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and each row's count."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
