"""Byte-level BPE encoding and decoding by overlapping chunks.

A document is cut into overlapping chunks, which tasks pre-tokenise on their own. A chunk may begin in the middle of
a pre-token, but the pattern looks only forward: from the first boundary that two neighbours share, they agree. So
each two neighbours' boundaries in what they overlap tell where the one takes over from the other, the document is
cut there into pieces, and the pieces are encoded by whatever tasks they are dealt to. A document of one chunk has
no neighbours to stitch: it is one piece, and is encoded where it was read. Where two neighbours share no boundary
(a pre-token is longer than the overlap), one task stitches that document: it pre-tokenises on from the last true
boundary until a later chunk agrees. Decoding lays the bytes of each id end to end.

Null and empty texts have no ids and decode to no bytes. Every input row gives one output row, repeated rows and
null ids too; other columns are left out, so names can't clash; an empty table gives an empty result. Texts of any
length are encoded whole; no task but the last, which has the ids, needs a long document whole.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ragged, small_batches, text_column, written

#: A match that ends nearer than this to the end of a cut chunk may come out otherwise in the whole text.
MARGIN = 4


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def boundaries(text: str, pattern: regex.Pattern, cut: bool) -> list[int]:
    """Where pre-tokens begin, then where the last one ends. cut: the text goes on, so ends near its own end are left out."""
    ends = [0]
    for match in pattern.finditer(text):
        ends.append(match.end())
    if cut:
        while ends and ends[-1] > len(text) - MARGIN:
            ends.pop()
    return ends


def stitch(text: str, chunks: list[tuple[int, list[int]]], pattern: regex.Pattern) -> list[int]:
    """Ends of pieces of the text, all true pre-token boundaries. chunks: start and boundaries of each, in order.

    A piece runs from where a chunk takes over to where the next one does. Where neighbours share
    no boundary, the text is pre-tokenised on from the last true one until a later chunk agrees.
    """
    cuts: list[int] = []
    known = [chunks[0][0] + x for x in chunks[0][1]]
    for start, ends in chunks[1:]:
        # after white space a piece's last match could come out longer than in the whole text
        there = {start + x for x in ends if start + x > 0 and not text[start + x - 1].isspace()}
        meet = next((x for x in known[bisect_left(known, start) :] if x in there), None)
        if meet is None:
            for match in pattern.finditer(text, known[-1]):
                known.append(match.end())
                if known[-1] in there:
                    meet = known[-1]
                if meet is not None or known[-1] >= start + ends[-1]:
                    break
        if meet is not None:
            cuts.append(meet)
            known = [start + x for x in ends[bisect_left(ends, meet - start) :]]
    return sorted({*cuts, len(text)} - {0})


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 8192, overlap: int = 512) -> DataFrame:
    """One row a document: its id and ids array<int>, as whole-text encoding without special tokens gives them."""
    if not MARGIN < overlap < chunk_chars:
        raise ValueError("chunks are longer than what they overlap")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_column(docs, text_col).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, len(text), chunk_chars)
                for a in range(0, len(starts), 64):
                    part = starts[a : a + 64]
                    ends = [at + chunk_chars + overlap for at in part]
                    columns = [[row] * len(part), [doc] * len(part), [at // chunk_chars for at in part], [text[at:end] for at, end in zip(part, ends, strict=True)], [end >= len(text) for end in ends]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["row", "_id", "k", "chunk", "last"])

    def near_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boundaries that a chunk shares out with the one before and with the one after, counted from the text's start."""
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, text, last in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                found, at = boundaries(text, compiled, not last), k * chunk_chars
                # after white space a piece's last match could come out longer than in the whole text
                good = [at + x for x in found if x > 0 and not text[x - 1].isspace() and (x <= overlap or x > chunk_chars)]
                heads.append([x for x in good if x <= at + overlap])
                tails.append([x for x in good if x > at + chunk_chars])
            lists = pa.list_(pa.field("element", pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, lists), pa.array(tails, lists)], names=["row", "k", "head", "tail"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last column's texts, each a piece; the others stay."""
        coder = encoding(ranks, pattern)
        for batch in batches:
            tokens = [coder.encode_to_numpy(t, disallowed_special=()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            flat = np.concatenate(tokens).astype(np.int32) if tokens else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ragged(flat, np.array([len(t) for t in tokens], np.int64), pa.int32())], names=[*batch.schema.names[:-1], "ids"])

    def stitched(group: pa.Table) -> pa.Table:
        compiled = regex.compile(pattern)
        found = sorted(zip(group.column("k").to_pylist(), group.column("chunk").to_pylist(), group.column("last").to_pylist(), strict=True))
        text = "".join(t[:chunk_chars] for _, t, _ in found)
        cuts = stitch(text, [(k * chunk_chars, boundaries(t, compiled, not last)) for k, t, last in found], compiled)
        pieces = [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        return pa.table({"row": pa.array([group.column("row")[0].as_py()] * len(pieces), pa.int64()), "_id": pa.array([group.column("_id")[0].as_py()] * len(pieces), pa.int64()), "k": pa.array(range(len(pieces)), pa.int64()), "piece": pa.array(pieces, pa.string())})

    alone = rows.where(F.length("_text") <= chunk_chars).mapInArrow(encoded, "_id long, ids array<int>")
    long = rows.where(F.length("_text") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "_id", "_text")
    # once written, chunks keep their row's number, whoever reads them again
    chunks = written(long.mapInArrow(split, "row long, _id long, k long, chunk string, last boolean"), "chunks")
    ends = chunks.select("row", "k", "chunk", "last").mapInArrow(near_ends, "row long, k long, head array<long>, tail array<long>")
    order = W.partitionBy("row").orderBy("k")
    meets = ends.select("row", "k", F.array_min(F.array_intersect("head", F.lag("tail").over(order))).alias("start"))
    lost = F.max((F.col("k") > 0) & F.col("start").isNull()).over(W.partitionBy("row"))
    meets = written(meets.select("row", "k", "start", F.lead("start").over(order).alias("end"), lost.alias("lost")), "meets")
    dealt = chunks.join(meets, ["row", "k"])
    begin = F.coalesce(F.col("start") - F.col("k") * chunk_chars, F.lit(0)).cast("int")
    until = F.coalesce(F.col("end") - F.col("k") * chunk_chars, F.length("chunk")).cast("int")
    pieces = dealt.where("not lost").select("row", "_id", "k", F.expr("chunk").substr(begin + 1, until - begin).alias("piece"))
    rest = dealt.where("lost").select("row", "_id", "k", "chunk", "last").groupBy("row").applyInArrow(stitched, "row long, _id long, k long, piece string")
    coded = pieces.unionByName(rest).mapInArrow(encoded, "row long, _id long, k long, ids array<int>")
    joined = coded.groupBy("row").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    whole = joined.select("_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return alone.unionByName(whole).select(F.col("_id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """The rows with decoded binary added: the bytes of their ids, end to end. A null list decodes to no bytes."""
    from pyspark.sql import types as T

    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])
    rows = encoded.select(*[f.name for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_ranks(ranks)
        size = max(table.values()) + 1
        starts, lengths, blob = np.zeros(size, np.int64), np.zeros(size, np.int64), bytearray()
        for token, rank in table.items():
            starts[rank], lengths[rank] = len(blob), len(token)
            blob += token
        blob = np.frombuffer(bytes(blob), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            lens = lengths[ids]
            ends = np.cumsum(lens)
            source = np.repeat(starts[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
            data = blob[source].tobytes()
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            out = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
