"""Training and scoring of text classifiers on Spark tables.

The training rows are a bounded sample of the labelled rows, in equal parts by class, chosen by a hash of the id;
only their feature numbers come to the driver. An id that is labelled more than once counts once, with the least
labels; an id that has several texts counts once, with the first text in order; so a model depends on the tables
alone. Labels that are null or neither 0 nor 1, and those without an id, aren't learnt from. Without any label of one
class, the model is a constant.

Scoring reads every text whole, however long. Null texts count as empty, which have a score too. Each input row gives
one output row, repeated rows and null ids, too; columns besides the id and the text are left out (unless they are
asked for with keep), so names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features, linear
from .base import handed_back, ragged, small_batches, text_column, thrifty

Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def bounded_sample(labels: DataFrame, classes: list[str], max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most max_rows labelled ids, the same number at most for each combination of the 0/1 classes that occurs."""
    each = max(1, max_rows // 2 ** len(classes))
    once = labels.groupBy(id_col).agg(F.min(F.struct(*classes)).alias("_c")).select(id_col, "_c.*")
    parts = []
    for mask in range(2 ** len(classes)):
        wanted = reduce(lambda a, b: a & b, [F.col(c) == (mask >> k & 1) for k, c in enumerate(classes)])
        parts.append(once.where(wanted).orderBy(F.xxhash64(id_col), id_col).limit(each))
    return reduce(DataFrame.unionByName, parts)


def training_rows(docs: DataFrame, sample: DataFrame, classes: list[str], of: Features, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """Feature numbers and classes of the sampled rows, in the order of their ids."""
    small_batches(docs.sparkSession)
    left = docs.select(F.col(id_col).cast("long").alias(id_col), text_column(docs, text_col).alias("text"))
    ids = sample.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("int").alias(c) for c in classes])
    # the sample has max_rows rows at most, so neither it nor what is found grows with the tables
    rows = left.join(F.broadcast(ids), id_col).groupBy(id_col, *classes).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features.distinct(*of(batch.column(len(classes) + 1)), batch.num_rows)
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(classes) + 1], ragged(flat, np.array([len(f) for f in found], np.int64), pa.int32())], names=[id_col, *classes, "features"])

    schema = ", ".join([f"{id_col} long", *[f"{c} int" for c in classes], "features array<int>"])
    got = rows.mapInArrow(thrifty(run), schema).toArrow()
    # the sample has an id once
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    lists = got.column("features").combine_chunks()
    flat, at = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy()
    numbers = [flat[at[k] : at[k + 1]] for k in order]
    found = {c: got.column(c).to_numpy()[order] == 1 for c in classes}
    del got, lists
    handed_back()
    return numbers, found


def score(docs: DataFrame, of: Features, apply: Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]], names: list[str], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (or the columns keep) and a double of each name for every row. apply: from features' rows, numbers and the row count."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    kept = keep or [id_col]
    rows = docs.select(*[F.col(c).cast("long").alias(c) if c == id_col else F.col(c) for c in kept], text_column(docs, text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = apply(*of(batch.column(batch.num_columns - 1)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(g, pa.float64()) for g in got]], names=[f.name for f in schema.fields])

    return rows.mapInArrow(thrifty(run), schema)


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> linear.NbSvm:
    """A model of label = 1, fitted to at most max_rows labelled rows that satisfy where."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    sample = bounded_sample(chosen if where is None else chosen.where(where), [label], max_rows, id_col)
    rows, classes = training_rows(docs, sample, [label], features.quality_features, id_col, text_col)
    return linear.fit(rows, classes[label], features.SIZE)[0]


def quality_scores(docs: DataFrame, model: linear.NbSvm, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score, from 0 to 1: how likely label 1 is."""

    def apply(rows: np.ndarray, numbers: np.ndarray, count: int) -> list[np.ndarray]:
        return [model.probability(features.sums(rows, numbers, count, model.weights)[:, 0] + model.bias)]

    return score(docs, features.quality_features, apply, ["score"], id_col, text_col, keep)


#: Categories of toxicity, in the order of the chain.
CATEGORIES = ("toxic", "severe", "varied")


def kinds(rows: list[np.ndarray], classes: dict[str, np.ndarray], ratio: float = 8.0, least: int = 5) -> dict[str, np.ndarray]:
    """Further categories of training rows, from those that are labelled toxic.

    Marks are features that toxic rows have ratio times as often as others, in least rows or more. A toxic row is
    severe if the share of marks among its features is that of the middle one of all toxic rows that have marks, or
    higher; it is varied if the number of its marks is.
    """
    toxic = classes["toxic"]
    strong = linear.log_count_ratios(rows, toxic, features.SIZE, least=least) >= np.log(ratio)
    count = np.array([strong[r].sum() for r in rows], float)
    share = count / np.array([max(1, len(r)) for r in rows])
    some = toxic & (count > 0)
    above = lambda x: some & (x >= (np.median(x[some]) if some.any() else np.inf))
    return classes | {"severe": above(share), "varied": above(count)}


def toxicity_chain(docs: DataFrame, labels: DataFrame, given: tuple[str, ...] = ("toxic",), derive: Callable[..., dict[str, np.ndarray]] = kinds, where: Column | None = None, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> dict[str, tuple[linear.NbSvm, np.ndarray]]:
    """A model a category, in order. Each sees the earlier categories' probabilities, out of fold on the training rows.

    given: categories that the labels have; derive: adds categories to the training rows'.
    """
    chosen = labels.where(reduce(lambda a, b: a & b, [F.col(c).isin(0, 1) for c in given]) & F.col(id_col).isNotNull())
    sample = bounded_sample(chosen if where is None else chosen.where(where), list(given), max_rows, id_col)
    rows, classes = training_rows(docs, sample, list(given), features.toxic_features, id_col, text_col)
    chain, earlier = {}, np.zeros((len(rows), 0))
    for c, positive in derive(rows, classes).items():
        model, more, unseen = linear.fit(rows, positive, features.SIZE, earlier)
        chain[c] = (model, more)
        earlier = np.column_stack([earlier, unseen])
    return chain


def toxicity_scores(docs: DataFrame, chain: dict[str, tuple[linear.NbSvm, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """p_<category> of every row, each computed from the text and the probabilities before it."""
    weights = np.column_stack([m.weights for m, _ in chain.values()])

    def apply(rows: np.ndarray, numbers: np.ndarray, count: int) -> list[np.ndarray]:
        total = features.sums(rows, numbers, count, weights)
        got: list[np.ndarray] = []
        for k, (model, more) in enumerate(chain.values()):
            margin = total[:, k] + model.bias
            for p, w in zip(got, more, strict=True):
                margin = margin + w * p
            got.append(model.probability(margin))
        return got

    return score(docs, features.toxic_features, apply, [f"p_{c}" for c in chain], id_col, text_col)
