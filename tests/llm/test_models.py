"""Exact search against brute force, and classifiers by held-out accuracy."""

import random

import numpy as np

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticut.llm import classify, features, linear, mtree


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(1000 + k, [0.5] * 6) for k in range(250)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = {}
    for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), tree_rows=200, block_rows=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    clean = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows if i < 2000}
    want = {}
    for q in clean:
        if q % 50 == 0:
            best = sorted(((-int(clean[q] @ clean[c]), c) for c in clean if c != q))[:5]
            want[q] = {k + 1: (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want


def test_top_k_without_rows_and_with_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, tree string, size string, v string, block string"
    assert mtree.top_k(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [1.0]), (3, []), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = mtree.top_k(df.selectExpr("*", "'x' AS tree", "'x' AS size", "'x' AS v", "'x' AS block"), df.where("vec_id = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 32768), (0, 2, 1, 32768)]


def _labelled(spark, n=400):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(n):
        words, poor, toxic = [word() for _ in range(40)], k % 4 == 0, k % 3 == 0
        if poor:
            words = [w + "***" for w in words]
        if toxic:
            words[rng.randrange(40)] = "vileword"
            words[rng.randrange(40)] = "vileword"
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(not poor), int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 1, "", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_is_learnt(spark):
    docs, labels = _labelled(spark)
    model = classify.quality_model(docs, labels.where("doc_id % 2 = 0"), max_rows=300)
    got = classify.quality_scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    held = [r for r in labels.collect() if r["doc_id"] % 2]
    assert sum((score[r["doc_id"]] >= 0.7) == (r["quality"] == 1) for r in held) >= 0.95 * len(held)


def test_chain_is_learnt(spark):
    docs, labels = _labelled(spark)
    chain = classify.toxicity_chain(docs, labels, where=F.expr("doc_id % 2 = 0"), max_rows=400)
    assert tuple(chain) == classify.CATEGORIES and [len(more) for _, more in chain.values()] == [0, 1, 2]
    rows = classify.toxicity_scores(docs, chain).collect()
    got = {r["doc_id"]: r for r in rows}
    held = [r for r in labels.collect() if r["doc_id"] % 2]
    assert len(rows) == docs.count() and sum((got[r["doc_id"]]["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in held) >= 0.9 * len(held)
    # a score is the chain, worked by hand
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc in (1, 3):
        (mine,) = features.distinct(*features.toxic_features(pa.array([texts[doc]])), 1)
        earlier = []
        for name, (model, more) in chain.items():
            margin = model.margin(mine) + sum(w * p for w, p in zip(more, earlier))
            earlier.append(1 / (1 + np.exp(-(model.slope * margin + model.offset))))
            assert got[doc][f"p_{name}"] == pytest.approx(earlier[-1], abs=1e-9)


def test_kinds():
    rows = [np.array([1, 2, k + 10]) for k in range(20)] + [np.array([1, 3, 4, 5, k + 10]) for k in range(10)] + [np.array([1, 3, k + 40]) for k in range(10)]
    toxic = np.array([False] * 20 + [True] * 20)
    got = classify.kinds(rows, {"toxic": toxic})
    # marks: 3 in all toxic rows, 4 and 5 in ten
    assert got["varied"].tolist() == [False] * 20 + [True] * 10 + [False] * 10
    assert got["severe"].tolist() == [False] * 20 + [True] * 10 + [False] * 10
    none = classify.kinds(rows, {"toxic": np.zeros(40, bool)})
    assert not none["severe"].any() and not none["varied"].any()


def test_ratios_by_counting():
    rows, positive = [np.array([0, 1]), np.array([0]), np.array([0, 2]), np.array([1, 2])], np.array([True, True, False, False])
    got = linear.log_count_ratios(rows, positive, 4, alpha=1.0, least=1)
    assert got == pytest.approx([np.log((3 / 4) / (2 / 4)), np.log((2 / 4) / (2 / 4)), np.log((1 / 4) / (3 / 4)), 0.0])
    assert linear.log_count_ratios(rows, positive, 4, least=3).tolist() == [got[0], 0, 0, 0]


def test_descent_closes_the_duality_gap():
    rng = np.random.default_rng(3)
    dense = (rng.random((60, 12)) < 0.4).astype(float) * rng.normal(size=12)
    positive = dense @ rng.normal(size=12) + 0.3 * rng.normal(size=60) > 0
    rows = [np.flatnonzero(x) for x in dense]
    w, bias = linear.dual_descent(rows, [x[r] for x, r in zip(dense, rows)], positive, 12, passes=3000)
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, 60 / (2 * positive.sum()), 60 / (2 * (~positive).sum()))
    full = np.column_stack([dense, np.ones(60)])
    objective = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (full @ v))).sum()
    # projected gradient on the dual, far slower
    gram, a = (full * y[:, None]) @ (full * y[:, None]).T, np.zeros(60)
    for _ in range(60_000):
        a = np.clip(a - (gram @ a - 1) / np.linalg.norm(gram, 2), 0, cost)
    dual = a.sum() - 0.5 * a @ gram @ a
    assert dual - 1e-3 <= objective(np.append(w, bias)) <= dual + 0.02 * abs(dual)


def plain_shape(word, before):
    kind = lambda b: 300 if 97 <= b <= 122 else 301 if 65 <= b <= 90 else 302 if 48 <= b <= 57 else 303 if b >= 128 else b
    w = word.encode()
    return kind(w[0]), kind(w[-1]), kind(w[max(len(w) - 2, 0)]), word.lower() == before, any(97 <= b <= 122 for b in w), len(w) == 1


def test_quality_features_are_words_and_shapes():
    texts = ["The cat the Cat sat, ok.", "", None, "A 1 é é É!", "the cat"]
    numbers = {}
    for t in texts:
        words = (t or "").split()
        shapes = [plain_shape(w, words[k - 1].lower() if k else None) for k, w in enumerate(words)]
        want = {("w", "".join(c.lower() if c.isascii() else c for c in w)) for w in words} | {(n, *shapes[k : k + n]) for n in (1, 2, 3) for k in range(len(shapes) - n + 1)}
        (got,) = features.distinct(*features.quality_features(pa.array([t])), 1)
        assert len(got) == len(want), t
        numbers[t] = set(got.tolist())
    assert len(numbers["the cat"] & numbers["The cat the Cat sat, ok."]) >= 2


def test_labels_and_texts_that_repeat(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    sample = classify.bounded_sample(labels.where("doc_id is not null"), ["quality"], 10)
    assert sorted(map(tuple, sample.collect())) == [(1, 0), (2, 1), (3, 1)]
    rows, classes = classify.training_rows(docs, sample, ["quality"], features.quality_features)
    (want,) = features.distinct(*features.quality_features(pa.array(["a"])), 1)
    assert rows[0].tolist() == want.tolist() and len(rows[1]) == 0 and classes["quality"].tolist() == [False, True]
    empty = classify.quality_scores(docs.limit(0), classify.quality_model(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0 and classify.toxicity_scores(docs, classify.toxicity_chain(docs.limit(0), labels.selectExpr("doc_id", "quality AS toxic").limit(0))).count() == 4


def test_tree_of_copies_outliers_and_large_numbers():
    rng = np.random.default_rng(4)
    for scale in (1, 1 << 27):
        copies = np.tile(rng.integers(-3, 4, 4), (1500, 1))
        far = np.outer(1 << np.arange(20), [1, 0, 0, 0])
        vectors = np.concatenate([copies, far, rng.integers(-3, 4, (700, 4))]) * scale
        ids = rng.permutation(len(vectors))
        tree = mtree.MTree(vectors, ids)
        for k in (0, 1, 1501, 1519, 1600, 2000):
            scores = [(-sum(int(a) * int(b) for a, b in zip(vectors[k], v)), int(i)) for v, i in zip(vectors, ids) if i != ids[k]]
            if all(abs(s) < 1 << 63 for s, _ in scores):
                assert tree.search(vectors[k], int(ids[k]), 5) == [(-s, i) for s, i in sorted(scores)[:5]]
