"""Verdicts of op10 on made-up statistics, and its estimates against all subsets."""

import itertools
import math
import random

import numpy as np

from latticut.llm import quality_rules

SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def verdicts(spark, rows):
    """rows: (lang, source, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a thousand words each."""
    stats = spark.createDataFrame([(k, r[0], r[1], 1000, *r[2:], False) for k, r in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.outliers(stats).collect()}
    return [got[k] for k in range(len(rows))]


PLAIN = (5000, 0, 0, 0)


def test_each_statistic_rejects_just_beyond_the_cutoff(spark):
    inside = [(5600, 0, 0, 0), (5000, 28, 0, 0), (5000, 0, 65, 0), (5000, 0, 0, 115)]
    beyond = [(5800, 0, 0, 0), (5000, 32, 0, 0), (5000, 0, 72, 0), (5000, 0, 0, 126)]
    got = verdicts(spark, [("en", "s", *r) for r in [PLAIN] * 100 + inside + beyond])
    assert got == [True] * 104 + [False] * 4


def test_small_groups_are_judged_by_larger_ones(spark):
    odd = (5000, 300, 0, 0)  # more symbols than any
    rows = [("en", "large", *PLAIN)] * 100 + [("en", "small", *PLAIN)] * 9 + [("de", None, *PLAIN)] * 4 + [(None, "x", *PLAIN)]
    got = verdicts(spark, [*rows, ("en", "small", *odd), ("de", None, *odd), (None, "y", *odd)])
    assert got == [True] * len(rows) + [False] * 3


def plain_estimate(x, share, floor):
    """The subset with the least regularised determinant, of all: mean, inverse scatter, determinant."""
    n, p = x.shape
    h = math.ceil(n * share)
    scale = share / quality_rules._chi2(quality_rules._chi2_quantile(share, p), p + 2)
    best = None
    for rows in itertools.combinations(range(n), h):
        part = x[list(rows)]
        cov = np.cov(part.T, bias=True) * scale + np.diag(np.square(floor))
        det = np.linalg.det(cov)
        if best is None or det < best[2]:
            best = (part.mean(axis=0), np.linalg.inv(cov), det)
    return best


def test_estimates_are_those_of_the_best_subset(spark):
    rng = random.Random(9)
    rows, groups, floor = [], {}, (0.03, 0.04, 0.06, 0.08)
    for g in range(4):
        for k in range(11):
            odd = k >= 9
            n = rng.randint(300, 900)
            row = (n, int(n * rng.gauss(5, 0.2) * (1.4 if odd else 1)), int(n * (0.2 if odd else rng.random() * 0.004)), int(n * rng.random() * 0.005), int(n * rng.random() * (0.25 if odd else 0.01)))
            rows.append((len(rows), "en", f"g{g}", *row, False))
            w, q = row[0] + quality_rules.PRIOR, quality_rules.PRIOR * quality_rules.USUAL
            groups.setdefault(g, []).append([math.log((row[1] + q) / w), *(math.sqrt(c / w) for c in row[2:])])
    got = {r["doc_id"]: r for r in quality_rules.outliers(spark.createDataFrame(rows, SCHEMA), min_group=5, bins=1e6, grid=100_000).collect()}
    cutoff, at = quality_rules._chi2_quantile(0.999, 4), 0
    assert abs(cutoff - 18.4668) < 1e-3
    rejected = 0
    for g in range(4):
        x = np.array(groups[g])
        mean, inverse, _ = plain_estimate(x, 0.75, floor)
        for v in x:
            d2 = (v - mean) @ inverse @ (v - mean)
            assert abs(got[at]["d2"] - d2) < 0.01 * d2 + 0.01, (g, at)
            assert got[at]["kept"] == (d2 <= cutoff)
            rejected += d2 > cutoff
            at += 1
    assert rejected >= 8


def test_judge_on_nulls_repeats_and_clashing_names(spark):
    plain = " ".join(f"word{k}" for k in range(40))
    rows = [(1, plain, None, None)] * 3 + [(None, plain, "en", None), (2, None, "en", "s"), (3, "", None, "s"), (4, "a b", "en", "s")]
    docs = spark.createDataFrame([(*r, 5.0, 1.0, "x") for r in rows], "doc_id long, text string, lang string, source string, d2 double, mean_0 double, _level string")
    got = quality_rules.judge(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in got) == [(0, 40, False, True)] + [(1, 40, False, True)] * 3 + [(2, 0, True, False), (3, 0, True, False), (4, 2, True, False)]
