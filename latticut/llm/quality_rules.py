"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each document gets base statistics; documents that fail the base limits go. The others' statistics are
transformed, and per language and source a minimum-covariance-determinant estimate of centre and scatter
is found: from three starts (medians and absolute deviations; these with correlations of squashed values;
plain mean and covariance), concentration steps refit mean and covariance to the share of rows nearest by
Mahalanobis distance until the determinant falls no more; the start with the least determinant counts. The
squares of floors are added to the variances throughout, so that statistics that hardly vary reject nobody.
A document beyond a quantile of chi-square is rejected.

Estimates are fitted to counts of rows in the cells of a fine grid over the statistics, made once. So a
concentration step costs what the cells cost, not the rows, and a hot group shuffles only counts; every row
counts in every step. Verdicts use each row's own values.

Null and empty texts have no words and fail the base limits, whatever their other columns hold. A null
language or source is a group of its own. Rows of groups with fewer than min_group rows that pass the base
limits are judged by the estimate of all rows of their language, and where these are too few, too, by that of
the whole table. Repeated rows and ids are judged row by row, each counts; an empty table gives an empty
result. Very long texts are read whole. Columns of docs that have the names of results are left out, unless
they are renamed before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import text_column, written

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words that are added to each document before rates are taken, and their length.
PRIOR, USUAL = 20, 5
FEATURES = ("f_word_chars", "f_symbols", "f_dup_lines", "f_repeats")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more."""
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    hashes = F.when(n >= window, _let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(F.array().cast("array<long>"))

    def covered(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return _let(_let(ordered, positions), total)

    return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = 8) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed of each row."""
    text = text_column(docs, text_col)
    base = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, text.alias("_text"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"), _repeat_words(words, window).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    t = F.col("_text")
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    out = base.select(id_col, *keep, _let(words, of_words).alias("_w"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), _let(lines, of_lines).alias("n_dup_lines"))
    n, r = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return out.select(id_col, *keep, n.alias("n_words"), F.col("_w.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 20) | (100 * r > 30 * n)).alias("base_failed"))


def _features() -> list[Column]:
    """Statistics on scales where ordinary documents spread evenly. PRIOR words of usual length without faults are added to each document, as rates of short ones vary more."""
    n = F.col("n_words").cast("double") + PRIOR
    rate = lambda c: F.sqrt(F.col(c) / n)
    return [F.log((F.col("word_chars") + PRIOR * USUAL) / n).alias(FEATURES[0]), rate("n_symbols").alias(FEATURES[1]), rate("n_dup_lines").alias(FEATURES[2]), rate("n_repeat_words").alias(FEATURES[3])]


def _determinant(cells: list[list[str]]) -> str:
    if len(cells) == 1:
        return cells[0][0]
    return "(" + " ".join(f"{'-+'[k % 2 == 0]} {head} * {_determinant([row[:k] + row[k + 1 :] for row in cells[1:]])}" for k, head in enumerate(cells[0])) + ")"


def _precision(model: DataFrame, kept: list[str], floor: tuple[float, ...]) -> DataFrame:
    """The kept columns and _m: the upper triangle of the covariance's inverse by cofactors, floors' squares added to the variances."""
    p = len(FEATURES)
    for i in range(p):
        model = model.withColumn(f"cov_{i}_{i}", F.coalesce(f"cov_{i}_{i}", F.lit(0.0)) + floor[i] ** 2)
    c = [[f"cov_{min(i, j)}_{max(i, j)}" for j in range(p)] for i in range(p)]
    minor = lambda i, j: _determinant([[c[a][b] for b in range(p) if b != j] for a in range(p) if a != i])
    cells = ", ".join(f"{'-+'[(i + j) % 2 == 0]} {minor(i, j)}" for i in range(p) for j in range(i, p))
    found = model.select(*kept, F.expr(f"array({cells})").alias("_cofactors"), F.expr(_determinant(c)).alias("_det"))
    return found.select(*kept, "_det", F.transform("_cofactors", lambda x: x / F.col("_det")).alias("_m"))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds _d2, the squared Mahalanobis distance by the columns mean_i and _m."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    terms = [f"{1 if i == j else 2} * get(_m, {at}) * ({FEATURES[i]} - mean_{i}) * ({FEATURES[j]} - mean_{j})" for at, (i, j) in enumerate(pairs)]
    return rows.withColumn("_d2", F.expr(f"greatest({' + '.join(terms)}, 0D)"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _moments(rows: DataFrame, groups: list[str], scale: float, values: tuple[str, ...] = FEATURES, weight: str = "_w") -> DataFrame:
    """Weighted means and covariances, the latter times scale."""
    total = F.sum(weight)
    mean = {i: F.sum(F.col(weight) * F.col(v)) / total for i, v in enumerate(values)}
    cells = [((F.sum(F.col(weight) * F.col(values[i]) * F.col(values[j])) / total - mean[i] * mean[j]) * scale).alias(f"cov_{i}_{j}") for i, j in _pairs()]
    return rows.groupBy(*groups).agg(total.alias("_n"), *[m.alias(f"mean_{i}") for i, m in mean.items()], *cells)


def _with(rows: DataFrame, model: DataFrame, groups: list[str], how: str = "left") -> DataFrame:
    right = model.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *[c for c in model.columns if c not in groups])
    on = [rows[g].eqNullSafe(right[f"_g_{g}"]) for g in groups]
    return rows.join(right, on, how).drop(*[f"_g_{g}" for g in groups])


def _cells(fit: DataFrame, by: list[str], floor: tuple[float, ...], grid: int) -> DataFrame:
    """Rows counted by group and cell of a grid; a cell is grid times finer than a floor. _w: rows inside."""
    at = [F.round(F.col(f) / (floor[i] / grid)).cast("long").alias(f"_c{i}") for i, f in enumerate(FEATURES)]
    return fit.select(*by, *at).groupBy(*by, *[f"_c{i}" for i in range(len(FEATURES))]).agg(F.count("*").alias("_w"))


def _starts(cells: DataFrame, groups: list[str], floor: tuple[float, ...], grid: int) -> DataFrame:
    """Three estimates of each group: _start, mean_i, cov_i_j and _n."""
    p = range(len(FEATURES))
    keep, parts = [*groups, "_n"], [f"mean_{i}" for i in p]
    middle = cells.groupBy(*groups).agg(F.sum("_w").alias("_n"), *[(F.percentile(f"_c{i}", F.lit(0.5), F.col("_w")) * (floor[i] / grid)).alias(f"mean_{i}") for i in p])
    near = _with(cells, middle, groups)
    away = [F.percentile(F.abs(F.col(f) - F.col(f"mean_{i}")), F.lit(0.5), F.col("_w")) for i, f in enumerate(FEATURES)]
    spread = near.groupBy(*keep, *parts).agg(*[F.greatest(1.4826 * a, F.lit(floor[i])).alias(f"_s{i}") for i, a in enumerate(away)])
    plain = spread.select(*keep, *parts, *[(F.col(f"_s{i}") * F.col(f"_s{i}") if i == j else F.lit(0.0)).alias(f"cov_{i}_{j}") for i, j in _pairs()], F.lit(0).alias("_start"))
    squashed = _with(cells, spread, groups).select(*groups, "_w", *[F.tanh((F.col(f) - F.col(f"mean_{i}")) / F.col(f"_s{i}")).alias(f"_y{i}") for i, f in enumerate(FEATURES)])
    of = _moments(squashed, groups, 1.0, tuple(f"_y{i}" for i in p)).select(*groups, *[f"cov_{i}_{j}" for i, j in _pairs()])
    both = _with(spread, of, groups)
    # no value varies in place of a correlation: 0
    ties = lambda i, j: F.coalesce(F.col(f"cov_{i}_{j}") / F.nullif(F.sqrt(F.col(f"cov_{i}_{i}") * F.col(f"cov_{j}_{j}")), F.lit(0.0)), F.lit(0.0))
    tied = both.select(*keep, *parts, *[(F.col(f"_s{i}") * F.col(f"_s{j}") * (F.lit(1.0) if i == j else ties(i, j))).alias(f"cov_{i}_{j}") for i, j in _pairs()], F.lit(1).alias("_start"))
    return plain.unionByName(tied).unionByName(_moments(cells, groups, 1.0).withColumn("_start", F.lit(2)))


def estimates(cells: DataFrame, groups: list[str], share: float, tolerance: float, floor: tuple[float, ...], bins: float, grid: int) -> DataFrame:
    """Each group's centre (mean_i), inverse scatter (_m, upper triangle) and determinant (_det), from cells with weights _w."""
    p = len(FEATURES)
    parts, by = [f"mean_{i}" for i in range(p)], [*groups, "_start"]
    # a normal cloud's inner share has a smaller spread than the whole: the covariance is scaled back
    scale = share / _chi2(_chi2_quantile(share, p), p + 2)
    cells = cells.select(*groups, "_w", *[f"_c{i}" for i in range(p)], *[(F.col(f"_c{i}") * (floor[i] / grid)).alias(f) for i, f in enumerate(FEATURES)])
    first = _precision(_starts(cells, groups, floor, grid), [*by, "_n", *parts], floor)
    best = written(first.withColumn("_det", F.lit(math.inf)).withColumn("_fell", F.lit(True)), "mcd-model")
    while not best.where("_fell").isEmpty():
        found = _distance(_with(cells, best.where("_fell").drop("_det", "_fell"), groups, "inner")).withColumn("_bin", F.floor(F.log1p("_d2") * bins).cast("long"))
        counts = found.groupBy(*by, "_n", "_bin").agg(F.sum("_w").alias("_c"))
        upto = counts.withColumn("_sum", F.sum("_c").over(W.partitionBy(*by).orderBy("_bin")))
        enough = F.ceil(F.col("_n") * share)
        # of the last bin's rows just so many count that the share is met
        limit = upto.where((F.col("_sum") >= enough) & (F.col("_sum") - F.col("_c") < enough)).select(*by, F.col("_bin").alias("_limit"), ((enough - F.col("_sum") + F.col("_c")) / F.col("_c")).alias("_part"))
        inner = _with(found.drop("_n", "_m", *parts), limit, by).where(F.col("_bin") <= F.col("_limit"))
        inner = inner.withColumn("_w", F.when(F.col("_bin") == F.col("_limit"), F.col("_w") * F.col("_part")).otherwise(F.col("_w").cast("double")))
        model = _precision(_moments(inner, by, scale), [*by, *parts], floor)
        # a start whose determinant doesn't fall any more keeps the estimate that it has, so this ends
        both = _with(best, model.select(*by, *[F.col(c).alias(f"_new{c}") for c in (*parts, "_m", "_det")]), by)
        fell = F.coalesce(F.col("_new_det") < F.col("_det") * (1 - tolerance), F.lit(False))
        best = written(both.select(*by, "_n", *[F.when(fell, F.col(f"_new{c}")).otherwise(F.col(c)).alias(c) for c in (*parts, "_m", "_det")], fell.alias("_fell")), "mcd-model")
    least = best.groupBy(*groups).agg(F.min(F.struct("_det", "_start", *parts, "_m")).alias("b"))
    return least.select(*groups, *[F.col(f"b.{c}").alias(c) for c in (*parts, "_m", "_det")])


def fitted(stats: DataFrame, groups: tuple[str, ...] = ("lang", "source"), share: float = 0.75, tolerance: float = 0.001, min_group: int = 50, floor: tuple[float, ...] = (0.03, 0.04, 0.06, 0.08), bins: float = 32.0, grid: int = 8) -> DataFrame:
    """Each group's robust estimate: its centre and inverse scatter.

    share: of a group's rows that the estimate is fitted to; tolerance: concentration steps go on while a
    group's determinant falls by more than this share; min_group: least rows of a group with an estimate of its own;
    floor: least standard deviation of each statistic; bins: bins per unit of log(1 + squared distance), by which the
    nearest share is found; grid: cells of the grid per floor.
    """
    by, groups = list(groups), ["_level", *(f"_by_{g}" for g in groups)]
    cells = written(_cells(stats.select("*", *_features()).where(~F.col("base_failed")), by, floor, grid), "mcd-cells")
    sizes = cells.groupBy(*by).agg(F.sum("_w").alias("_size"))
    # level k leaves out the last k of the columns; a group's rows are judged at its first level with enough rows
    counts = [F.sum("_size").over(W.partitionBy(*by[: len(by) - k])) for k in range(len(by) + 1)]
    level = F.coalesce(*[F.when(n >= min_group, F.lit(k)) for k, n in enumerate(counts)], F.lit(len(by)))
    chosen = written(sizes.select(*by, level.alias("_level")), "mcd-levels")
    used = sorted(r["_level"] for r in chosen.select("_level").distinct().collect())
    masked = [F.when(F.col("_level") <= len(by) - 1 - i, F.col(g)).alias(f"_by_{g}") for i, g in enumerate(by)]
    levels = F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")
    at = [f"_c{i}" for i in range(len(FEATURES))]
    pooled = cells.withColumn("_level", F.explode(levels)).select("_level", *masked, *at, "_w").groupBy(*groups, *at).agg(F.sum("_w").alias("_w"))
    found = estimates(written(pooled, "mcd-pooled"), groups, share, tolerance, floor, bins, grid)
    return written(_with(chosen.select(*by, "_level", *masked), found.drop("_det"), groups).drop(*groups), "mcd-models")


def verdicts(stats: DataFrame, models: DataFrame, groups: tuple[str, ...] = ("lang", "source"), quantile: float = 0.999) -> DataFrame:
    """The rows with d2, and kept: passed the base limits and not beyond the cutoff of its group's estimate.

    quantile: of chi-square with as many degrees as there are statistics, the largest squared distance that is kept.
    """
    rows = _distance(_with(stats.select("*", *_features()), models, list(groups)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") <= _chi2_quantile(quantile, len(FEATURES)), F.lit(True))
    return rows.select(*stats.columns, F.col("_d2").alias("d2"), kept.alias("kept"))


def outliers(stats: DataFrame, groups: tuple[str, ...] = ("lang", "source"), quantile: float = 0.999, **options) -> DataFrame:
    """verdicts() by fitted() on the same rows."""
    return verdicts(stats, fitted(stats, groups, **options), groups, quantile)


def _chi2(x: float, k: int) -> float:
    """P(chi-square with k degrees <= x), k even."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(k // 2))


def _chi2_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < share else (low, mid)
    return low


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Statistics and verdict of every row, and its columns in keep.

    Statistics are written, to be read again for verdicts. With columns to keep, which may be the texts, they are
    made anew instead, so that no text is written or shuffled.
    """
    stats = written(statistics(docs, id_col, text_col, keep=groups), "quality-stats")
    return outliers(stats, groups, **options) if not keep else verdicts(statistics(docs, id_col, text_col, keep=(*groups, *keep)), fitted(stats, groups, **options), groups)
