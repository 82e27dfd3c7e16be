"""Scores of features, selection, fusion and reduction of dimensions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.sources.shared import file_system, fresh_path, written

from .table import digitized, quantiles, running, unused


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    return df.select(*keep, each.alias("_e")).select(*keep, "_e.feature", "_e.x")


def label_correlation(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, corr) over rows where both are there; one pass for all features."""
    one = df.agg(*(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns))).alias("e")).select("e.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs of different features, one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("e")).select("e.*")


def mean_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks of a numeric column, joined back from its distinct values with their counts, which are summed by ranges."""
    n, before, rank = (unused(df, x) for x in ("n", "before", "rank"))
    counts = running(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n)), column, F.col(n), before)
    counts = counts.select(column, (F.col(before) + (F.col(n) + 1) / 2).alias(rank))
    return df.join(counts, column, "left").withColumnRenamed(rank, name)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = mean_ranks(mean_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("rho"))


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f): between-class over within-class mean squares, by sums of one pass."""
    g = _long(df.filter(F.col(label).isNotNull()), columns, label).groupBy("feature", label)
    g = g.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    t = g.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"), F.count("*").alias("k"))
    between = (F.col("c") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("c")) / (F.col("n") - F.col("k"))
    return t.select("feature", (between / F.nullif(within, F.lit(0.0))).alias("f"))


def binned_information(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, mi): mutual information of discrete features and the label, in nats."""
    j = _long(df, columns, label).groupBy("feature", "x", label).agg(F.count("*").alias("n"))
    px = j.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    py = j.groupBy("feature", label).agg(F.sum("n").alias("ny"))
    t = j.groupBy("feature").agg(F.sum("n").alias("t"))
    all_ = j.join(px, ["feature", "x"]).join(py, ["feature", label]).join(t, "feature")
    return all_.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


#: Different values (with their classes) of a range, and ranges at most; larger tables have larger ones.
RANGE, RANGES = 250_000, 1024


def _digamma(v: np.ndarray) -> np.ndarray:
    w = v + 6.0
    return np.log(w) - 1 / (2 * w) - 1 / (12 * w * w) + 1 / (120.0 * w**4) - sum(1 / (v + i) for i in range(6))


def _ball(values: np.ndarray, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the sorted different values are nearer to v than r, or equal to v where r is 0."""
    lo, hi = np.searchsorted(values, v - r, "left"), np.searchsorted(values, v + r, "right")
    # v - r and v + r are rounded: the values at the ends are held against the distance itself.
    for _ in range(2):
        at = values[np.minimum(lo, len(values) - 1)]
        lo = np.where((r > 0) & (lo < len(values)) & (v - at >= r), lo + 1, lo)
        at = values[np.maximum(hi, 1) - 1]
        hi = np.where((r > 0) & (hi > 0) & (at - v >= r), hi - 1, hi)
    return lo, hi


def _sums(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and how many rows there are before each, and in all."""
    values, at = np.unique(values, return_inverse=True)
    return values, np.concatenate(([0], np.cumsum(np.bincount(at, n, len(values)).astype(np.int64))))


class _Ranges:
    """A feature's ranges of values: the class numbers, numbers and different values of each, as far as they are asked for."""

    def __init__(self, path: str, feature: str, classes: dict) -> None:
        self.fs, self.root = file_system(path)
        self.feature, self.classes, self.held = feature, classes, {}

    def __getitem__(self, part: int) -> dict:
        """Class number, or -1 for all: different values, and rows before them."""
        if part not in self.held:
            if len(self.held) > 3:
                self.held.pop(next(iter(self.held)))
            t = pa.dataset.dataset(f"{self.root}/part={part}", filesystem=self.fs, format="parquet").to_table(filter=pa.dataset.field("feature") == self.feature)
            y = np.array([self.classes.get(v, -1) for v in t.column("y").to_pylist()], np.int64)
            x, n, some = t.column("x").to_numpy(), t.column("n").to_numpy(), y >= 0
            self.held[part] = {-1: _sums(x[some], n[some])} | {int(c): _sums(x[y == c], n[y == c]) for c in np.unique(y[some])}
        return self.held[part]


def _range_ends(ranges: _Ranges, part: int, k: int) -> list[tuple]:
    """(class, rows, the first and the last k + 1 rows' values) of a range, and the first and the last value of all (-1)."""
    out = []
    for c, (values, before) in ranges[part].items():
        if len(values):
            n = np.minimum(np.diff(before), k + 1)
            out.append((c, int(before[-1]), np.repeat(values[: k + 1], n[: k + 1])[: k + 1].tolist(), np.repeat(values[-k - 1 :], n[-k - 1 :])[-k - 1 :].tolist()))
    return out


def _range_terms(ranges: _Ranges, part: int, ends: list[tuple[int, dict]], sizes: dict, k: int) -> float:
    """The sum over a range's rows of the digammas of both counts; `ends` are those of all ranges, in order."""
    here = [p for p, _ in ends].index(part)
    lows, highs = (np.array([e[-1][j][i] for _, e in ends]) for j, i in ((1, 0), (2, -1)))
    upto = {c: np.concatenate(([0], np.cumsum([e[c][0] if c in e else 0 for _, e in ends]))) for c in (-1, *sizes)}

    def inside(c: int, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Rows of a class in the balls, whose ends may be in other ranges."""
        first, last, total = _ball(highs, v, r)[0], _ball(lows, v, r)[1] - 1, np.zeros(len(v), np.int64)
        for side, at, sign in ((0, first, -1), (1, last, 1)):
            for i in np.unique(at):
                q = np.flatnonzero(at == i)
                values, before = ranges[ends[i][0]].get(c, (np.zeros(0), np.zeros(1, np.int64)))
                place = before[_ball(values, v[q], r[q])[side]] if len(values) else 0
                total[q] += sign * (upto[c][i] + place)
        return total

    terms = 0.0
    for c, (values, before) in ranges[part].items():
        if c < 0:
            continue
        n, kk = np.diff(before), min(k, sizes[c] - 1)
        few = np.minimum(n, k + 1)
        sooner, later = [], []
        for _, e in reversed(ends[:here]):
            if len(sooner) >= kk:
                break
            sooner = (e[c][2] if c in e else []) + sooner
        for _, e in ends[here + 1 :]:
            if len(later) >= kk:
                break
            later = later + (e[c][1] if c in e else [])
        wide = np.concatenate((np.full(kk, -np.inf), sooner, np.repeat(values, few), later, np.full(kk, np.inf)))
        at = kk + len(sooner) + np.cumsum(few) - few
        r = np.min([np.maximum(values - wide[at - kk + j], wide[at + j] - values) for j in range(kk + 1)], axis=0)
        terms += float((n * (_digamma(inside(c, values, r).astype(float)) - _digamma(inside(-1, values, r).astype(float)))).sum())
    return terms


def neighbour_information(df: DataFrame, columns: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """(feature, mi) of continuous features and a class by nearest neighbours (Ross 2014).

    Each row's ball ends before its k-th neighbour of the same class; where that many have its very value, the ball is
    that value. Both counts are those of the ball, so ties need no noise. Classes of one row are left out, and values that
    are no finite numbers.

    Rows are counted by value and class, and these counts are written by ranges of values. A task has one range of a
    feature; it knows the ends of the others, and reads those in which balls end.
    """
    spark = df.sparkSession
    rows = _long(df, columns, label).withColumnRenamed(label, "y").filter("y is not null and abs(x) < double('infinity')")
    counts = written(rows.groupBy("feature", "x", "y").agg(F.count("*").alias("n")), "values")
    sizes: dict[str, dict] = {}
    for f, y, n in counts.groupBy("feature", "y").agg(F.sum("n")).orderBy("feature", "y").collect():  # features times classes
        sizes.setdefault(f, {})[y] = n
    names = {f: {y: i for i, y in enumerate(y for y, n in own.items() if n > 1)} for f, own in sizes.items()}
    number = {f: {i: sizes[f][y] for y, i in own.items()} for f, own in names.items()}
    path = fresh_path(spark, "value-ranges")
    parts = min(RANGES, counts.count() // RANGE + 1)
    counts.repartitionByRange(parts, "feature", "x").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    units = [(f, p) for f, p in spark.read.parquet(path).select("feature", "part").distinct().orderBy("feature", "part").collect()] if sizes else []

    def per_unit(run, schema: str) -> list:
        def task(batches):
            for b in batches:
                for u in b.column(0).to_pylist():
                    f, p = units[u]
                    got = run(_Ranges(path, f, names[f]), f, p)
                    yield pa.RecordBatch.from_pylist([{"u": u, **x} for x in got], schema=pa.schema([("u", pa.int64()), *kinds]))

        kinds = [(n, {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (x.split(" ") for x in schema.split(", "))]
        return spark.range(0, len(units), 1, len(units)).mapInArrow(task, f"u long, {schema}").collect() if units else []  # ranges times classes

    ends: dict[str, dict] = {}
    for u, c, *e in per_unit(lambda ranges, f, p: [dict(zip(("c", "n", "low", "high"), e, strict=True)) for e in _range_ends(ranges, p, k)], "c long, n long, low array<double>, high array<double>"):
        ends.setdefault(units[u][0], {}).setdefault(units[u][1], {})[c] = e
    ordered = {f: sorted(own.items()) for f, own in ends.items()}
    terms: dict[str, list] = {}
    for u, t in per_unit(lambda ranges, f, p: [{"t": _range_terms(ranges, p, ordered[f], number[f], k)}] if p in ends.get(f, {}) else [], "t double"):
        terms.setdefault(units[u][0], []).append(t)
    psi = lambda n: float(_digamma(np.float64(n)))
    out = []
    for f in sizes:
        n = sum(number[f].values())
        own = psi(n) + (math.fsum(terms[f]) - sum(m * psi(m) for m in number[f].values())) / n if n else 0.0
        out.append((f, max(0.0, own)))
    return spark.createDataFrame(out, "feature string, mi double")


def informative(df: DataFrame, columns: Sequence[str], label: str, bins: int = 32) -> DataFrame:
    """(feature, mi) by binned_information, columns of more than `bins` values cut at the quantiles of as many bins first."""
    sizes = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    edges = {c: quantiles(df, c, [k / bins for k in range(1, bins)]).first() for c in columns if sizes[c] > bins}
    cut = [digitized(F.col(c).cast("double"), sorted({float(e) for e in edges[c]})).alias(c) if c in edges else F.col(c) for c in columns]
    return binned_information(df.select(*cut, label), columns, label)


def in_column_order(chosen: DataFrame, columns: Sequence[str]) -> list[str]:
    """The chosen features (column feature), in the order of the table's columns."""
    names = {r["feature"] for r in chosen.select("feature").collect()}  # features of one table
    return [c for c in columns if c in names]


def above(scores: DataFrame, score: str, least: float = 0.02) -> DataFrame:
    """Features whose score is more than `least` from 0, the farthest first."""
    return scores.filter(F.abs(score) > least).orderBy(F.abs(score).desc(), "feature")


def top(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(k)


def forest_importance(df: DataFrame, columns: Sequence[str], label: str, trees: int = 100, seed: int = 42) -> list[tuple[str, float]]:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    wide = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df.withColumn("_y", F.col(label).cast("double")))
    fit = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="_v", labelCol="_y").fit(wide)
    return list(zip(columns, map(float, fit.featureImportances.toArray()), strict=True))


def not_redundant(ranked: Sequence[str], pairs: dict[frozenset, float], threshold: float) -> list[str]:
    """Features in score order, without those that correlate above the threshold with one already taken."""
    kept: list[str] = []
    for c in ranked:
        if all(abs(pairs.get(frozenset((c, o)), 0.0) or 0.0) <= threshold for o in kept):
            kept.append(c)
    return kept


def filter_multimodal(df: DataFrame, image: Sequence[str], clinical: Sequence[str], label: str, k_image: int = 10, k_clinical: int = 10, threshold: float = 0.9) -> list[str]:
    """Both kinds' best features by the mean of neighbour information and forest importance, twice as many as asked at first, then
    without redundant ones, then the best k of each."""
    out: list[str] = []
    for columns, k in ((image, k_image), (clinical, k_clinical)):
        mi = {r["feature"]: r["mi"] for r in neighbour_information(df, columns, label).collect()}
        score = {c: (mi.get(c, 0.0) + v) / 2 for c, v in forest_importance(df, columns, label)}
        ranked = sorted(columns, key=lambda c: (-score[c], c))[: 2 * k]
        pairs = {frozenset((r["a"], r["b"])): r["corr"] for r in correlations(df, ranked).collect()} if len(ranked) > 1 else {}
        out += not_redundant(ranked, pairs, threshold)[:k]
    return out


#: Bins of a feature in a forest of cells, and the depth of its trees, those of Spark's forests; cells that a task holds.
FOREST_BINS, FOREST_DEPTH, FOREST_CELLS = 32, 5, 4_000_000


def _binned(df: DataFrame, columns: Sequence[str], label: str, folds: int, seed: int) -> DataFrame:
    """(fold, class, a bin for each column) of all rows, written. A missing value is an error, as it is to Spark's forests."""
    x = [F.col(c).cast("double") for c in (*columns, label)]
    missing = F.count(F.when(F.greatest(*((v.isNull() | F.isnan(v)).cast("int") for v in x)) > 0, 1))
    told = df.agg(missing.alias("missing"), F.count_distinct(label), *(F.count_distinct(v) for v in x[:-1])).first()
    if told["missing"]:
        raise ValueError(f"{told['missing']} rows have no value of a feature or no label")
    edges = []
    for c, n in zip(columns, told[2:], strict=True):
        if n > FOREST_BINS:
            edges.append(sorted({float(e) for e in quantiles(df, c, [k / FOREST_BINS for k in range(1, FOREST_BINS)]).first()}))
        else:
            own = sorted(r[0] for r in df.select(F.col(c).cast("double")).distinct().collect())  # FOREST_BINS at most
            edges.append([(a + b) / 2 for a, b in zip(own[:-1], own[1:], strict=True)])
    classes = sorted(r[0] for r in df.select(x[-1]).distinct().collect())
    fold = F.floor(F.rand(seed) * folds).cast("int")
    bins = [(digitized(v, e) if e else F.lit(0)).cast("int").alias(f"x{i}") for i, (v, e) in enumerate(zip(x[:-1], edges, strict=True))]
    return written(df.select(fold.alias("fold"), (digitized(x[-1], classes) - 1).alias("y"), *bins), "binned")


def _tree(at: np.ndarray, drawn: np.ndarray, some: int, r: np.random.Generator) -> np.ndarray:
    """The class shares of each cell's leaf in a tree grown on drawn rows; at: the cells' bins, drawn: rows by cell and class."""
    (n, wide), classes = at.shape, drawn.shape[1]
    node, share = np.zeros(n, np.int64), np.zeros((n, classes))
    for depth in range(FOREST_DEPTH + 1):
        nodes = 1 << depth
        total = np.stack([np.bincount(node, drawn[:, c], nodes) for c in range(classes)], 1)
        size = total.sum(1)
        share = np.where(size[node, None] > 0, total[node] / np.maximum(size[node, None], 1), share)
        if depth == FOREST_DEPTH:
            break
        gini = lambda x: x.sum(-1) - (x**2).sum(-1) / np.maximum(x.sum(-1), 1)  # noqa: E731  times the rows
        tried = np.argsort(r.random((nodes, wide)), axis=1)[:, :some]
        best, by, below = np.full(nodes, 1e-9 * np.maximum(size, 1)), np.full(nodes, -1), np.zeros(nodes, np.int64)
        for j in range(wide):
            h = np.stack([np.bincount(node * FOREST_BINS + at[:, j], drawn[:, c], nodes * FOREST_BINS) for c in range(classes)], 1)
            low = h.reshape(nodes, FOREST_BINS, classes).cumsum(1)[:, :-1]
            high = total[:, None] - low
            gain = gini(total)[:, None] - gini(low) - gini(high)
            gain[(low.sum(2) < 1) | (high.sum(2) < 1) | ~(tried == j).any(1)[:, None]] = -1
            k = gain.argmax(1)
            top = gain[np.arange(nodes), k]
            better = top > best
            best[better], by[better], below[better] = top[better], j, k[better]
        # A node without a split stays as it is, with all its rows on one side.
        node = 2 * node + ((by[node] >= 0) & (at[np.arange(n), np.maximum(by[node], 0)] > below[node]))
    return share


def _right(cells: pa.Table, fold: int, classes: int, trees: int, seed: int) -> tuple[int, int]:
    """Rows of a fold whose class a forest of the other folds' rows tells, and all rows of it.

    Rows in one cell are the same to a tree. A tree's sample takes each row a Poisson number of times of mean 1, so a cell
    of n rows as often as a Poisson number of mean n says: the same chances without a look at single rows.
    """
    x = np.column_stack([np.asarray(cells.column(c)) for c in cells.column_names[3:]])
    at, which = np.unique(x, axis=0, return_inverse=True)
    own, y, n = (np.asarray(cells.column(c)) for c in ("fold", "y", "n"))
    count = lambda keep: np.bincount(which.ravel()[keep] * classes + y[keep], n[keep], len(at) * classes).reshape(-1, classes)
    held, rows, votes = count(own == fold), count(own != fold), np.zeros((len(at), classes))
    for t in range(trees):
        r = np.random.Generator(np.random.PCG64([seed, fold, t]))
        votes += _tree(at, r.poisson(rows).astype(float), math.ceil(math.sqrt(at.shape[1])), r)
    return int(held[np.arange(len(at)), votes.argmax(1)].sum()), int(held.sum())


def _cell_accuracy(cells: DataFrame, path: str, folds: int, classes: int, trees: int, seed: int) -> float:
    """The mean over folds of a forest's accuracy on the rows left out; cells (fold, y, n, bins) are written to path."""

    def task(batches):
        for b in batches:
            fs, root = file_system(path)
            table = pa.dataset.dataset(root, filesystem=fs, format="parquet").to_table()
            table = table.sort_by([(c, "ascending") for c in table.column_names if c != "n"])  # the same draws on every run
            for fold in b.column(0).to_pylist():
                right, n = _right(table, fold, classes, trees, seed)
                yield pa.RecordBatch.from_pydict({"right": [right], "n": [n]})

    got = cells.sparkSession.range(0, folds, 1, folds).mapInArrow(task, "right long, n long").collect()
    return sum(r["right"] / r["n"] for r in got if r["n"]) / max(1, sum(r["n"] > 0 for r in got))


def forward_wrapper(df: DataFrame, image: Sequence[str], clinical: Sequence[str], label: str, most_image: int = 5, most_clinical: int = 5, folds: int = 5, trees: int = 100, seed: int = 42, least_image: int = 1, least_clinical: int = 1) -> list[str]:
    """The best `least` features of each kind by themselves, then features of both added one by one while the
    cross-validated accuracy of a forest rises, at most so many of each kind.

    Features are binned once. The rows of a candidate set are counted by fold, class and bins, and a task for each fold grows
    all trees on these cells. Sets with more than FOREST_CELLS cells go to Spark's forests, which go over the binned rows.
    """
    columns = [*image, *clinical]
    data = _binned(df, columns, label, folds, seed)
    classes = data.agg(F.max("y")).first()[0]
    classes = 1 if classes is None else classes + 1

    def accuracy(chosen: list[str]) -> float:
        names = [f"x{columns.index(c)}" for c in chosen]
        path = fresh_path(df.sparkSession, "cells")
        data.groupBy("fold", "y", *names).agg(F.count("*").alias("n")).select("fold", "y", "n", *names).write.parquet(path)
        cells = df.sparkSession.read.parquet(path)
        if cells.count() <= FOREST_CELLS:
            return _cell_accuracy(cells, path, folds, classes, trees, seed)
        return _row_accuracy(data, names, folds, trees, seed)

    def best_of(kept: list[str], left: list[str]) -> tuple[float, str]:
        with ThreadPoolExecutor(4) as pool:  # small jobs, side by side
            tried = list(zip(pool.map(lambda c: accuracy([*kept, c]), left), left, strict=True))
        return max(tried, key=lambda x: (x[0], -left.index(x[1])))

    kept, best = [], -1.0
    for some, least in ((image, least_image), (clinical, least_clinical)):
        own: list[str] = []
        while len(own) < min(least, len(some)):
            own.append(best_of(own, [c for c in some if c not in own])[1])
        kept += own
    while True:
        left = [c for some, most in ((image, most_image), (clinical, most_clinical)) if sum(k in some for k in kept) < most for c in some if c not in kept]
        score, c = best_of(kept, left) if left else (best, "")
        if score <= best:
            return kept
        best = score
        kept.append(c)


def _row_accuracy(data: DataFrame, names: list[str], folds: int, trees: int, seed: int) -> float:
    """The same by Spark's forests over all rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    wide = VectorAssembler(inputCols=names, outputCol="_v").transform(data.withColumn("y", F.col("y").cast("double")))
    forest = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="_v", labelCol="y")
    grid, told = ParamGridBuilder().build(), MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=told, numFolds=folds, foldCol="fold").fit(wide).avgMetrics[0]


def _gram(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> np.ndarray:
    """Sums of products of columns and targets, one aggregate."""
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(targets)]
    row = df.agg(*cells).first()
    return np.array([v or 0.0 for v in row]).reshape(len(columns), len(targets))


def _combined(columns: Sequence[str], weights: np.ndarray):
    return [sum((F.col(c) * float(w) for c, w in zip(columns, column, strict=True)), F.lit(0.0)) for column in weights.T]


def hadamard(df: DataFrame, image: Sequence[str], clinical: Sequence[str], keep: Sequence[str], dim: int = 5, alpha: float = 0.01, seed: int = 42) -> DataFrame:
    """Both kinds' standardized features ridge-projected onto seeded random targets, unit rows, multiplied element by
    element, beside the tanh of both: 3 * dim columns."""
    from .table import scaled

    std = scaled(df, [*image, *clinical], "zscore")
    noise = std.select("*", *(F.randn(seed + j).alias(f"_y{j}") for j in range(dim)))
    targets = [f"_y{j}" for j in range(dim)]
    out = []
    for columns in (image, clinical):
        g = _gram(noise, columns, [*columns, *targets])
        weights = np.linalg.solve(g[:, : len(columns)] + alpha * np.eye(len(columns)), g[:, len(columns) :])
        parts = _combined(columns, weights)
        norm = F.sqrt(sum((p * p for p in parts), F.lit(0.0))) + 1e-8
        out.append([p / norm for p in parts])
    a, b = out
    return std.select(*keep, *((x * y).alias(f"h{j}") for j, (x, y) in enumerate(zip(a, b, strict=True))), *(F.tanh(x).alias(f"hi{j}") for j, x in enumerate(a)), *(F.tanh(y).alias(f"hc{j}") for j, y in enumerate(b)))


def _top_directions(gram: np.ndarray, k: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    v = vectors[:, np.argsort(-values)[:k]]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def tensor(df: DataFrame, image: Sequence[str], clinical: Sequence[str], keep: Sequence[str], rank: int = 10) -> DataFrame:
    """Products of every image and clinical feature, projected on their first right singular vectors (not centred)."""
    wide = df.select(*keep, *((F.col(a).cast("double") * F.col(b).cast("double")).alias(f"t{i}_{j}") for i, a in enumerate(image) for j, b in enumerate(clinical)))
    columns = [c for c in wide.columns if c not in keep]
    v = _top_directions(_gram(wide, columns, columns), min(rank, len(columns)))
    return wide.select(*keep, *(x.alias(f"svd{i}") for i, x in enumerate(_combined(columns, v))))


def components_of(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The model of principal components: (component, feature, mean, loading), the largest loading of each positive."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centred = df.select(*((F.col(c) - float(means[c])).alias(c) for c in columns))
    v = _top_directions(_gram(centred, columns, columns), k)
    rows = [(i, c, float(means[c]), float(v[j, i])) for i in range(v.shape[1]) for j, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, mean double, loading double")


def projected(df: DataFrame, model: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows on the components of a model, as pc0, pc1, ..."""
    rows = model.orderBy("component", "feature").collect()  # components times features
    parts: dict[int, list] = {}
    for r in rows:
        parts.setdefault(r["component"], []).append((F.col(r["feature"]) - r["mean"]) * r["loading"])
    return df.select(*keep, *(sum(x, F.lit(0.0)).alias(f"pc{i}") for i, x in parts.items()))


def principal(df: DataFrame, columns: Sequence[str], keep: Sequence[str], k: int) -> DataFrame:
    """The first principal components of centred columns, the largest loading of each positive."""
    return projected(df, components_of(df, columns, k), keep)
