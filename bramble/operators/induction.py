"""Rules from numbers: fuzzy c-means per column, bins, strengths, prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bramble.functions import membership as mf
from bramble.sources.shared import written

from . import table


#: Distinct values of a column that one task clusters by itself; over more, every turn is a job of partial sums.
MOST_VALUES = 1_000_000


def first_centres(low: float, high: float, k: int) -> np.ndarray:
    """The middle for one centre, else k equally spaced ones from end to end."""
    return np.array([(low + high) / 2]) if k == 1 else np.linspace(low, high, k)


def fuzzy_means(x: np.ndarray, count: np.ndarray, start: np.ndarray, m: float = 2.0, eps: float = 0.01, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(centres, the centres that the last memberships were made from) of weighted values.

    Each turn makes memberships from the distances to the centres, then new centres and the objective; when that moves by
    less than eps the turn's results are not taken over, so memberships lag the centres by a turn.
    """
    tiny = np.finfo(float).eps
    centres = lagged = np.asarray(start, float)
    before = 0.0
    for _ in range(most):
        d = np.abs(x[:, None] - centres)
        d[d == 0] = tiny
        u = d ** (-2 / (m - 1))
        u /= u.sum(1, keepdims=True)
        um = u**m * count[:, None]
        new = (um * x[:, None]).sum(0) / (um.sum(0) + tiny)
        objective = float((um * (x[:, None] - new) ** 2).sum())
        if abs(objective - before) < eps:
            break
        before, lagged, centres = objective, centres, new
    return centres, lagged


def centres_of(df: DataFrame, clusters: Mapping[str, int], m: float = 2.0, eps: float = 0.01, most: int = 200) -> DataFrame:
    """(feature, centres, lagged): each column's centres, from its histogram of distinct values, columns side by side.

    A column of at most MOST_VALUES values is clustered by one task. Larger ones are summed where their values are, turn
    by turn; the driver sees the sums.
    """
    long = reduce(DataFrame.unionByName, (df.select(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in clusters))
    histogram = written(long.filter("x is not null").groupBy("feature", "x").agg(F.count("*").alias("n")), "histogram")
    ks = dict(clusters)
    ends = histogram.groupBy("feature").agg(F.count("*").alias("values"), F.min("x").alias("low"), F.max("x").alias("high"))
    large = {r["feature"]: (r["low"], r["high"]) for r in ends.filter(F.col("values") > MOST_VALUES).collect()}  # columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["feature"].iloc[0]
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy(float)
        centres, lagged = fuzzy_means(x, n, first_centres(x.min(), x.max(), ks[name]), m, eps, most)
        return pd.DataFrame({"feature": [name], "centres": [centres.tolist()], "lagged": [lagged.tolist()]})

    schema = "feature string, centres array<double>, lagged array<double>"
    small = histogram.filter(~F.col("feature").isin(list(large))) if large else histogram
    out = small.groupBy("feature").applyInPandas(run, schema)
    if not large:
        return out
    rows = [(name, *map(np.ndarray.tolist, _summed_means(histogram.filter(F.col("feature") == name), first_centres(*large[name], ks[name]), m, eps, most))) for name in large]
    return out.unionByName(histogram.sparkSession.createDataFrame(rows, schema))


def _summed_means(histogram: DataFrame, start: np.ndarray, m: float, eps: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """fuzzy_means of a column (x, n) whose values stay where they are. Sums are about the middle of the first centres."""
    tiny, middle = np.finfo(float).eps, float(start.mean())

    def sums(centres: np.ndarray) -> np.ndarray:
        def part(batches):
            total = np.zeros((3, len(centres)))
            for b in batches:
                x, n = np.asarray(b.column(0)) - middle, np.asarray(b.column(1)).astype(float)
                d = np.abs(x[:, None] - centres)
                d[d == 0] = tiny
                u = d ** (-2 / (m - 1))
                um = (u / u.sum(1, keepdims=True)) ** m * n[:, None]
                total += np.stack((um.sum(0), (um * x[:, None]).sum(0), (um * x[:, None] ** 2).sum(0)))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        rows = histogram.select("x", "n").mapInArrow(part, "sums array<double>").collect()  # a row for each task
        return np.sum([r["sums"] for r in rows], axis=0).reshape(3, -1)

    centres = lagged = start - middle
    before = 0.0
    for _ in range(most):
        weight, first, second = sums(centres)
        new = first / (weight + tiny)
        objective = float((second - 2 * new * first + new * new * weight).sum())
        if abs(objective - before) < eps:
            break
        before, lagged, centres = objective, centres, new
    return centres + middle, lagged + middle


def adaptive_clusters(df: DataFrame, columns: Sequence[str], scale: str = "three") -> DataFrame:
    """(feature, k) by how many distinct values a column has: "three": that many, 3 at most; "five": 2 or 3 if that many,
    else 5."""
    sizes = df.agg(*(F.count_distinct(c).alias(c) for c in columns))
    long = sizes.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in columns))).alias("e")).select("e.*")
    k = F.least("n", F.lit(3)) if scale == "three" else F.when(F.col("n").isin(2, 3), F.col("n")).otherwise(5)
    return long.select("feature", k.cast("int").alias("k"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, low, high) over all rows, those to test on included, as the first centres are set by."""
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    return ends.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high")) for c in columns))).alias("e")).select("e.*")


def as_lists(centres: DataFrame, column: str = "centres") -> dict[str, list[float]]:
    """A model-sized result on the driver: one short list per column."""
    return {r["feature"]: list(r[column]) for r in centres.collect()}


def binned(df: DataFrame, centres: Mapping[str, Sequence[float]]) -> DataFrame:
    """Columns replaced by the number of their nearest centre, from 1."""
    bins = {c: mf.nearest(F.col(c).cast("double"), F.array(*map(F.lit, v))) for c, v in centres.items()}
    return df.select(*(bins[c].alias(c) if c in bins else F.col(c) for c in df.columns))


def strengths(df: DataFrame, centres: Mapping[str, Sequence[float]], name: str = "strength") -> DataFrame:
    """The least membership of a row's values in the Gaussians at their nearest centres."""
    own = []
    for c, v in centres.items():
        at, x = F.array(*map(F.lit, v)), F.col(c).cast("double")
        own.append(mf.gauss(x, F.get(at, mf.nearest(x, at) - 1), mf.spread(at)))
    return df.withColumn(name, F.least(*own) if len(own) > 1 else own[0])


def rules_of(df: DataFrame, centres: Mapping[str, Sequence[float]], label: str, label_centres: Sequence[float], key: str) -> DataFrame:
    """(key, bins, label, strength): a rule for each row. The label is clustered like any other column, so its bin is the
    number of its nearest centre."""
    strong = strengths(df, centres, "strength")
    bins = binned(strong, {**centres, label: label_centres})
    return bins.select(key, *centres, label, "strength")


def in_terms(rules: DataFrame, clusters: Mapping[str, int]) -> DataFrame:
    return rules.select(*(mf.term(F.col(c), clusters[c]).alias(c) if c in clusters else F.col(c) for c in rules.columns))


def predicted(df: DataFrame, rules: DataFrame, centres: Mapping[str, Sequence[float]], label: str, order: str) -> DataFrame:
    """Rows binned by the centres, with the label of the first rule of the same bins, 0 where none has them."""
    return table.first_match(binned(df, centres), rules, list(centres), label, order)


def kmeans_bins(df: DataFrame, column: str, k: int, name: str, seed: int = 42) -> DataFrame:
    """Clusters of one column by k-means, numbered by their centres from 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    wide = VectorAssembler(inputCols=[column], outputCol="_v", handleInvalid="skip").transform(df)
    fit = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_k").fit(wide)
    rank = np.argsort(np.argsort([float(c[0]) for c in fit.clusterCenters()])) + 1
    return fit.transform(wide).withColumn(name, F.get(F.array(*(F.lit(int(r)) for r in rank)), F.col("_k"))).drop("_v", "_k")
