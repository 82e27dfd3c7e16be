"""Figures of predictions, and analysis of variance."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return df.agg(F.round(100 * F.sum(F.when(F.col(truth) == F.col(predicted), w).otherwise(0)) / F.sum(w), 2).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))


def per_label(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(label, precision, recall) in percent to two places over the labels of either side, 0 where undefined."""
    c = confusion(df, truth, predicted, weight)
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    p = c.groupBy(F.col(predicted).alias("label")).agg(F.round(100 * hit / F.sum("n"), 2).alias("precision"))
    r = c.groupBy(F.col(truth).alias("label")).agg(F.round(100 * hit / F.sum("n"), 2).alias("recall"))
    return p.join(r, "label", "full_outer").select("label", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def macro(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """Means over labels of the rounded precision and recall, and of F1."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    return per_label(df, truth, predicted, weight).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def confidence_counts(df: DataFrame, confidence: str, weight: str | None = None, places: int = 2) -> DataFrame:
    return df.groupBy(F.round(confidence, places).alias("confidence")).agg(F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("n"))


def _continued_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta's continued fraction (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def two_way_sums(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    """Type II sums of squares (source, ss, df) of both factors, their interaction and the rest, balanced or not.

    A factor's sum is what it adds to the model of the other one, the interaction's what single cells add to both. All
    models follow from the cells' counts, sums and squares, which are as many as the model has parameters. Rows without
    a value or a factor are left out.
    """
    import numpy as np

    v = F.col(value).cast("double")
    cells = df.filter(v.isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b)
    rows = cells.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).collect()
    n, mean = np.array([r["n"] for r in rows], float), np.array([r["m"] for r in rows])
    within = float(sum(r["n"] * r["s"] for r in rows))
    levels = {c: sorted({r[c] for r in rows}, key=str) for c in (a, b)}
    own = {c: np.array([[float(r[c] == x) for x in levels[c]] for r in rows]).reshape(len(rows), -1) for c in (a, b)}

    def lack(*factors: str) -> float:
        """What a model of these factors leaves of the differences between cells."""
        x = np.hstack([own[c] for c in factors])
        root = np.sqrt(n)
        fit = x @ np.linalg.lstsq(x * root[:, None], mean * root, rcond=None)[0]
        return float((n * (mean - fit) ** 2).sum())

    both, ka, kb = lack(a, b), len(levels[a]), len(levels[b])
    return [
        {"source": a, "ss": lack(b) - both, "df": ka - 1}, {"source": b, "ss": lack(a) - both, "df": kb - 1},
        {"source": "interaction", "ss": both, "df": len(rows) - ka - kb + 1}, {"source": "residual", "ss": within, "df": int(n.sum()) - len(rows)},
    ]


def two_way(df: DataFrame, value: str, a: str, b: str) -> list[dict]:
    """The table of variances with F and its tail probability, four rows."""
    rows = two_way_sums(df, value, a, b)
    rest = rows[-1]
    for r in rows:
        r["f"] = None if r is rest or not r["df"] else (r["ss"] / r["df"]) / (rest["ss"] / rest["df"])
        r["p"] = None if r["f"] is None else f_tail(r["f"], r["df"], rest["df"])
    return rows


def studentized_tail(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range by numerical integration over the normal range and the scale."""
    import numpy as np

    z = np.linspace(-8, 8, 1601)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    erf = np.vectorize(math.erf)
    s = np.linspace(1e-4, 4, 400)
    log_density = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log_density)
    upper = 0.5 * (1 + erf(z / math.sqrt(2)))
    inner = []
    for x in q * s:
        lower = 0.5 * (1 + erf((z - x) / math.sqrt(2)))
        inner.append(k * np.trapezoid(phi * (upper - lower) ** (k - 1), z))
    return float(min(1.0, max(0.0, 1 - np.trapezoid(density * np.array(inner), s))))


def tukey(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> list[dict]:
    """Differences of all pairs of group means with adjusted probabilities; groups are few."""
    v = F.col(value).cast("double")
    g = sorted((r.asDict() for r in df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s")).collect()), key=lambda r: r[group])
    n, k = sum(r["n"] for r in g), len(g)
    within = sum(r["s"] * r["n"] for r in g) / (n - k)
    out = []
    for a, b in combinations(g, 2):
        d = b["m"] - a["m"]
        p = studentized_tail(abs(d) / math.sqrt(within / 2 * (1 / a["n"] + 1 / b["n"])), k, n - k)
        out.append({"group1": a[group], "group2": b[group], "meandiff": d, "p_adj": p, "reject": p < alpha})
    return out


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and population deviation of each group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def combined_spread(df: DataFrame, value: str, method: str, metric: str, pair: tuple[str, str]) -> DataFrame:
    """(method, a mean and deviation for each metric of the pair, combined): the root of the sum of both variances."""
    each = summary(df.filter(F.col(metric).isin(*pair)), value, method, metric)
    of = lambda c, m: F.max(F.when(F.col(metric) == m, F.col(c)))
    wide = each.groupBy(method).agg(*(of(c, m).alias(f"{c}_{k}") for k, m in enumerate(pair, 1) for c in ("mean", "deviation")))
    return wide.withColumn("combined", F.sqrt(F.col("deviation_1") * F.col("deviation_1") + F.col("deviation_2") * F.col("deviation_2")))
