"""Image features from pixel tables (image_id, y, x, v)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps (dy, dx) to the neighbour at 0, 45, 90 and 135 degrees; fixed values.
ANGLES = {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}


def grey(rgb: Sequence[str]):
    """Luma of three channels, rounded."""
    r, g, b = (F.col(c) for c in rgb)
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the level at which the classes below or at it and above it differ most, the least of equals."""
    h = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id")
    below = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    nv = F.col("n") * F.col("v")
    h = h.select("image_id", "v", F.sum("n").over(below).alias("n0"), F.sum(nv).over(below).alias("s0"), F.sum("n").over(w).alias("n1"), F.sum(nv).over(w).alias("s1")).filter("n0 < n1")
    m0, m1 = F.col("s0") / F.col("n0"), (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0"))
    h = h.withColumn("between", F.round(F.col("n0") * (F.col("n1") - F.col("n0")) * (m0 - m1) * (m0 - m1) / (F.col("n1") * F.col("n1")), 9))
    return h.groupBy("image_id").agg(F.max_by("v", F.struct(F.col("between"), -F.col("v"))).alias("threshold"))


def masked(pixels: DataFrame) -> DataFrame:
    """Pixels with those at or below their image's threshold set to 0."""
    return pixels.join(otsu(pixels), "image_id").withColumn("v", F.when(F.col("v") > F.col("threshold"), F.col("v")).otherwise(0)).drop("threshold")


def _grids(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, v): each image's pixels as lists, one row an image."""
    lists = (F.col(f"p.{c}").alias(c) for c in ("y", "x", "v"))
    return pixels.groupBy("image_id").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x", "v")))).alias("p")).select("image_id", *lists)


def _pairs(batches: Iterator[pa.RecordBatch], symmetric: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("at", "angle", "i", "j", "n")}
        for k in range(len(b)):
            y, x, v = (np.asarray(b.column(c)[k].values) for c in ("y", "x", "v"))
            y, x = y - y.min(initial=0), x - x.min(initial=0)
            grid = np.full((y.max(initial=-1) + 1, x.max(initial=-1) + 1), -1, np.int64)
            grid[y, x] = v
            levels = int(v.max(initial=0)) + 1
            for angle, (dy, dx) in ANGLES.items():
                h, w = grid.shape[0] - dy, grid.shape[1] - abs(dx)
                if h <= 0 or w <= 0:
                    continue
                first = grid[:h, max(0, -dx) : max(0, -dx) + w]
                second = grid[dy : dy + h, max(0, dx) : max(0, dx) + w]
                there = (first >= 0) & (second >= 0)
                i, j = first[there], second[there]
                if symmetric:
                    i, j = np.concatenate((i, j)), np.concatenate((j, i))
                pair, n = np.unique(i * levels + j, return_counts=True)
                for c, value in (("at", np.full(len(n), k)), ("angle", np.full(len(n), angle)), ("i", pair // levels), ("j", pair % levels), ("n", n)):
                    out[c].append(value)
        cat = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
        yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(cat["at"].astype(np.int64))), *(pa.array(cat[c].astype(np.int32)) for c in ("angle", "i", "j")), pa.array(cat["n"].astype(np.int64))], ["image_id", "angle", "i", "j", "n"])


def cooccurrence(pixels: DataFrame, symmetric: bool = True) -> DataFrame:
    """(image_id, angle, i, j, n): how often values i and j (0 and above) are neighbours at an angle.

    An image's pixels come together once and are shifted as a grid; only its counts go on.
    """
    kind = pixels.schema["image_id"].dataType.simpleString()
    return _grids(pixels).mapInArrow(lambda batches: _pairs(batches, symmetric), f"image_id {kind}, angle int, i int, j int, n long")


def normed(counts: DataFrame) -> DataFrame:
    """(image_id, angle, i, j, p): counts as shares of their image and angle."""
    total = counts.groupBy("image_id", "angle").agg(F.sum("n").alias("t"))
    return counts.join(total, ["image_id", "angle"]).select("image_id", "angle", "i", "j", (F.col("n") / F.col("t")).alias("p"))


def levelled(pixels: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Pixels by the number of the edges at or below their value."""
    from .table import digitized

    return pixels.withColumn("v", digitized(F.col("v"), edges))


#: What a feature table of images may hold; fixed names.
GLCM_FEATURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")
STATISTICAL_FEATURES = ("mean", "variance", "deviation", "rms")
FEATURES = {"all": GLCM_FEATURES + STATISTICAL_FEATURES, "glcm": GLCM_FEATURES, "statistical": STATISTICAL_FEATURES}


def texture(counts: DataFrame) -> DataFrame:
    """Contrast, dissimilarity, homogeneity, energy, correlation (1 without spread) and ASM, means over the angles."""
    total = counts.groupBy("image_id", "angle").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("i")).alias("si"), F.sum(F.col("n") * F.col("j")).alias("sj"))
    p = F.col("n") / F.col("t")
    c = counts.join(total, ["image_id", "angle"]).withColumns({"p": p, "d": F.col("i") - F.col("j"), "di": F.col("i") - F.col("si") / F.col("t"), "dj": F.col("j") - F.col("sj") / F.col("t")})
    s = lambda x: F.sum(F.col("p") * x)
    d, di, dj = F.col("d"), F.col("di"), F.col("dj")
    one = c.groupBy("image_id", "angle").agg(s(d * d).alias("contrast"), s(F.abs(d)).alias("dissimilarity"), s(1 / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"), s(di * di).alias("vi"), s(dj * dj).alias("vj"), s(di * dj).alias("cov"))
    flat = (F.col("vi") < 1e-15) | (F.col("vj") < 1e-15)
    one = one.withColumns({"energy": F.sqrt("asm"), "correlation": F.when(flat, 1.0).otherwise(F.col("cov") / F.sqrt(F.when(flat, 1.0).otherwise(F.col("vi") * F.col("vj"))))})
    return one.groupBy("image_id").agg(*(F.avg(x).alias(x) for x in ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")))


def moments(pixels: DataFrame, where=None) -> DataFrame:
    """Mean, variance, deviation and root mean square of an image's pixels."""
    p = pixels if where is None else pixels.filter(where)
    v = F.col("v").cast("double")
    return p.groupBy("image_id").agg(F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"), F.sqrt(F.avg(v * v)).alias("rms"))


def described(pixels: DataFrame, which: str = "all", mask: DataFrame | None = None) -> DataFrame:
    """A row of features for each image: texture of its masked pixels, and the moments of the pixels outside the mask.

    mask: (image_id, y, x, m); pixels of m = 0 count as 0 in the texture and make the moments. Without one, the mask is
    that of Otsu's threshold.
    """
    if mask is None:
        cut = otsu(pixels)
        both = pixels.join(cut, "image_id").withColumn("m", (F.col("v") > F.col("threshold")).cast("int"))
    else:
        both = pixels.join(mask, ["image_id", "y", "x"])
    out = pixels.select("image_id").distinct()
    if which != "statistical":
        out = out.join(texture(cooccurrence(both.withColumn("v", F.col("v") * F.col("m")))), "image_id", "left")
    if which != "glcm":
        out = out.join(moments(both, F.col("m") == 0), "image_id", "left")
    return out.select("image_id", *FEATURES[which])


def both_masks(pixels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image_id, y, x, m): 1 where a pixel is above Otsu's threshold and in the cluster mask (v: 1)."""
    above = pixels.join(otsu(pixels), "image_id").select("image_id", "y", "x", (F.col("v") > F.col("threshold")).alias("above"))
    return above.join(clusters.select("image_id", "y", "x", "v"), ["image_id", "y", "x"]).select("image_id", "y", "x", (F.col("above") & (F.col("v") == 1)).cast("int").alias("m"))
