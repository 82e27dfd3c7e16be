"""Steps that SQL doesn't check, against numpy, loops and published tables."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.operators import balance, evaluation, images, induction, rasters, selection, table
from bramble.plans import scenario
from bramble.sources import files, pictures, shared

# ---- analysis of variance

#: Five runs of five methods by five measures, and the published tables over them; fixed values.
RUNS = {
    "accuracy": [75.406, 76.479, 74.356, 75.578, 77.106, 74.26, 74.186, 73.741, 73.244, 74.5, 74.844, 75.6, 74.426, 74.49, 73.904, 68.304, 68.498, 67.204, 68.958, 65.328, 77.28, 77.526, 78.256, 76.644, 75.292],
    "precision": [76.79, 78.315, 74.74, 76.58, 77.5, 73.795, 75.039, 74.23, 73.990, 76.289, 76.110, 76.93, 76.585, 78.025, 75.794, 68.07, 69.935, 65.91, 65.97, 62.86, 78.375, 72.875, 76.82, 76.17, 75.425],
    "recall": [64.305, 65.86, 63.96, 64.664, 66.345, 64.395, 65.81, 64.1, 63.155, 64.495, 61.8, 62.015, 61.61, 63.88, 60.315, 61.58, 62.02, 59.22, 60.005, 57.585, 65.555, 62.12, 61.955, 61.945, 61.45],
    "train_time": [18.57, 18.899, 18.67, 18.700, 19.02, 15.79, 15.59, 15.17, 15.187, 15.43, 21.34, 21.202, 21.36, 18.478, 19.383, 8.255, 8.447, 8.210, 8.208, 8.034, 1.533, 1.505, 1.421, 1.439, 1.470],
    "test_time": [178.05, 177.999, 182.041, 191.87, 186.608, 156.90, 159.466, 152.57, 151.285, 151.04, 261.61, 269.53, 279.288, 207.473, 241.549, 59.367, 60.306, 60.1133, 59.864, 58.869, 18.257, 17.204, 16.989, 17.41, 17.19],
}
METHODS = ["Filter", "Feature", "Hadamard", "Tensor", "Wrapper"]
SUMS = {"method": (45113.524135, 4, 316.660902), "metric": (183706.879483, 4, 1289.475547), "interaction": (136099.301137, 16, 238.827094), "residual": (3561.658844, 100, None)}
PAIRS = {
    ("Feature", "Filter"): (7.3902, 0.9869), ("Feature", "Hadamard"): (20.5554, 0.6289), ("Feature", "Tensor"): (-24.1015, 0.4741), ("Feature", "Wrapper"): (-29.662, 0.2627),
    ("Filter", "Hadamard"): (13.1652, 0.8976), ("Filter", "Tensor"): (-31.4916, 0.2082), ("Filter", "Wrapper"): (-37.0522, 0.0922),
    ("Hadamard", "Tensor"): (-44.6568, 0.0237), ("Hadamard", "Wrapper"): (-50.2174, 0.0075), ("Tensor", "Wrapper"): (-5.5606, 0.9956),
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(METHODS[i // 5], m, v) for m, values in RUNS.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "method string, metric string, value double")


def test_published_variances(runs):
    got = {r["source"]: r for r in evaluation.two_way(runs, "value", "method", "metric")}
    for source, (ss, df, f) in SUMS.items():
        assert got[source]["ss"] == pytest.approx(ss, abs=1e-5) and got[source]["df"] == df
        assert got[source]["f"] == (None if f is None else pytest.approx(f, abs=1e-5))
    assert got["method"]["p"] == pytest.approx(7.806878e-56, rel=1e-4) and got["interaction"]["p"] == pytest.approx(4.722053e-72, rel=1e-4)


def test_published_differences(runs):
    got = {(r["group1"], r["group2"]): r for r in evaluation.tukey(runs, "value", "method")}
    assert got.keys() == PAIRS.keys()
    for pair, (diff, p) in PAIRS.items():
        assert got[pair]["meandiff"] == pytest.approx(diff, abs=6e-5) and got[pair]["p_adj"] == pytest.approx(p, abs=2e-3) and got[pair]["reject"] == (p < 0.05)


def test_type_two_on_unbalanced_rows(spark):
    """Sums of squares by fitting all four models to the rows."""
    r = np.random.default_rng(4)
    a, b = r.integers(0, 4, 150), r.integers(0, 3, 150)
    keep = ~((a == 3) & (b == 2))  # an empty cell
    a, b = a[keep], b[keep]
    v = a * 2.0 - b + a * b * 0.3 + r.normal(size=len(a))
    rows = [(f"a{x}", f"b{y}", float(z)) for x, y, z in zip(a, b, v, strict=True)] + [("a0", None, 9.0), ("a1", "b1", None)]
    got = {x["source"]: x for x in evaluation.two_way(spark.createDataFrame(rows, "a string, b string, v double"), "v", "a", "b")}
    A, B = np.eye(4)[a], np.eye(3)[b]
    AB = np.einsum("ni,nj->nij", A, B).reshape(len(a), -1)
    rss = lambda *x: float(((v - (m := np.hstack(x)) @ np.linalg.lstsq(m, v, rcond=None)[0]) ** 2).sum())
    assert got["a"]["ss"] == pytest.approx(rss(B) - rss(A, B)) and got["b"]["ss"] == pytest.approx(rss(A) - rss(A, B))
    assert got["interaction"]["ss"] == pytest.approx(rss(A, B) - rss(AB)) and got["residual"]["ss"] == pytest.approx(rss(AB))
    assert [got[k]["df"] for k in ("a", "b", "interaction", "residual")] == [3, 2, 5, len(a) - 11]


# ---- tables


def test_helpers_keep_the_columns(spark):
    df = spark.createDataFrame([(1, "b", 7, 8, 9), (2, "a", 7, 8, 9), (3, None, 7, 8, 9), (4, "b", 7, 8, 9)], "i int, c string, value int, number int, before int")
    got = {r["i"]: r for r in table.ordinals(df, "c", "code").collect()}
    assert [got[i]["code"] for i in (1, 2, 3, 4)] == [1, 0, -1, 1] and all((r["value"], r["number"], r["before"]) == (7, 8, 9) for r in got.values())
    got = {r["i"]: r for r in table.encoded(df).collect()}
    assert [got[i]["c"] for i in (1, 2, 3, 4)] == [1, 0, -1, 1] and list(got[1].asDict()) == df.columns
    ranked = {r["i"]: r["rank"] for r in selection.mean_ranks(df.withColumn("n", F.col("i")), "i", "rank").collect()}
    assert ranked == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0}


def test_quantiles_against_numpy(spark):
    r = np.random.default_rng(1)
    x = np.concatenate((np.full(400, 3.0), r.normal(size=301).round(2)))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.02, 0.25, 0.5, 0.731, 1.0]
    assert list(table.quantiles(df, "x", shares).first()) == pytest.approx(np.quantile(x, shares).tolist())
    filled = table.filled(df, ["x"], "median").agg(F.count("x"), F.max("x")).first()
    assert filled[0] == len(x) + 1
    empty = table.filled(df.filter("x is null"), ["x"], "median")
    assert empty.count() == 1 and empty.first()["x"] is None


def test_running_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("w")).repartition(7)
    assert all(r["sum"] == 2 * r["k"] for r in table.running(df, "k", F.col("w"), "sum").collect())
    a, b = spark.range(5).select(F.col("id").alias("x")), spark.range(3).select((-F.col("id")).alias("y"))
    assert sorted(map(tuple, table.zipped(a, b, "x", "y").collect())) == [(0, -2), (1, -1), (2, 0)]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_centres_of_many_values(spark, monkeypatch):
    """Summed where the values are, or by one task: the same centres."""
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(r.normal(size=900) * 30 + 1000, r.integers(0, 40, 900), strict=True)], "a double, b int").repartition(6)
    told = lambda: {x["feature"]: (x["centres"], x["lagged"]) for x in induction.centres_of(df, {"a": 4, "b": 3}).collect()}
    one = told()
    monkeypatch.setattr(induction, "MOST_VALUES", 100)
    two = told()
    assert one["b"] == two["b"] and all(p == pytest.approx(q, abs=1e-6) for p, q in zip(one["a"], two["a"], strict=True))


# ---- neighbours and made rows


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_nearest_rows_by_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(balance, "QUERIES", 7)
    monkeypatch.setattr(balance, "ROWS", 11)
    r = np.random.default_rng(2)
    points = r.integers(0, 6, (120, 2)).astype(float)  # many equal distances
    name = str if kind == "string" else int
    df = spark.createDataFrame([(name(i), *map(float, p)) for i, p in enumerate(points)] + [(name(500), None, 1.0)], f"k {kind}, x double, y double").repartition(4)
    got = {}
    for x in balance.nearest(df.filter("cast(k as int) < 40"), df, "k", ["x", "y"], 5).collect():
        got.setdefault(x["k"], []).append((x["rank"], x["other"], x["d"]))
    for i in range(40):
        d = ((points - points[i]) ** 2).sum(1)
        wanted = sorted((d[j], name(j)) for j in range(120) if j != i)[:5]
        assert [(x[2], x[1]) for x in sorted(got[name(i)])] == wanted


def test_nearest_rows_look_at_few_cells(spark, monkeypatch):
    """Twenty thousand rows, a tenth of them in one place, held against few rows a query; the same rows as by loops."""
    monkeypatch.setattr(balance, "ROWS", 100)
    r = np.random.default_rng(5)
    points = np.concatenate((r.normal(size=(18_000, 3)), np.zeros((2000, 3))))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, x double, y double, z double").repartition(4, "k")
    some = [*range(0, 18_000, 300), 18_001, 18_500]
    got = {}
    for x in balance.nearest(df.filter(F.col("k").isin(some)), df, "k", ["x", "y", "z"], 4).collect():
        got.setdefault(x["k"], []).append((x["d"], x["other"]))
    for i in some:
        d = sum((points[:, c] - points[i, c]) ** 2 for c in range(3))
        assert sorted(got[i]) == [(d[j], j) for j in np.lexsort((np.arange(len(d)), d)) if j != i][:4]
    tree = balance._borders(points, 200)
    assert sum(c < 0 for c, *_ in tree) > 100
    batch = balance.pa.RecordBatch.from_arrays([balance.pa.array(np.arange(len(points))), *(balance.pa.array(c) for c in points.T)], ["key", "x", "y", "z"])
    cells = np.asarray(next(balance._in_cells([batch], tree)).column(0))
    assert np.bincount(cells[:18_000]).max() < 400


def test_made_rows_hold_few_rows_of_a_place(spark, monkeypatch):
    """Both searches of the oversampling keep k + 1 rows of a place, and make as many rows as there are to make."""
    kept, write = [], balance.written
    monkeypatch.setattr(balance, "written", lambda df, name: (t := write(df, name), kept.append((name, t.count())))[0])
    rows = [(i, float(i % 4), 0.0, 2 if i % 4 == 1 and i % 200 < 20 else 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, a double, b double, label int")
    got = balance.borderline(df, "i", ["a", "b"], "label", 2, 30, m=400).collect()
    assert [n for name, n in kept if name == "rows"] == [4 * 401, 6]
    assert len([r for r in got if r["i"] < 0]) == 30 and kept


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_new_keys_are_of_the_keys_type(spark, kind):
    name = str if kind == "string" else int
    x = np.random.default_rng(1).normal(size=(80, 2))
    df = spark.createDataFrame([(name(i - 5), float(a), float(b), 2 if i < 15 else 1) for i, (a, b) in enumerate(x)], f"i {kind}, a double, b double, label int")
    got = balance.borderline(df, "i", ["a", "b"], "label", 2).collect()
    assert len(got) == 130 and len({r["i"] for r in got}) == 130 and sum(r["label"] == 2 for r in got) == 65


def test_overlapping_parts(spark):
    a, b = balance.overlapping(spark.range(2000), "id", 70)
    both = a.join(b, "id").count()
    assert 300 < both < 540 and abs(a.count() - 1400) < 80 and abs(b.count() - 600) < 80


def test_turns_are_summed_up(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(int, r.integers(1, 4, 4)), int(r.integers(1, 3))) for i in range(200)]
    rules = spark.createDataFrame(rows, "rid long, f0 int, f1 int, f2 int, f3 int, label int")
    got = scenario.random_runs(rules.filter("rid < 150"), rules.filter("rid >= 150"), ["f0", "f1", "f2", "f3"], "label", "rid", turns=2)
    assert [t["turn"] for t in got] == [1, 2, "all"] and got[2]["accuracy"] == pytest.approx((got[0]["accuracy"] + got[1]["accuracy"]) / 2)
    assert all(t["sampling_seconds"] >= 0 and t["graph_seconds"] > 0 for t in got) and got[2]["accuracy_deviation"] >= 0


def test_a_stream_goes_on(spark, tmp_path):
    from bramble.streaming.scorer import appended, scored_stream

    rules = spark.createDataFrame([(1, 1, 3)], "rid int, x int, label int")
    rows, out, offsets = (str(tmp_path / n) for n in ("rows", "out", "offsets"))
    for turn, x in enumerate((1.2, 9.0, 0.7)):
        spark.createDataFrame([(turn, x)], "i int, x double").write.mode("append").parquet(rows)
        appended(scored_stream(spark.readStream.schema("i int, x double").parquet(rows), rules, {"x": [1.0, 10.0]}, "label", "rid"), out, offsets)
        assert spark.read.parquet(out).count() == turn + 1
    assert {r["i"]: r["label"] for r in spark.read.parquet(out).collect()} == {0: 3, 1: 0, 2: 3}


# ---- images


def _png(image: np.ndarray, kinds: list, colour: int, extra: bytes = b"") -> bytes:
    """A PNG whose rows are filtered by the given kinds, by the format's own definition."""
    h, w, step = image.shape
    raw, prior = b"", np.zeros((w, step), int)
    for y in range(h):
        kind, line = kinds[y % len(kinds)], image[y].astype(int)
        left, corner = np.vstack((np.zeros((1, step), int), line[:-1])), np.vstack((np.zeros((1, step), int), prior[:-1]))
        p = left + prior - corner
        near = np.abs(p[None] - np.stack((left, prior, corner))).argmin(0)
        guess = [0, left, prior, (left + prior) // 2, np.choose(near, (left, prior, corner))][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        prior = line
    chunk = lambda k, b: struct.pack(">I4s", len(b), k) + b + struct.pack(">I", zlib.crc32(k + b))
    z = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("samples", "colour"), [(1, 0), (2, 4), (3, 2), (4, 6)])
@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_png(samples, colour, kinds):
    image = np.random.default_rng(samples).integers(0, 256, (9, 7, samples)).astype(np.uint8)
    assert (pictures.decoded(_png(image, kinds, colour)) == image[:, :, : 3 if samples > 2 else 1]).all()


def test_other_pictures():
    r = np.random.default_rng(0)
    for channels in (1, 3):
        image = r.integers(0, 256, (5, 6, channels)).astype(np.uint8)
        assert (pictures.decoded(pictures.as_png(image)) == image).all() and (pictures.decoded(pictures.as_portable(image)) == image).all()
    palette = r.integers(0, 256, (4, 3)).astype(np.uint8)
    index = r.integers(0, 4, (3, 5, 1)).astype(np.uint8)
    body = palette.tobytes()
    plte = struct.pack(">I4s", len(body), b"PLTE") + body + struct.pack(">I", zlib.crc32(b"PLTE" + body))
    assert (pictures.decoded(_png(index, [0], 3, plte)) == palette[index[:, :, 0]]).all()
    assert pictures.decoded(b"P2\n# a remark\n2 2\n15\n0 15\n5 10\n")[:, :, 0].tolist() == [[0, 255], [85, 170]]
    broken = bytearray(pictures.as_png(palette.reshape(2, 2, 3)))
    broken[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        pictures.decoded(bytes(broken))
    with pytest.raises(ValueError, match="neither"):
        pictures.decoded(b"GIF89a")


def test_pictures_from_folders(spark, tmp_path):
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / f"{k}1.png").write_bytes(pictures.as_png(image))
    found = files.images(spark, [str(tmp_path / k) for k in "ab"], "*.png")
    rows = pictures.rasters(found).collect()
    assert {r["image_id"] for r in rows} == {"a1", "b1"} and all((r["height"], r["width"], r["channels"]) == (4, 5, 3) and bytes(r["data"]) == image.tobytes() for r in rows)
    grey = {(r["y"], r["x"]): r["v"] for r in pictures.pixels(pictures.rasters(found)).filter("image_id = 'a1'").collect()}
    assert grey[1, 2] == int(0.299 * image[1, 2, 0] + 0.587 * image[1, 2, 1] + 0.114 * image[1, 2, 2] + 0.5) and len(grey) == 20


def test_colours_there_and_back():
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    assert np.abs(rasters.from_lab(rasters.to_lab(image)).astype(int) - image).max() <= 1
    lab = rasters.to_lab(np.array([[[255, 255, 255], [255, 0, 0], [0, 0, 0]]], np.uint8))[0]
    assert lab[0] == pytest.approx([100, 0, 0], abs=0.02) and lab[1] == pytest.approx([53.24, 80.09, 67.20], abs=0.1) and lab[2] == pytest.approx([0, 0, 0])


def test_light_is_spread_and_colour_stays():
    y, x = np.mgrid[:64, :64]
    image = np.clip(np.stack((100 + x / 4, 90 + y / 4, 80 + 0 * x), 2), 0, 255).astype(np.uint8)
    before, after = rasters.to_lab(image), rasters.to_lab(rasters.equalized_light(image))
    assert after[..., 0].std() > 1.1 * before[..., 0].std() and np.abs(after[..., 1:] - before[..., 1:]).mean() < 3


def test_hairs_and_dark_spots():
    image = np.full((60, 60, 3), (200, 180, 160), np.uint8)
    spot = image.copy()
    spot[20:40, 20:40] = (60, 50, 40)
    assert (rasters.darkest_colour(spot) == (spot[:, :, 0] == 60)).all()
    hairy = image.copy()
    hairy[30, :] = hairy[:, 12] = (40, 30, 20)
    assert (rasters.without_hairs_in_colour(hairy) == image).all()
    noisy = np.clip(image + np.random.default_rng(1).normal(0, 6, image.shape), 0, 255).astype(np.uint8)
    error = lambda a: np.abs(a.astype(float) - image).mean()
    assert error(rasters.denoised_colour(noisy, 12.0, 3, 9)) < 0.6 * error(noisy)


def test_blur_by_loops():
    a = np.random.default_rng(3).integers(0, 256, (7, 9)).astype(float)
    k = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1])
    at = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    want = [[np.floor(sum(k[i + 2, j + 2] * a[at(y + i, 7), at(x + j, 9)] for i in range(-2, 3) for j in range(-2, 3)) / 256 + 0.5) for x in range(9)] for y in range(7)]
    assert (rasters.blurred_by_five(a) == np.array(want)).all()


def test_masks_and_subsets(spark):
    px = [(1, y, x, 200 if y < 3 else 10 + x) for y in range(6) for x in range(6)]
    pixels = spark.createDataFrame(px, "image_id long, y int, x int, v int")
    clusters = spark.createDataFrame([(1, y, x, float(x < 2)) for y in range(6) for x in range(6)], "image_id long, y int, x int, v double")
    got = {(r["y"], r["x"]): r["m"] for r in images.both_masks(pixels, clusters).collect()}
    assert got == {(y, x): int(y < 3 and x < 2) for y in range(6) for x in range(6)}
    whole = images.described(pixels).first()
    assert whole["mean"] == pytest.approx(12.5)  # of the pixels outside the mask
    assert images.described(pixels, "glcm").columns == ["image_id", *images.GLCM_FEATURES] and images.described(pixels, "statistical").first()["rms"] == whole["rms"]


def test_forests_of_cells_do_as_forests_of_rows(spark):
    r = np.random.default_rng(8)
    rows = []
    for _ in range(3000):
        a, b, c = int(r.integers(12)), float(r.random()), int(r.integers(3))
        rows.append((a, b, c, int((a > 5) != (b > 0.6)) if r.random() < 0.9 else 2))
    df = spark.createDataFrame(rows, "a int, b double, c int, label int")
    data = selection._binned(df, ["a", "b", "c"], "label", 3, 1)
    assert data.count() == 3000 and data.agg(F.max("x1")).first()[0] == 31
    got = []
    for names in (["x0"], ["x0", "x1"], ["x0", "x1", "x2"]):
        path = shared.fresh_path(spark, "cells")
        data.groupBy("fold", "y", *names).agg(F.count("*").alias("n")).select("fold", "y", "n", *names).write.parquet(path)
        got.append((selection._cell_accuracy(spark.read.parquet(path), path, 3, 3, 40, 1), selection._row_accuracy(data, names, 3, 40, 1)))
    assert all(abs(a - b) < 0.04 for a, b in got) and got[1][0] > 0.85 > got[0][0], got
    with pytest.raises(ValueError):
        selection.forward_wrapper(df.unionByName(df.limit(1).withColumn("b", F.lit(None).cast("double"))), ["a"], ["b"], "label")


def test_wrapper_asks_no_forest_of_rows_where_cells_are_few(spark, monkeypatch):
    from pyspark.ml import tuning

    df = spark.range(400).selectExpr("cast(id % 2 as double) as told", "cast(id % 7 as double) as other", "cast(id % 2 as int) as label")
    monkeypatch.setattr(tuning, "CrossValidator", None)
    assert selection.forward_wrapper(df, ["told"], ["other"], "label", trees=5) == ["told", "other"]
    monkeypatch.undo()
    monkeypatch.setattr(selection, "FOREST_CELLS", 0)
    assert selection.forward_wrapper(df, ["told"], ["other"], "label", folds=2, trees=3) == ["told", "other"]


def test_nearest_rows_of_a_place_are_one_search(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(k, float(k % 4), 0.0) for k in range(40)] + [(0, 0.0, 0.0)] * 9  # and a key that many rows have
    (tmp_path / "cell=0").mkdir()
    pq.write_table(pa.table({"key": [r[0] for r in rows], "x0": [r[1] for r in rows], "x1": [r[2] for r in rows]}), tmp_path / "cell=0/a.parquet")
    calls, sort = [], np.lexsort
    monkeypatch.setattr(balance, "QUERIES", 1)
    monkeypatch.setattr(np, "lexsort", lambda *a, **b: calls.append(1) or sort(*a, **b))

    def near(keys: list) -> dict:
        batch = pa.record_batch({"cell": [0] * len(keys), "key": keys, "x0": [float(k % 4) for k in keys], "x1": [0.0] * len(keys)})
        got: dict[int, list] = {}
        for b in balance._near(iter([batch]), f"file://{tmp_path}", np.array([0]), np.zeros((1, 2)), np.array([[3.0, 0.0]]), 5):
            for r in b.to_pylist():
                got.setdefault(r["key"], []).append((r["d"], r["other"]))
        return got

    def by_loops(keys: list) -> dict:
        return {k: sorted(((k % 4 - x) ** 2, o) for o, x, _ in rows if o != k)[:5] for k in keys}

    many = [k for k in range(1, 40) if k % 4 < 2 and k] * 3
    assert {k: v[:5] for k, v in near(many).items()} == by_loops(many)
    assert len(calls) == 2  # two places
    assert near([0]) == by_loops([0])
