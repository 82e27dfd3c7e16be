import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.functions import membership as mf
from bramble.operators import balance, evaluation, induction, selection, table
from bramble.sources import files


def test_spread(spark):
    df = spark.createDataFrame([([0.24307, 0.4, 0.69053],), ([1.0, 1.0],)], "c array<double>")
    got = [r[0] for r in df.select(mf.spread(F.col("c"))).collect()]
    assert got[0] == pytest.approx(1.9002, abs=1e-3) and got[1] is None


def test_terms(spark):
    df = spark.range(1, 6)
    assert [r[0] for r in df.select(mf.term(F.col("id"), 5)).collect()] == ["Very Low", "Low", "Medium", "High", "Very High"]
    for k in (1, 6):
        with pytest.raises(ValueError):
            mf.term(F.col("id"), k)


def test_fuzzy_means_by_hand():
    x, n = np.array([0.0, 1.0, 9.0, 10.0]), np.ones(4)
    centres, lagged = induction.fuzzy_means(x, n, induction.first_centres(0, 10, 2))
    assert centres == pytest.approx([0.5, 9.5], abs=0.05) and lagged == pytest.approx(centres, abs=0.2)
    doubled, _ = induction.fuzzy_means(np.repeat(x, 2), np.ones(8), induction.first_centres(0, 10, 2))
    weighted, _ = induction.fuzzy_means(x, 2 * n, induction.first_centres(0, 10, 2))
    assert doubled == pytest.approx(weighted)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double")
    value = lambda how: [r["x"] for r in table.scaled(df, ["x"], how).collect()]
    assert value("minmax") == [None, None] and value("minmax0") == [0.0, 0.0] and value("zscore") == [0.0, 0.0]


def test_tails():
    assert evaluation.f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert evaluation.studentized_tail(3.877, 3, 10) == pytest.approx(0.05, abs=2e-3)


def test_two_way(spark):
    rows = [(a, b, float(i * i + 3 * j + k)) for i, a in enumerate("xyz") for j, b in enumerate("pq") for k in range(4)]
    got = {r["source"]: r for r in evaluation.two_way(spark.createDataFrame(rows, "a string, b string, v double"), "v", "a", "b")}
    v = np.array([r[2] for r in rows]).reshape(3, 2, 4)
    assert got["a"]["ss"] == pytest.approx(8 * ((v.mean((1, 2)) - v.mean()) ** 2).sum())
    assert got["residual"]["ss"] == pytest.approx(((v - v.mean(2, keepdims=True)) ** 2).sum()) and got["residual"]["df"] == 18
    assert got["interaction"]["ss"] == pytest.approx(0, abs=1e-9) and 0 <= got["a"]["p"] < 1e-4


def test_splits_are_apart(spark):
    a, b = balance.split(spark.range(1000), "id", 70, 3)
    assert a.join(b, "id").count() == 0 and a.count() + b.count() == 1000 and 600 < a.count() < 800


@pytest.mark.parametrize(("wanted", "made"), [(None, 340), (17, 17), (0, 0)])
def test_oversampling_to_parity(spark, wanted, made):
    x = np.random.default_rng(1).normal(size=(500, 2))
    rows = [(i, float(a), float(b), 2 if i < 60 else 3 if i < 100 else 1) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, a double, b double, label int")
    got = balance.borderline(df, "i", ["a", "b"], "label", 2, *([] if wanted is None else [wanted])).collect()
    new = [r for r in got if r["i"] < 0]
    assert len(got) == 500 + made and len(new) == len({r["i"] for r in new}) == made and {r["label"] for r in new} <= {2}
    own = x[:60]
    assert all(own[:, 0].min() <= r["a"] <= own[:, 0].max() and own[:, 1].min() <= r["b"] <= own[:, 1].max() for r in new)


def test_filter_passes_distinct_noise_over(spark):
    r = np.random.default_rng(2)
    rows = [(float(r.normal()), float(round(r.normal() + 2 * (i % 2), 1)), float(r.normal() + i % 2), i % 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "noise double, coarse double, shifted double, label int")
    mi = {x["feature"]: x["mi"] for x in selection.neighbour_information(df, ["noise", "coarse", "shifted"], "label").collect()}
    # Normal classes 2 and 1 deviations apart share 0.337 and 0.112 nats with the label.
    assert mi["noise"] < 0.06 and mi["coarse"] == pytest.approx(0.337, abs=0.06) and mi["shifted"] == pytest.approx(0.112, abs=0.06)
    assert selection.filter_multimodal(df, ["noise", "coarse"], ["shifted"], "label", 1, 1) == ["coarse", "shifted"]


@pytest.mark.parametrize("places", [0, 1, 12])
def test_neighbour_information_against_loops(spark, places):
    r = np.random.default_rng(places)
    x, y = np.round(r.normal(size=80) * 2 + 1e3, places), r.integers(0, 3, 80)
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    want = psi(80)
    for i in range(80):
        own, every = np.abs(x[y == y[i]] - x[i]), np.abs(x - x[i])
        d = np.sort(own)[3]
        ball = lambda v: int(((v < d) | (v == 0)).sum())
        want += (psi(ball(own)) - psi(ball(every)) - psi(len(own))) / 80
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, label int")
    assert selection.neighbour_information(df, ["x"], "label").first()["mi"] == pytest.approx(max(0.0, want), abs=1e-6)


def test_neighbour_information_over_ranges(spark, monkeypatch):
    """The same figure from many ranges as from one, with a rare class, whose balls reach over several ranges."""
    r = np.random.default_rng(6)
    x, y = np.round(r.normal(size=600), 2), np.where(r.random(600) < 0.02, "rare", np.where(r.random(600) < 0.5, "a", "b"))
    df = spark.createDataFrame([(float(a), float(a * 3 + i % 7), str(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(0.5, None, "once")], "x double, z double, label string")
    told = lambda: {f: mi for f, mi in selection.neighbour_information(df, ["x", "z"], "label").collect()}
    one = told()
    monkeypatch.setattr(selection, "RANGE", 40)
    assert told() == pytest.approx(one, abs=1e-12) and set(one) == {"x", "z"}
    assert one["x"] == pytest.approx(_loops(x, y), abs=1e-6)


def _loops(x, y, k=3):
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    total = psi(len(x))
    for v, c in zip(x, y, strict=True):
        own, every = np.abs(x[y == c] - v), np.abs(x - v)
        d = np.sort(own)[k]
        total += (psi(int(((own < d) | (own == 0)).sum())) - psi(int(((every < d) | (every == 0)).sum())) - psi(len(own))) / len(x)
    return max(0.0, total)


def test_wrapper_takes_one_of_each_kind(spark):
    r = np.random.default_rng(3)
    rows = [(float(i % 2), float(r.normal()), float(r.normal()), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "told double, noise double, other double, label int")
    assert selection.forward_wrapper(df, ["noise", "told"], ["other"], "label", folds=2, trees=5)[:2] == ["told", "other"]


def test_principal_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(50, 3)) * [3, 2, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = np.array([[r["pc0"], r["pc1"]] for r in selection.principal(df, ["a", "b", "c"], ["i"], 2).orderBy("i").collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert (got**2).sum(0) == pytest.approx(s[:2] ** 2)


def test_model_folder(spark, tmp_path):
    rules = spark.createDataFrame([(1, 2)], "f0 int, label int")
    files.save_model({"rules": rules}, str(tmp_path / "m"))
    assert files.load_model(spark, str(tmp_path / "m"), ["rules"])["rules"].collect() == rules.collect()
    files.append_metrics(rules, str(tmp_path / "log"))
    files.append_metrics(rules, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_image_folder(spark, tmp_path):
    (tmp_path / "img00001.jpg").write_bytes(b"x")
    assert [r["image_id"] for r in files.images(spark, str(tmp_path)).collect()] == ["img00001"]


def test_stream(spark, tmp_path):
    from bramble.streaming.scorer import scored_stream

    spark.createDataFrame([(1, 2.0), (2, 9.0)], "i int, x double").write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(1, 1, 3)], "rid int, x int, label int")
    stream = spark.readStream.schema("i int, x double").parquet(str(tmp_path / "in"))
    q = scored_stream(stream, rules, {"x": [1.0, 10.0]}, "label", "rid").writeStream.format("memory").queryName("told").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["i"], r["label"]) for r in spark.sql("select i, label from told").collect()} == {(1, 3), (2, 0)}
