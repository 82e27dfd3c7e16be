"""The network against plain loops and finite differences, its training against what labels say, and held-out rows."""

import math
import os
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bramble.llm import toxicity as tx

RULE = tx.Rule(window=5, stride=2, hidden=3, attention=2, vector=2, vector_bits=6, table_bits=10, steps=40, docs_per_class=30, least_docs=1)


def _net() -> tx.Network:
    net = tx.Network(RULE)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.Generator(np.random.PCG64(1))
    net.p["c"] += 0.3
    for k in ("bf", "bb"):
        net.p[k] += r.standard_normal(len(net.p[k])) / 3
    return net


def _inputs() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(0))
    f, at = r.standard_normal((7, tx.FEATURES + 2 * RULE.vector)), r.integers(0, 7, (4, 5))
    f[-1], at[:, 0], at[0, 3:] = 0, 1, 6
    return f, at


def test_forward_by_loops():
    net, (f, at) = _net(), _inputs()
    p, h = net.p, 3
    sig = lambda x: 1 / (1 + math.exp(-x))

    def layer(d: str, steps: list) -> list:
        state, out = [0.0] * h, []
        for w in steps:
            if w != 6:
                x, g = f[w] @ p[f"W{d}"] + p[f"b{d}"], np.array(state) @ p[f"U{d}"]
                z, r = ([sig(x[i * h + k] + g[i * h + k]) for k in range(h)] for i in (0, 1))
                n = [math.tanh(x[2 * h + k] + r[k] * g[2 * h + k]) for k in range(h)]
                state = [z[k] * state[k] + (1 - z[k]) * n[k] for k in range(h)]
            out.append(state)
        return out

    for row, got in zip(at.tolist(), net.logits(f, at), strict=True):
        both = [np.array(a + b) for a, b in zip(layer("f", row), layer("b", row[::-1])[::-1], strict=True)]
        e = [math.exp(np.tanh(s @ p["A"]) @ p["v"]) if w != 6 else 0.0 for s, w in zip(both, row, strict=True)]
        pooled = sum(a / sum(e) * s for a, s in zip(e, both, strict=True))
        assert got == pytest.approx(float(pooled @ p["w"] + p["c"][0]), abs=1e-9)


def test_gradient():
    net, (f, at) = _net(), _inputs()
    y = np.array([1, 0, 1, 0])

    def loss() -> float:
        p = tx._sigmoid(net.logits(f, at))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    g = net.gradient(f, at, y)
    for k, x in (net.p | {"X": f[:-1]}).items():
        flat = x.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 9)):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-4 == pytest.approx(np.asarray(g[k]).reshape(-1)[i], abs=1e-6), k


def test_windows_overlap_and_cover():
    row = np.array([0, 0, 3, 16])
    at, owner = tx.windows(row, np.arange(16), 16, RULE)
    assert owner.tolist() == [0, 1] + [2] * 5
    assert set(at[owner == 0].ravel()) == {16} and at[owner == 1].tolist() == [[0, 1, 2, 16, 16]]
    assert [x[0] for x in at[owner == 2].tolist()] == [3, 5, 7, 9, 11] and set(at[owner == 2].ravel()) == set(range(3, 16))


WORDS = [f"{a}{b}" for a in ("kel", "mor", "tin", "sab") for b in ("ra", "to", "lin", "u", "gest")]


def _texts(n: int) -> list:
    r = np.random.Generator(np.random.PCG64(6))
    out = []
    for i in range(n):
        w = r.choice(WORDS, r.integers(0, 40)).tolist()
        if i % 3 == 0:
            w.insert(int(r.integers(0, len(w) + 1)), "grobax" + r.choice(["", "en", "t"]))
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_words_it_never_met_are_known_by_their_characters():
    rows = _texts(240)
    model = tx.trained([t for _, t, _ in rows], np.array([y for *_, y in rows]), replace(RULE, vector_bits=12, table_bits=16, docs_per_class=200, steps=150))
    s = model.scores(pa.array(["kelra morto GROBAXUM tinlin", "kelra morto tinlin", "", " ".join(["morto"] * 3000 + ["grobaxt"])]))
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 < s[3]


def test_edges(spark):
    """Nulls, doc_ids with two texts or none, labels of no row, long texts, equal rows, clashing columns, empty tables."""
    texts = _texts(90)
    rows = [(i, t) for i, t, _ in texts] + [(None, "kelra grobax"), (200, None), (201, ""), (3, "another text"), (202, "morto " * 900_000), *[(203 + k, "x" * 20_001) for k in range(40)], (5, texts[5][1])]
    docs = spark.createDataFrame([(*r, 1, 0.5, "s") for r in rows], "doc_id long, text string, toxic int, score double, label string")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in texts] + [(None, 1, "t"), (3, 0, "t"), (999, 1, "t"), (200, None, "t"), (7, 5, "t"), *[(203 + k, 1, "t") for k in range(40)]], "doc_id long, toxic int, text string")
    model = tx.fitted(docs, labels, RULE)
    got = tx.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1 and tx.scored(docs.limit(0), model).count() == 0
    left = tx.clean(docs, model)
    assert left.columns == docs.columns and left.filter("doc_id = 200").first()["text"] is None
    gone = {(r["doc_id"], r["score"] >= 0.5) for r in got}
    assert {(r["doc_id"], False) for r in left.select("doc_id").collect()} <= gone and left.count() == sum(r["score"] < 0.5 for r in got)
    # Texts beyond max_chars take no place in the sample: as without them.
    few = labels.filter("doc_id is null or doc_id < 203")
    again = tx.fitted(docs, few, RULE)
    assert (again.words == model.words).all() and again.shift == model.shift
    nothing = tx.fitted(docs, labels.limit(0), RULE)
    assert {r["score"] for r in tx.scored(docs, nothing).collect()} == {0.0} and tx.clean(docs, nothing).count() == len(rows)
    assert {r["score"] for r in tx.scored(docs, tx.fitted(docs, labels.filter("toxic = 1 and doc_id < 200"), RULE)).collect()} == {1.0}
    assert tx.fitted(docs.limit(0), labels, RULE).network is None


def test_held_out_rows(spark):
    """On all held-out labels of sf0.1 the network ranks better than any plain use of the statistics that it is given."""
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fitted(docs, labels)
    rows = docs.join(labels.filter(tx.held_out()).select("doc_id", "toxic"), "doc_id").select(F.coalesce("text", F.lit("")), "toxic").collect()
    y = np.array([r["toxic"] for r in rows])

    def auc(s: np.ndarray) -> float:
        _, which, n = np.unique(s, return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[which]
        return float((rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (y == 0).sum()))

    plain = []
    for text, _ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        w = tx._Words(data, np.array([0, len(data)]), model.rule.table_bits)
        f = w.features(model.words[w.bucket], model.grams[w.gram])[w.which, :3] if len(w.which) else np.zeros((1, 3))
        plain.append([*f.max(0), *f.mean(0)])
    score = model.scores(pa.array([t for t, _ in rows]))
    best = max(auc(c) for c in np.array(plain).T)
    assert auc(score) > best + 0.005 and auc(score) > 0.95
    assert ((score >= 0.5) == (y == 1)).mean() > 0.96 and (score[y == 0] >= 0.5).mean() < 0.025
