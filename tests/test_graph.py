"""The set-based graph against loops over pairs of rules."""

import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from bramble.operators import graph

F5 = ["f0", "f1", "f2", "f3", "f4"]


def _loops(base, n_class):
    n, quads, triples = len(base), list(combinations(range(5), 4)), list(combinations(range(5), 3))
    shared = [sum(all(r[i] == o[i] for i in q) for q in quads for o in base) for r in base]
    m = [[sum(o[i] == r[i] and o[5] == r[5] for o in base) for i in range(5)] for r in base]
    b = [[shared[k] * min(m[k][i] for i in t) for t in triples] for k in range(n)]
    c = [[[sum(b[o][t] for o in range(n) if base[o][5] == l + 1 and all(base[o][i] == base[r][i] for i in s)) for l in range(n_class)] for t, s in enumerate(triples)] for r in range(n)]
    for t in range(len(triples)):
        for l in range(n_class):
            col = [c[r][t][l] for r in range(n)]
            lo, hi = min(col), max(col)
            for r in range(n):
                c[r][t][l] = (c[r][t][l] - lo) / (hi - lo) if hi > lo else 0.0
    return triples, c


def _infer(base, triples, c, row, n_class):
    d = []
    for l in range(n_class):
        own = [next((c[r][t][l] for r in range(len(base) - 1, -1, -1) if base[r][5] == l + 1 and all(base[r][i] == row[i] for i in s)), 0.0) for t, s in enumerate(triples)]
        d.append(max(own) + min(own))
    best = max(range(n_class), key=lambda l: (d[l], -l))
    return best + 1, d[best] / sum(d) if sum(d) else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_inference(spark, seed):
    r = random.Random(seed)
    row = lambda: [r.randint(1, 3) for _ in range(5)] + [r.randint(1, 3)]
    base, asked = [row() for _ in range(25)], [row()[:5] for _ in range(12)]
    df = spark.createDataFrame([tuple(x) for x in base], ", ".join(f"{c} int" for c in [*F5, "label"]))
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "qid int, " + ", ".join(f"{c} int" for c in F5))
    scores = graph.normalized(graph.model(graph.checked(df, F5, "label"), F5, "label"), "label")
    got = {x["qid"]: (x["predicted"], x["confidence"]) for x in graph.inferred(q, scores, F5, "label").collect()}
    triples, c = _loops(base, 3)
    for i, x in enumerate(asked):
        want = _infer(base, triples, c, x, 3)
        assert got[i][0] == want[0] and abs(got[i][1] - want[1]) < 1e-9


def test_guards(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0)], "f0 int, f1 int, f2 int, f3 int, label int")
    with pytest.raises(ValueError):
        graph.checked(df, ["f0", "f1", "f2"], "label")
    with pytest.raises(Exception, match="labels start at 1"):
        graph.checked(df, ["f0", "f1", "f2", "f3"], "label").collect()


def _drawn(rows, percent, e, k):
    """rows: (hash, bins..., label) in order; the draws one by one."""
    alike = lambda a, b: a[-1] == b[-1] and (sum(x == y for x, y in zip(a[1:-1], b[1:-1], strict=True)) + 1) / (len(a) - 1) >= 1 - e
    kept, want = [], int(len(rows) * percent / 100)
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        near = sorted(range(max(0, i - k), min(len(rows), i + k + 1)), key=lambda j: (abs(j - i), j))
        for j in near:
            if len(kept) < want and (j == i or not alike(rows[j], rows[i])) and not any(alike(rows[j], rows[o]) for o in kept):
                kept.append(j)
    return kept


@pytest.mark.parametrize(("part", "k", "percent"), [(5000, 2, 20), (15, 2, 20), (15, 0, 20), (15, 2, 4)])
def test_sample_is_diverse_across_parts(spark, part, k, percent):
    r = random.Random(7)
    rules = spark.createDataFrame([(3 * i, *(r.randint(1, 4) for _ in range(5)), r.randint(1, 2)) for i in range(600)], ", ".join(f"{c} int" for c in ["rid", *F5, "label"]))
    rows = [tuple(x) for x in rules.orderBy("rid").select(F.xxhash64("rid", F.lit(1)), *F5, "label").collect()]
    got = [x["rid"] // 3 for x in graph.sampled(rules, F5, "label", "rid", percent, 0.2, 1, k=k, part=part).collect()]
    assert got == _drawn(rows, percent, 0.2, k)
