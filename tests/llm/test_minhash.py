"""Components against all pairs by their exact similarity."""

import os
import random

import duckdb
import pytest

from bramble.llm import minhash, oracles

RULE = minhash.NearCopies(words=4)


def by_all_pairs(rows: list, n: int = 4) -> dict:
    """doc_id to (set size, component), by comparing all pairs of sets of n-word shingles."""
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() and c.isalpha() else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def _texts(seed: int) -> list:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 90))]
        for _ in range(r.choice((1, 2, 3, 40))):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 18))):  # some of these are right about the limit
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if r.random() < 0.1 else "  ".join(w))
    rows += [f"{passage} {' '.join(word() for _ in range(r.randint(10, 60)))}" for _ in range(60)]  # a passage in common, mostly not enough
    rows += [rows[0]] * 30 + ["", " \t", None, "one two", "one  two", "one two three"]
    r.shuffle(rows)
    return [(10 * k + 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_by_all_pairs(spark, seed):
    rows = _texts(seed)
    got = minhash.near_copies(spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, node int, digest string"), RULE).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_all_pairs(rows) and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_hot_group(spark):
    """Six hundred texts of one family: every one differs from the first by a word or two of sixty."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(f"x{r.randrange(99)}" if k == i % 60 else w for k, w in enumerate(base))) for i in range(600)]
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()
    wanted = by_all_pairs(rows)
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: c for i, (_, c) in wanted.items()}


def test_a_text_of_five_megabytes(spark):
    long = " ".join(f"w{k % 4001}v{k % 977}" for k in range(500_000))
    rows = [(1, long), (2, long + " more"), (3, "no such text"), (None, long)]
    got = {x["doc_id"]: x for x in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()}
    assert got[2]["component_id"] == 1 and got[3]["kept"] and got[None]["kept"] and got[1]["n_shingles"] > 499_000


def test_components_of_stars_and_chains(spark):
    links = [(1, k) for k in range(2, 400)] + [(400 + k, 401 + k) for k in range(60)] + [(399, 460), (900, 901), (901, 902), (900, 902)]
    got = {r["label"]: r["root"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(k, 1) == 1 for k in range(1, 461)) and {got.get(k, 900) for k in (900, 901, 902)} == {900}


def test_test_table_by_sql(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = sorted(tuple(r) for r in minhash.near_copies(docs, RULE).select("doc_id", "n_shingles", "component_id", "kept").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(con.execute(oracles.NEAR_COPIES).fetchall())


@pytest.mark.parametrize("paired", [1, 64])
def test_buckets_of_any_size_by_all_pairs(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    rows = _texts(3)
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_all_pairs(rows)


def test_prefixes_leave_few_pairs(spark):
    """Sets of 100 with 60 in common are no pairs where those come late in the order; all similar ones are."""
    r = random.Random(5)
    common = [r.getrandbits(62) for _ in range(60)]
    sets = [(i, [*common, *(r.getrandbits(62) for _ in range(40))]) for i in range(80)]
    sets += [(100 + i, [*s[:95], *(r.getrandbits(62) for _ in range(5))]) for i, s in sets[:20]]
    pool = spark.createDataFrame(sets, "node long, shingles array<long>")
    got = {(x["a"], x["b"]) for x in minhash._by_prefix(pool.selectExpr("node", "node as l"), pool, RULE).collect()}
    assert {(i, 100 + i) for i in range(20)} <= got and len(got) < 60


def test_shingles_of_what_is_left_are_counted_without_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRED", 4)  # so that the last join goes by shingles
    ran = lambda: (x := spark._jsparkSession.sharedState().statusStore().executionsList()) and {x.apply(k).executionId(): x.apply(k).physicalPlanDescription() for k in range(x.size())}
    before, rows = max(ran(), default=-1), _texts(3)
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), RULE).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == by_all_pairs(rows)
    plans = [p for k, p in ran().items() if k > before]
    assert any("before#" in p for p in plans) and not any("explode(shingles" in p for p in plans)


def test_counters_by_slices_are_those_of_all_members(spark):
    r = random.Random(5)
    sets = [[r.randrange(-(2**63), 2**63) for _ in range(r.randint(0, 300))] for _ in range(200)] + [[7, 1 << 13, 7 - (1 << 20)]] * 50
    want = [0] * (1 << 14)
    for s in sets:
        for x in s:
            want[x % (1 << 14)] += 1
    df = spark.createDataFrame([(s,) for s in sets], "shingles array<long>")
    assert minhash._rarities(df.repartition(7), 1 << 14).tolist() == want
    assert not minhash._rarities(df.limit(0), 1 << 14).any()
