"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bramble.llm import ctw, decontaminate, divergence, keyed_ids, minhash, packing

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(6000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (4, " \n\t ", "en", "a", 1),
    (5, LONG, "en", "b", 9),
    (6, LONG, "de", "b", 9),
    (6, LONG, "de", "b", 9),
    (None, "text without an id and a few words more than ten of them", "en", "c", 1),
    (8, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, hash string, copy long, node long, part int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "h", 2, 3, 4, 0.5) for r in ROWS], COLUMNS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_divergence(docs, none):
    got = divergence.divergent(docs).collect()
    assert len(got) == len(ROWS) and divergence.divergent(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"] and by[5]["n_words"] == 6000


def test_counts_by_hand(spark):
    text = "a b c a b c\nx x\nx x\n\n## a"
    r = divergence.counted(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert (r["n_words"], r["n_dup_lines"], r["n_symbols"], r["word_chars"]) == (12, 1, 2, 13)
    assert r["n_repeat_words"] == 10  # abcabc, and xxxx by two windows that overlap


def test_ctw(docs, none):
    got = ctw.scored(docs).collect()
    assert len(got) == len(ROWS) and ctw.scored(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == 1 and by[2]["score"] == by[3]["score"] < 0 and by[5]["score"] == by[6]["score"] < 0
    assert by[5]["train_tokens"] > 0


def test_ctw_weights_by_hand():
    """Depth-first weighting of one bit tree against the block probabilities."""
    data = np.frombuffer(b"abababab", np.uint8)
    g, n = np.unique(ctw.grams(data, np.array([0, 8]), 2), return_counts=True)
    found = ctw.levels(g, n, 2, 0)
    assert [int(x.n0.sum() + x.n1.sum()) for x in found] == [72, 72, 72]  # eight bytes and the end
    assert all((x.weighted <= 1e-12).all() for x in found)
    a, b, c = np.zeros(len(found[0].key)), np.ones(len(found[0].key)), np.full(len(found[0].key), 0.5)
    every = np.arange(256, dtype=np.uint64) | (np.uint64(ord("b")) << np.uint64(16)) | (np.uint64(ord("a")) << np.uint64(8))
    more, count = np.unique(np.concatenate((g, every)), return_inverse=True)[0], None
    count = np.array([dict(zip(g.tolist(), n.tolist(), strict=True)).get(x, 0) for x in more.tolist()])
    found = ctw.levels(more, count, 2, 0)
    a, b, c = np.zeros(len(found[0].key)), np.ones(len(found[0].key)), np.full(len(found[0].key), 0.5)
    p = 10 ** ctw.code(every, found, 0, 2, a, b, c)
    assert p.sum() == pytest.approx(1.0) and p.argmax() == ord("a")


def test_keyed_ids(spark, docs, none):
    store = keyed_ids.stored(docs, shard_chars=20_000)
    got = store.look_up(store.keys).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 8]
    sizes = [len(r["ids"]) // 4 for r in got]
    assert [r["start"] for r in got] == [0, *np.cumsum(sizes)[:-1].tolist()]
    assert store.look_up(spark.createDataFrame([(77,), (5,)], "doc_id long")).count() == 1
    empty = keyed_ids.stored(none)
    assert empty.look_up(store.keys).count() == 0


def test_perfect_hash():
    keys = keyed_ids.key_hashes(np.arange(10_000), np.zeros(10_000, bool), 2)
    h = keyed_ids.PerfectHash.of(keys)
    assert sorted(h.number(keys).tolist()) == list(range(10_000))


def test_minhash(docs, none):
    rule = minhash.NearCopies(words=4)
    got = minhash.near_copies(docs, rule).collect()
    assert len(got) == len(ROWS) and minhash.near_copies(none, rule).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[8]["component_id"] == 1 and not by[8]["kept"] and by[6]["component_id"] == 5
    assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"] and by[4]["component_id"] == 4
    assert by[None]["component_id"] is None and by[None]["kept"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (60, 70), (45, 70)]
    got = {r["label"]: r["root"] for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and all(got[i] == 45 for i in (45, 50, 60, 70))


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again. And again"), (2, None), (3, ""), (4, "nothing like it is in any of these texts at all")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (8, 1)}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items).count() == len(ROWS) - 2


def test_packing(docs, none):
    got = packing.packed(docs, capacity=64).toPandas()
    assert packing.packed(none).count() == 0
    assert got.groupby("sequence_id").length.sum().max() <= 64 and (got.groupby("doc_id", dropna=False).piece.min() == 0).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()


@pytest.mark.parametrize("seed", range(6))
def test_reduction_keeps_the_optimum(seed):
    """Fixed sets plus an exact search of the rest need no more bins than an exact search of everything."""
    r = np.random.Generator(np.random.PCG64(seed))
    capacity, items = 20, r.integers(1, 15, 11).tolist()

    def best(left: tuple) -> int:
        bins = [len(left)]

        def go(i: int, room: list) -> None:
            if len(room) >= bins[0]:
                return
            if i == len(left):
                bins[0] = len(room)
                return
            for k in {x: j for j, x in enumerate(room)}.values():
                if room[k] >= left[i]:
                    room[k] -= left[i]
                    go(i + 1, room)
                    room[k] += left[i]
            go(i + 1, [*room, capacity - left[i]])

        go(0, [])
        return bins[0]

    counts = np.bincount(items, minlength=capacity + 1)
    fixed, left = packing.reduced(counts, capacity)
    rest = tuple(sorted((s for s, n in enumerate(left) for _ in range(n)), reverse=True))
    assert sum(n for _, n in fixed) + best(rest) == best(tuple(sorted(items, reverse=True)))
    assert sum(n for _, n in packing.solved(counts, capacity)) >= -(-sum(items) // capacity)


def test_tokenizers_go_with_tasks_that_use_none():
    from bramble.llm import common

    path = common.tokenizer_path("byte_bpe_50k.json")
    encodes, plain = common.tidy(lambda: iter([common.encoder(path)])), common.tidy(lambda: iter([1]))
    (first,), (again,) = list(encodes()), list(encodes())
    assert first is again  # pieces stay for the next task of the kind
    assert list(plain()) == [1] and not common._ENCODERS
    common._ASKED.clear()
