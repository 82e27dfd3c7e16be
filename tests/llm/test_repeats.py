"""Removed passages against loops over all windows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bramble.llm import common, repeats

SMALL = dict(chunk_chars=3000, bucket_chars=2000)


def by_loops(rows: list) -> list:
    """(words, whether each goes) of rows in the order of doc_id."""
    seen, out = set(), []
    for _, t in rows:
        w, gone = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" "), set()
        w = [x for x in w if x]
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if g in seen else set()
            seen.add(g)
        out.append((w, [k in gone for k in range(len(w))]))
    return out


def _rows(seed: int) -> list:
    r = np.random.Generator(np.random.PCG64(seed))
    base = [f"w{i}" for i in r.integers(0, 50, 400)]
    rows = [(0, None), (1, "")]
    for i in range(2, 40):
        a, n = r.integers(0, 300, 2)
        words = [*(f"u{i}_{k}" for k in range(r.integers(0, 15))), *base[a : a + n // 3], *base[a : a + n // 4]]
        rows.append((i, "".join(w + r.choice([" ", "\n", "  ", "\t\r\n", " "]) for w in words)))
    rows.append((40, "é " * 60))  # windows that overlap their own kind
    rows.append((41, " ".join(f"l{k % 30_011}" for k in range(60_000))))  # longer than a chunk, and it repeats itself
    rows.append((42, " ".join(f"l{k % 30_011}" for k in range(9))))
    return rows


@pytest.mark.parametrize(("seed", "fan"), [(1, 4096), (2, 4096), (1, 3), (2, 1)])
def test_windows_by_loops(spark, seed, fan):
    """By rows of single cells and by blocks of them."""
    rows = _rows(seed)
    got = {x["doc_id"]: x for x in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), repeats.Repeats(fan=fan, **SMALL)).collect()}
    assert len(got) == len(rows)
    for (i, _), (w, gone) in zip(rows, by_loops(rows), strict=True):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert got[i]["kept_text"] == " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def test_cut_out_of_the_text(spark):
    rows = _rows(3)
    names = ["copy", "chunk", "n_words", "n_removed", "kept_text", "rest", "bucket", "a.b"]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    got = {x["doc_id"]: x for x in repeats.without_repeats(df, repeats.Repeats(cut_out=True, **SMALL), carried=names).collect()}
    for (i, t), (w, gone) in zip(rows, by_loops(rows), strict=True):
        assert got[i]["kept_text"].split() == [x for x, g in zip(w, gone, strict=True) if not g]
        assert list(got[i]["rest"]) == list(range(8)) and got[i]["rest"].asDict().keys() == set(names)
        if not any(gone):
            assert got[i]["kept_text"] == (t or "")
    # Lines around a passage stay lines.
    passage = " ".join(f"p{k}" for k in range(25))
    two = spark.createDataFrame([(1, passage), (2, f"one\n two  three\n{passage}\n\nfour\nfive")], "doc_id long, text string")
    by = {x["doc_id"]: x["kept_text"] for x in repeats.without_repeats(two, repeats.Repeats(cut_out=True)).collect()}
    assert by == {1: passage, 2: "one\n two  three\nfour\nfive"}


def test_ties_and_nulls(spark):
    """Rows without doc_id come first; equal rows are one document; equal ids go by their texts."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, passage), (3, passage), (3, passage), (4, "x"), (5, f"{passage} a"), (5, f"{passage} b")]
    got = [(x["doc_id"], x["n_removed"]) for x in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0), (3, 30), (3, 30), (4, 0), (5, 30), (5, 30)], key=repr)
    first = [(1, passage), (1, passage), (2, "y")]
    got = [(x["doc_id"], x["n_removed"]) for x in repeats.without_repeats(spark.createDataFrame(first, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize(("work", "most"), [("_probe", 32), ("_taken_out", 8)])
def test_a_chunk_takes_little_memory_and_leaves_in_small_batches(tmp_path, work, most):
    """Beside another task and a full JVM: most bytes of arrays a word, and batches of a part of the chunk."""
    r = np.random.Generator(np.random.PCG64(5))
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 500)) for _ in range(2400)]
    n = len(texts)
    table = pa.table({"chunk": pa.array([0] * n, pa.int32()), "doc_id": pa.array(range(n), pa.int64()), "text": texts, "copy": pa.array(range(n), pa.int64())})
    cells = lambda of, to, *fields: common.Exchange(of, to, 4, 4096, fields)
    hits, firsts = cells("bucket", "chunk", ("hashes", "binary")), cells("bucket", "chunk", ("bits", "binary"))
    args = {"out": cells("chunk", "bucket", ("hashes", "binary"), ("marks", "binary"))} if work == "_probe" else {"hits": hits, "firsts": firsts}
    side = {} if work == "_probe" else {"hits": str(tmp_path), "firsts": str(tmp_path)}
    largest = total = 0
    tracemalloc.start()
    try:
        for batch in common.by_chunk(iter(table.to_batches(max_chunksize=500)), getattr(repeats, work), side, {"rule": repeats.Repeats(), "n_buckets": 4, **args}):
            largest, total = max(largest, batch.nbytes), total + batch.nbytes
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total > 4_000_000 and largest < 0.5 * total
    # Besides, a block of text has its own arrays, as large as they are for any chunk.
    assert peak < most * 500 * n + 40 * common.BLOCK_BYTES, peak / 500 / n
