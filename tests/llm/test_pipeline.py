"""The whole pipeline against plain versions of its stages, on one small table with everything in it."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain
from test_minhash import by_all_pairs
from test_repeats import by_loops
from tokenizers import Tokenizer

import corpus_pipeline
from bramble.llm import decontaminate, toxicity

R = random.Random(12)
WORDS = ["".join(R.choice("abdeiknorst") for _ in range(R.randint(2, 8))) for _ in range(900)]
words = lambda n: R.choices(WORDS, k=n)
ITEMS = [(k if k else None, " ".join(["What", "is", *words(15)]) + "? " + " ".join(words(6)) + ".") for k in range(6)]
CLASH = ["copy", "chunk", "n_words", "n_removed", "kept_text", "rest", "bucket", "node", "digest", "m", "h", "shared", "score", "toxic", "a.b", "length", "piece"]


def _documents() -> list:
    rows = []
    for i in range(70):
        w = words(R.randint(30, 120))
        if i % 5 == 0:
            w.insert(R.randrange(len(w)), "zzvile")
        rows.append([i, " ".join(w)])
    passage = words(60)
    for i in range(70, 80):
        rows.append([i, " ".join(words(25)) + "\n" + " ".join(passage) + "\n\n" + " ".join(words(25)) + "\nlast  line"])
    for i in range(80, 90):
        w = rows[i - 79][1].split()
        w[R.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w)])
    for i in range(90, 96):
        rows.append([i, " ".join(words(40)) + " " + ITEMS[i - 90][1] + " " + " ".join(words(40))])
    rows += [[96, None], [97, ""], [98, " \n\t"], [None, rows[2][1]], [None, " ".join(words(50)) + " " + ITEMS[2][1]], [None, "alone without an id"], [None, "alone without an id"]]
    rows += [[3, rows[3][1]], [3, rows[3][1]], [99, "two texts of one id"], [99, "the other text of that id"], [100, " ".join(words(900_000))]]
    return rows


ROWS = _documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASH)
    rows = [(*r, "en", "s", len(r[1] or ""), *range(len(CLASH))) for r in ROWS]
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{d}/documents.parquet")
    toxic = {r[0]: int("zzvile" in (r[1] or "")) for r in ROWS if r[0] is not None and r[0] < 90}
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([*ITEMS, (9, None), (10, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage returned, and the columns."""
    out, written = [], corpus_pipeline.common.written

    def kept(df, name, options=None):
        df = written(df, name, options)
        if name.startswith("stage-"):
            out.append(df)
        return df

    corpus_pipeline.common.written = kept
    try:
        corpus_pipeline.run(spark, folder)
    finally:
        corpus_pipeline.common.written = written
    return out


def _rows(df) -> list:
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_columns_stay(spark, folder, stages):
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    for df in stages[:-1]:
        assert df.dtypes == whole.dtypes
        for r in df.collect():
            assert list(r)[5:] == list(range(len(CLASH))) and r["n_chars"] == len(r["text"] or "")


def test_toxic_documents_go(spark, folder, stages):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.fitted(docs, labels).scores(pa.array([t or "" for _, t in ROWS]))
    left = _rows(stages[0])
    assert left == sorted([tuple(r) for r, s in zip(ROWS, scores, strict=True) if s < 0.5], key=repr)
    assert not any("zzvile" in (t or "") for _, t in left) and len(left) >= sum("zzvile" not in (t or "") for _, t in ROWS) - 2  # few to learn from


def test_one_of_each_group_stays(stages):
    """The smallest doc_id; rows without one, or with one of several texts, are documents by their texts, behind the others."""
    before = [r for r in _rows(stages[0])]
    texts = {i: {t for k, t in before if k == i} for i, _ in before}
    names = sorted({(i is None or len(texts[i]) > 1, i if i is not None and len(texts[i]) == 1 else None, t or "") for i, t in before}, key=repr)
    order = sorted(names, key=lambda x: (x[0], x[1] if x[1] is not None else 0))
    numbers = {name: k for k, name in enumerate(order)}
    groups = by_all_pairs([(k, name[2]) for name, k in numbers.items()], 5)
    after = _rows(stages[1])
    kept = {(order[c][1], order[c][2]) for _, c in groups.values() if not order[c][0]}
    assert {(i, t or "") for i, t in after if i is not None and len(texts[i]) == 1} == kept
    # Of a group without any doc_id of its own one row stays, whichever it is.
    assert len(after) == len({c for _, c in groups.values()})
    ids = [i for i, _ in after]
    assert ids.count(3) == 1 and ids.count(99) == 2 and ids.count(None) == 2 and len(set(range(80, 90)) - set(ids)) >= 5


def test_passages_are_cut_out(stages):
    before = sorted(_rows(stages[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    alone = [r for r in before if r[0] != 99]  # rows without doc_id come first
    after = {i: t for i, t in _rows(stages[2]) if i is not None}
    gone = 0
    for (i, t), (w, out) in zip(alone, by_loops(alone), strict=True):
        if i is None:
            continue
        assert after[i].split() == [x for x, g in zip(w, out, strict=True) if not g]
        gone += sum(out)
        if not any(out):
            assert after[i] == (t or "")
    assert gone >= 60 * 9 and all(after[i].endswith("\nlast  line") for i in range(70, 80) if i in after)
    assert len(_rows(stages[2])) == len(before)


def test_no_test_item_is_left(stages):
    before, after = _rows(stages[2]), _rows(stages[3])
    bad = [k for k, r in enumerate(before) if len(r[1]) < 10_000 and plain([(k, r[1])], ITEMS, decontaminate.Rule())]
    assert after == [r for k, r in enumerate(before) if k not in bad] and len(bad) == 6
    answers = [t.split("? ")[1] for _, t in ITEMS]
    assert not any(a in t for a in answers for _, t in after)


def test_sequences(stages):
    docs = _rows(stages[3])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = stages[4].collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(wanted, key=repr)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert -(-total // 1024) <= len(bins) <= -(-total // 1024) + 2


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
    spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("doc_id") < 9).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 9  # nothing to learn, nothing to hold against
