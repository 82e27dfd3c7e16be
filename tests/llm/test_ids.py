"""Ids against the tokenizers library, and the keyed shards and packed pieces that are made of them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bramble.llm import common, keyed_ids, packing

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\xa0", " ", "　", "\x00", "a", "Ab", "don't", "'s", "It'LL", "é", "é", "́", "İ", "ß", "中文", "12", "٣", "...", "!?", "#", "_", "x_y", "‍", "🙂", "\r\n"]


def _texts(n: int) -> list:
    r = random.Random(8)
    some = ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(n)]
    return [*some, "", None, "stop <|endoftext|> go", "word " * 30_000, " ".join(f"w{k % 9973}" for k in range(900_000)), "x" * 100_000, "<|endoftext|>" * 2000]


TEXTS = _texts(1500)


@pytest.fixture(scope="module", params=FILES)
def library(request):
    t = Tokenizer.from_file(public_tokenizers.path(request.param))
    return request.param, [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", FILES)
def test_encoder(name, as_text):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = as_text
    own = common.PieceEncoder(path, as_text, most=3000)  # forgets now and then
    short = [x or "" for x in TEXTS[:1500]]
    for _ in range(2):
        got = []
        for first, ids, bounds in own.encode(pa.array(short)):
            assert first == len(got)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in short]


def test_shards_hold_what_the_library_gives(spark, library):
    name, wanted = library
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    docs = spark.createDataFrame([(i, TEXTS[i], "c", 1, 2, 3) for i in order], "doc_id long, text string, shard string, first int, part int, before int").repartition(5)
    store = keyed_ids.stored(docs, name, end_id=1, shard_chars=400_000, part_keys=100)
    got = {r["doc_id"]: r for r in store.look_up(store.keys).collect()}
    at = 0
    for i, ids in enumerate(wanted):
        raw = np.array([*ids, 1], "<u4").tobytes()
        assert got[i]["start"] == at and bytes(got[i]["ids"]) == raw
        at += len(ids) + 1
    foreign = spark.createDataFrame([(i,) for i in range(10_000, 30_000)] + [(-1,), (None,), (7,), (7,)], "doc_id long")
    assert [r["doc_id"] for r in store.look_up(foreign).collect()] == [7, 7]


def test_equal_ids_and_a_key_that_is_not_there(spark):
    rows = [(5, "a"), (5, "b"), (None, "n"), (5, "a"), (9, "z"), (None, None)] * 20
    store = keyed_ids.stored(spark.createDataFrame(rows, "doc_id long, text string"), shard_chars=10)
    got = store.look_up(spark.createDataFrame([(5,), (None,), (6,)], "doc_id long")).collect()
    assert len(got) == 100 and {r["doc_id"] for r in got} == {5, None}
    every = sorted((r["start"], len(r["ids"]) // 4) for r in store.look_up(store.keys).collect())
    assert len(every) == 120 and all(a + n == b for (a, n), (b, _) in zip(every, every[1:], strict=False))
    # What an index with a foreign key's fingerprint in it would lead to: another document, which is not taken for it.
    place = pa.RecordBatch.from_pydict({"doc_id": [6], "shard": pa.array([got[0]["shard"]], pa.int32()), "first": pa.array([0], pa.int32()), "count": pa.array([1], pa.int32()), "before": [0]})
    assert not list(keyed_ids._fetch(iter([place]), store.folder))


def test_pieces_hold_what_the_library_gives(spark):
    name = FILES[1]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    docs = spark.createDataFrame([(i, x, 1, "p") for i, x in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "p"), (None, "no id", 1, "p")], "doc_id long, text string, chunk int, piece string").repartition(6)
    got = packing.packed(docs, name).toPandas()
    wanted = []
    for i, x in [*enumerate(TEXTS), (3, TEXTS[3]), (-1, "no id")]:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        wanted += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    own = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna({"doc_id": -1}).astype(np.int64)
    assert sorted(map(tuple, own.to_numpy().tolist())) == sorted(wanted)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert -(-got.length.sum() // 1024) <= got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1
