"""Planted items, shards of any number, and retrieval against scores of all pairs."""

import math
import random

import numpy as np
import pytest

from bramble.llm import decontaminate as dc

R = random.Random(9)
WORDS = [f"w{k}" for k in range(400)]
words = lambda n: " ".join(R.choices(WORDS, k=n))
ITEMS = [(i if i != 5 else None, f"What is {words(R.randint(8, 40))}? {words(R.randint(4, 9))}.") for i in range(40)]
ITEM_SCHEMA = "item_id long, text string, doc_id long, shard int, score double, word string"


def _docs() -> list:
    rows = [(i, words(R.randint(0, 300))) for i in range(60)]
    for i in range(60, 90):
        item = ITEMS[i % 40][1]
        rows.append((i, f"{words(R.randint(0, 200))} ({item.upper()}) {words(R.randint(0, 200))}"))
    rows += [(90, ITEMS[0][1].rsplit("?", 1)[0]), (91, None), (92, ""), (93, words(300_000) + " " + ITEMS[39][1] + " " + words(50)), (None, ITEMS[7][1]), (None, "clean"), (60, rows[60][1]), (60, rows[60][1])]
    return rows


DOCS = _docs()


def _flat(text: str) -> list:
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def plain(docs: list, of: list, rule: dc.Rule) -> set:
    """All (doc_id, item_id) by scoring each passage against each item and comparing shingles."""
    split = [dc.parts(t) for _, t in of]
    items = [_flat(t) for _, t in of]
    mean = sum(map(len, items)) / len(items)
    having: dict = {}
    for w in items:
        for t in set(w):
            having[t] = having.get(t, 0) + 1
    weight = lambda t, w: math.log1p((len(items) - having[t] + 0.5) / (having[t] + 0.5)) * w.count(t) * (rule.k1 + 1) / (w.count(t) + rule.k1 * (1 - rule.b + rule.b * len(w) / mean))
    out = set()

    def share(part: list, region: list) -> float:
        n = min(rule.shingle, len(part))
        grams = lambda x: {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        return 100 * len(grams(part) & grams(region)) / len(grams(part)) if part else 100.0

    for doc_id, text in docs:
        own = _flat(text)
        for at in range(0, len(own), rule.stride):
            passage = set(own[at : at + rule.passage])
            for (item_id, _), w, halves in zip(of, items, split, strict=True):
                if len(passage & set(w)) < 0.3 * len(set(w)):
                    continue
                all_ = sum(weight(t, w) for t in set(w))
                got = sum(weight(t, w) for t in set(w) & passage)
                if got >= rule.share * all_ * min(1, rule.stride / len(w)) - 1e-9:
                    region = own[max(0, at - len(w)) : at + rule.passage + len(w)]
                    if all(share(_flat(h), region) >= rule.overlap for h in halves):
                        out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("shard_chars", [4_000_000, 600])
def test_by_all_passages_and_items(spark, shard_chars):
    docs = spark.createDataFrame([(*r, 1, "s") for r in DOCS], "doc_id long, text string, item_id long, shard string")
    items = spark.createDataFrame([(*r, 1, 2, 0.5, "w") for r in [*ITEMS, ITEMS[3], (77, None), (78, " ,"), (79, "")]], ITEM_SCHEMA)
    rule = dc.Rule(shard_chars=shard_chars)
    got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(docs, items, rule).collect()}
    wanted = plain(DOCS, ITEMS, rule)
    assert set(got) == wanted and len(wanted) >= 32 and (None, 7) in wanted and (93, 39) in wanted and (90, 0) not in wanted
    bad = {d for d, _ in wanted if d is not None}
    left = dc.clean(docs, items, rule)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted((r for r in DOCS if r[0] not in bad and r[1] != ITEMS[7][1]), key=repr)


def test_scores_do_not_depend_on_shards(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    one, many = (sorted(((*r[:3], round(r[3], 9), *r[4:]) for r in dc.hits(docs, items, dc.Rule(shard_chars=n)).collect()), key=repr) for n in (4_000_000, 300))
    assert one == many


def test_nothing_to_search(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contaminated(docs.limit(0), items).count() == 0 and dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items.limit(0)).count() == len(DOCS)


def test_wand_against_all_scores():
    r = np.random.Generator(np.random.PCG64(2))
    items = [(i, " ".join(f"t{k}" for k in r.zipf(1.5, 30) % 60)) for i in range(90)]
    index = dc.Index(items, dc.Rule(posting_block=3, share=0.2))
    for _ in range(100):
        terms = sorted(set(r.integers(0, len(index.terms), r.integers(1, 20)).tolist()))
        scores: dict = {}
        for t in terms:
            for i, w in zip(index.lists[t][0], index.lists[t][1], strict=True):
                scores[i] = scores.get(i, 0) + w
        assert {i for i, _ in index.retrieve(terms)} == {i for i, s in scores.items() if s >= 1 - 1e-9}
