"""Context-tree weighting against a plain recursion, and its probabilities over all continuations."""

import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bramble.llm import ctw

TEXTS = ["abab abba", "baba", "", None, "Abab baé", "ab" * 40, "bb aa", "a"]


def _kt(bits: list[int]) -> Fraction:
    p, n = Fraction(1), [0, 0]
    for b in bits:
        p *= (Fraction(n[b]) + Fraction(1, 2)) / (n[0] + n[1] + 1)
        n[b] += 1
    return p


class Plain:
    """The tree by its definition: for each prefix of a byte's bits, weighted probabilities over contexts, as fractions."""

    def __init__(self, events: list[tuple[bytes, int]], depth: int) -> None:
        self.depth, self.at = depth, {}
        for before, byte in events:
            bits = [byte >> (7 - k) & 1 for k in range(8)]
            for k, bit in enumerate(bits):
                for d in range(depth + 1):
                    self.at.setdefault((before[len(before) - d :], tuple(bits[:k])), []).append(bit)

    def weighted(self, context: bytes, prefix: tuple) -> Fraction:
        bits = self.at.get((context, prefix), [])
        if len(context) == self.depth or not bits:
            return _kt(bits)
        below = Fraction(1)
        for c in range(256):
            if (bytes([c]) + context, prefix) in self.at:
                below *= self.weighted(bytes([c]) + context, prefix)
        return (_kt(bits) + below) / 2

    def one(self, before: bytes, prefix: tuple) -> float:
        """The probability of a 1 after `before`: mixed down the seen contexts, the rest to the longest of them."""
        p, rest, last = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            context = before[len(before) - d :]
            bits = self.at.get((context, prefix), [])
            if not bits:
                break
            last = (sum(bits) + 0.5) / (len(bits) + 1)
            share = 1.0 if d == self.depth else float(_kt(bits) / 2 / self.weighted(context, prefix))
            p, rest = p + rest * share * last, rest * (1 - share)
        return p + rest * last

    def log10(self, before: bytes, byte: int) -> float:
        out, prefix = 0.0, ()
        for k in range(8):
            bit = byte >> (7 - k) & 1
            p = self.one(before, prefix)
            out += math.log10(p if bit else 1 - p)
            prefix += (bit,)
        return out


def _events(text: str | None, depth: int) -> list[tuple[bytes, int]]:
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + bytes([ctw.END])
    wide = b" " * depth + raw
    return [(wide[k : k + depth], raw[k]) for k in range(len(raw))]


@pytest.mark.parametrize(("depth", "fan"), [(3, 4096), (4, 2)])
def test_scores_by_recursion(spark, depth, fan):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "abab")]
    got = ctw.scored(spark.createDataFrame(rows, "doc_id long, text string"), ctw.Rule(depth=depth, fan=fan, chunk_chars=100, bucket_chars=60)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([e for i, t in rows if not held(i) for e in _events(t, depth)], depth)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        wanted = sum(plain.log10(*e) for e in _events(texts[r["doc_id"]], depth))
        assert r["score"] == pytest.approx(wanted, rel=1e-4), texts[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"]) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())


def test_all_continuations_sum_to_one():
    """The end included, and learned: it is likelier after what texts end with."""
    data = np.frombuffer(b"abcdabcd" + b"abcd", np.uint8)
    g, n = np.unique(ctw.grams(data, np.array([0, 8, 12]), 5), return_counts=True)
    probability = {}
    for before in (b" abcd", b"  abc", b"zzzzz"):
        context = sum(c << (8 * (k + 1)) for k, c in enumerate(before))
        every = np.arange(256, dtype=np.uint64) | np.uint64(context)
        more = np.union1d(g, every)
        count = np.array([dict(zip(g.tolist(), n.tolist(), strict=True)).get(x, 0) for x in more.tolist()])
        found = ctw.levels(more, count, 5, 0)
        m = len(found[0].key)
        p = 10 ** ctw.code(every, found, 0, 5, np.zeros(m), np.ones(m), np.full(m, 0.5))
        assert p.sum() == pytest.approx(1.0)
        probability[before] = p[ctw.END]
    assert probability[b" abcd"] > 2 * probability[b"  abc"]


def test_unigrams_by_loops(spark):
    rows = [(i, f"The cat {'sat ' * (i % 4)}on\tmat{i % 3}\x0b x{i}") for i in range(60)] + [(60, None), (61, "")]
    got = {r["doc_id"]: r for r in ctw.scored(spark.createDataFrame(rows, "doc_id long, text string"), ctw.Rule(fan=3, chunk_chars=200, bucket_chars=300)).collect()}
    words = lambda t: [w for w in (t or "").lower().replace("\x0b", " ").split(" ") for w in w.split("\t") if w]
    counts, total = {}, 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*words(t), None]:
                counts[w], total = counts.get(w, 0) + 1, total + 1
    for i, t in rows:
        own = [*words(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), total)
        assert r["base_score"] == pytest.approx(base)
