"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs. A word enters as itself and by its characters: a learned vector of the word and the mean of learned vectors of
its runs of four characters (the first of them marked as a beginning), both in tables of fixed size, by hash; a vector
that training met in fewer than `least_docs` documents is zero. Beside them stand the log of its length and what training documents say of it: signed
scores of how far its document count among toxic texts is from chance, for the word and for its runs (largest and mean).
In training a document's own count is taken off before these scores are made, and the word's vector is left out half of
the time, so that rare words don't give a document away.

Network. Two gated recurrent layers, one in each direction, run over windows of `window` words, one every `stride`;
attention weighs the states of a window, a linear layer scores the pooled state. A text's score is that of its highest
window. In training each text is represented by its highest window of the moment, and by one at random if it is clean.
Vectors and layers are trained together, by a fixed number of steps.

The training sample is bounded: at most `docs_per_class` labelled texts of each class, those of the smallest hashes
among the texts of at most `max_chars` characters. Scoring covers all windows of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, Rolling, blocks, mixed, rows_kept, tidy


@dataclass(frozen=True)
class Rule:
    window: int = 32
    stride: int = 16
    hidden: int = 8
    attention: int = 6
    table_bits: int = 20
    #: Learned vectors of words and of runs of characters: places of each table, and length.
    vector_bits: int = 14
    vector: int = 8
    word_dropout: float = 0.5
    #: Documents of the sample that a vector is learned from at least.
    least_docs: int = 20
    docs_per_class: int = 1000
    max_chars: int = 20_000
    steps: int = 300
    rate: float = 0.015
    vector_rate: float = 0.01
    seed: int = 5


_HASHER = Rolling(41)
_GRAM = 4
#: Inputs of a word beside its vectors.
FEATURES = 4


class _Words:
    """The distinct words of a block of text: hashes, the rows' word numbers, and each word's character runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int) -> None:
        hashes, s, e, self.row = _HASHER.words(data, offsets, lower=True, gap=SIGNS)
        own, at, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        mask = np.uint64((1 << bits) - 1)
        self.n, self.bucket = len(own), (own & mask).astype(np.int64)
        s, e = s[at], e[at]
        self.length = np.log1p(e - s).astype(np.float32) / 4
        n_grams = np.maximum(1, e - s - _GRAM + 1)
        self.starts = np.cumsum(n_grams) - n_grams
        word = np.repeat(np.arange(len(s)), n_grams)
        begin = s[word] + np.arange(len(word)) - self.starts[word]
        up, down = _HASHER.powers(_HASHER.base, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        np.cumsum(_HASHER.table[low] * up[: len(data)], out=total[1:])
        runs = (total[np.minimum(begin + _GRAM, e[word])] - total[begin]) * down[begin]
        runs[self.starts] ^= np.uint64(0x5DEECE66D)
        self.gram, self.gram_word, self.n_grams = (mixed(runs) & mask).astype(np.int64), word, n_grams

    def features(self, word_score: np.ndarray, gram_score: np.ndarray) -> np.ndarray:
        """One row per distinct word, and a last one of zeros for places past a window's end."""
        out = np.zeros((self.n + 1, FEATURES), np.float32)
        if self.n:
            out[:-1, 0] = word_score
            out[:-1, 1] = np.maximum.reduceat(gram_score, self.starts)
            out[:-1, 2] = np.add.reduceat(gram_score, self.starts) / np.bincount(self.gram_word, minlength=self.n)
            out[:-1, 3] = self.length
        return out


def windows(row: np.ndarray, which: np.ndarray, n_words: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of every window, n_words past a text's end; the row of each window). A text has one at least."""
    counts = np.diff(row)
    per = np.maximum(1, -(-(counts - (rule.window - rule.stride)) // rule.stride))
    owner = np.repeat(np.arange(len(counts)), per)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * rule.stride + row[owner]
    at = start[:, None] + np.arange(rule.window)
    past = at >= row[owner + 1][:, None]
    padded = np.append(which, n_words)
    return np.where(past, n_words, padded[np.minimum(at, len(which))]), owner


def _chance(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed log of how many deviations the toxic count is from what it would be by chance."""
    p, k = n1 / max(1, n1 + n0), k1 + k0
    z = (k1 - k * p) / np.sqrt(k * p * (1 - p) + 1)
    return (np.sign(z) * np.log1p(np.abs(z))).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Vectors:
    """The learned vectors of words and of runs of characters."""

    def __init__(self, rule: Rule) -> None:
        self.mask = (1 << rule.vector_bits) - 1
        self.word, self.gram = (np.zeros((1 << rule.vector_bits, rule.vector), np.float32) for _ in range(2))

    def beside(self, feats: np.ndarray, bucket: np.ndarray, gram: np.ndarray, starts: np.ndarray, n_grams: np.ndarray, drop: np.ndarray | None = None) -> np.ndarray:
        """feats of words and a last row of zeros, with the words' vectors after them."""
        n, k = len(bucket), self.word.shape[1]
        out = np.zeros((n + 1, feats.shape[1] + 2 * k), np.float32)
        out[:, : feats.shape[1]] = feats
        if n:
            own = self.word[bucket & self.mask]
            out[:-1, feats.shape[1] : -k] = own if drop is None else np.where(drop[:, None], 0, own)
            out[:-1, -k:] = np.add.reduceat(self.gram[gram & self.mask], starts, axis=0) / n_grams[:, None]
        return out


class Network:
    def __init__(self, rule: Rule) -> None:
        r, h = np.random.Generator(np.random.PCG64(rule.seed)), rule.hidden
        some = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = h
        inputs = FEATURES + 2 * rule.vector
        self.p = {
            **{f"{k}{d}": v for d in "fb" for k, v in (("W", some(inputs, 3 * h)), ("U", some(h, 3 * h)), ("b", np.zeros(3 * h, np.float32)))},
            "A": some(2 * h, rule.attention), "v": some(rule.attention), "w": some(2 * h), "c": np.zeros(1, np.float32),
        }

    def states(self, d: str, inputs: Iterator[np.ndarray] | list[np.ndarray], here: np.ndarray, kept: list | None) -> list[np.ndarray]:
        """The layer's state after each step; inputs: the words' shares of the gates, step by step in its direction."""
        h, U, out = self.h, self.p[f"U{d}"], []
        state = np.zeros((len(here), h), np.float32)
        for t, x in enumerate(inputs):
            m = here[:, t, None]
            g = state @ U
            zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
            if kept is not None:
                kept.append((state, z, r, n, g[:, 2 * h :], m))
            state = state + m * (1 - z) * (n - state)
            out.append(state)
        return out

    def logits(self, feats: np.ndarray, at: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Scores of windows; feats: features of words, at: word numbers, the last one standing for no word."""
        p, length = self.p, at.shape[1]
        here = (at != len(feats) - 1).astype(np.float32)
        gates = {d: feats @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}
        steps = {"f": range(length), "b": range(length - 1, -1, -1)}
        tape: dict = {"f": [] if kept is not None else None, "b": [] if kept is not None else None}
        f = self.states("f", (gates["f"][at[:, t]] for t in steps["f"]), here, tape["f"])
        b = self.states("b", (gates["b"][at[:, t]] for t in steps["b"]), here[:, ::-1], tape["b"])[::-1]
        both = np.concatenate((np.stack(f, 1), np.stack(b, 1)), 2)
        s = np.tanh(both @ p["A"])
        e = np.where(here > 0, s @ p["v"], -30.0)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nl,nlh->nh", a, both)
        if kept is not None:
            kept.update(tape=tape, both=both, s=s, a=a, pooled=pooled)
        return pooled @ p["w"] + p["c"][0]

    def gradient(self, feats: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss, for all parameters and for feats (X); back through pooling, attention and both layers."""
        p, k, h = self.p, {}, self.h
        logit = self.logits(feats, at, k)
        d = ((_sigmoid(logit) - wanted) / len(wanted)).astype(feats.dtype)
        g = {"w": k["pooled"].T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * p["w"]
        da = np.einsum("nh,nlh->nl", dp, k["both"])
        de = k["a"] * (da - (k["a"] * da).sum(1, keepdims=True))
        ds = de[:, :, None] * p["v"] * (1 - k["s"] ** 2)
        g["v"] = np.einsum("nla,nl->a", k["s"], de)
        g["A"] = np.einsum("nlh,nla->ha", k["both"], ds)
        dboth = k["a"][:, :, None] * dp[:, None, :] + ds @ p["A"].T
        length, g["X"] = at.shape[1], np.zeros_like(feats)
        for name, part, order in (("f", dboth[:, :, :h], range(length)), ("b", dboth[:, :, h:], range(length - 1, -1, -1))):
            U, carry = p[f"U{name}"], np.zeros((len(at), h), np.float32)
            gU, gW, gb = np.zeros_like(U), np.zeros_like(p[f"W{name}"]), np.zeros(3 * h, np.float32)
            for (state, z, r, n, gn, m), t in zip(reversed(k["tape"][name]), reversed(order), strict=True):
                total = part[:, t] + carry
                dh = total * m
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                to_u = np.concatenate((dz, dr, dn * r), 1)
                to_x = np.concatenate((dz, dr, dn), 1)
                gU += state.T @ to_u
                gW += feats[at[:, t]].T @ to_x
                gb += to_x.sum(0)
                np.add.at(g["X"], at[:, t], to_x @ p[f"W{name}"].T)
                carry = total * (1 - m) + dh * z + to_u @ U.T
            g |= {f"U{name}": gU, f"W{name}": gW, f"b{name}": gb}
        return g


@dataclass
class Model:
    rule: Rule
    words: np.ndarray
    grams: np.ndarray
    vectors: Vectors | None
    network: Network | None
    #: What every text gets where no labels of both classes were there to learn from.
    share: float = 0.0
    #: What is added to the log odds: the sample has more toxic texts than there are among the labels.
    shift: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.network is None:
            return out
        for first, end, data, offsets in blocks(texts):
            w = _Words(data, offsets, self.rule.table_bits)
            feats = self.vectors.beside(w.features(self.words[w.bucket], self.grams[w.gram]), w.bucket, w.gram, w.starts, w.n_grams)
            best = np.full(end - first, -np.inf)
            at, owner = windows(w.row, w.which, w.n, self.rule)
            for k in range(0, len(at), 4096):
                np.maximum.at(best, owner[k : k + 4096], self.network.logits(feats, at[k : k + 4096]))
            out[first:end] = _sigmoid(best + self.shift)
        return out


def trained(texts: list[str], toxic: np.ndarray, rule: Rule = Rule()) -> Model:
    """A model of labelled texts (0 or 1)."""
    size = 1 << rule.table_bits
    n1, n0 = int(toxic.sum()), int((toxic == 0).sum())
    if not n1 or not n0:
        return Model(rule, np.zeros(size, np.float32), np.zeros(size, np.float32), None, None, n1 / max(1, n1 + n0))
    docs = []
    counts = {k: np.zeros((2, size), np.int32) for k in ("word", "gram")}
    for text, y in zip(texts, toxic.tolist(), strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        w = _Words(data, np.array([0, len(data)]), rule.table_bits)
        docs.append(w)
        counts["word"][y][np.unique(w.bucket)] += 1
        counts["gram"][y][np.unique(w.gram)] += 1

    def own(kind: str, bucket: np.ndarray, y: int) -> np.ndarray:
        k0, k1 = counts[kind][0][bucket] - (1 - y), counts[kind][1][bucket] - y
        return _chance(k1, k0, n1 - y, n0 - (1 - y))

    # All candidate windows in one matrix of word numbers over one feature table: a text's highest ones by features.
    r = np.random.Generator(np.random.PCG64(rule.seed))
    feats, at, owner, base = [], [], [], 0
    for k, (w, y) in enumerate(zip(docs, toxic.tolist(), strict=True)):
        f = w.features(own("word", w.bucket, y), own("gram", w.gram, y))
        win, _ = windows(w.row, w.which, w.n, rule)
        top = np.argsort(-f[win, :2].max(1).sum(1), kind="stable")[:4]
        pick = np.unique(np.concatenate((top, r.integers(0, len(win), 3))))
        at.append(np.where(win[pick] == w.n, -1, win[pick] + base))
        owner.append(np.full(len(pick), k))
        feats.append(f[:-1])
        base += w.n
    feats = np.concatenate([*feats, np.zeros((1, FEATURES), np.float32)])
    at, owner = np.concatenate(at), np.concatenate(owner)
    at[at < 0] = base
    bucket, gram, n_grams = (np.concatenate([getattr(w, c) for w in docs]) for c in ("bucket", "gram", "n_grams"))
    begin = np.cumsum(n_grams) - n_grams
    starts = np.searchsorted(owner, np.arange(len(docs)))
    sizes = np.diff(np.append(starts, len(owner)))

    net, vectors = Network(rule), Vectors(rule)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    squares, met = ({k: np.zeros(len(vectors.word)) for k in ("word", "gram")} for _ in range(2))
    for w in docs:
        met["word"][np.unique(w.bucket & vectors.mask)] += 1
        met["gram"][np.unique(w.gram & vectors.mask)] += 1

    def learn(kind: str, rows: np.ndarray, g: np.ndarray) -> None:
        """A step for the vectors of these rows, of a length that falls with what they have moved."""
        table, (at_row, which) = getattr(vectors, kind), np.unique(rows & vectors.mask, return_inverse=True)
        total = np.zeros((len(at_row), g.shape[1]))
        np.add.at(total, which, g)
        total[met[kind][at_row] < rule.least_docs] = 0
        squares[kind][at_row] += (total**2).mean(1)
        table[at_row] -= rule.vector_rate * total / (np.sqrt(squares[kind][at_row])[:, None] + 1e-8)

    while step < rule.steps:
        whole = vectors.beside(feats, bucket, gram, begin, n_grams)
        logit = np.concatenate([net.logits(whole, at[k : k + 4096]) for k in range(0, len(at), 4096)])
        order = np.lexsort((-logit, owner))
        chosen = order[starts]
        any_of_clean = starts[toxic == 0] + (r.random(n0) * sizes[toxic == 0]).astype(np.int64)
        chosen = r.permutation(np.concatenate((chosen, any_of_clean)))
        for k in range(0, len(chosen), 128):
            c = chosen[k : k + 128]
            words, local = np.unique(at[c], return_inverse=True)
            local, words = local.reshape(at[c].shape), words[words < base]
            n = n_grams[words]
            own_starts = np.cumsum(n) - n
            own_grams = gram[np.repeat(begin[words] - own_starts, n) + np.arange(int(n.sum()))]
            drop = r.random(len(words)) < rule.word_dropout
            x = vectors.beside(np.append(feats[words], feats[-1:], axis=0), bucket[words], own_grams, own_starts, n, drop)
            g, step = net.gradient(x, local, toxic[owner[c]]), step + 1
            gx = g.pop("X")[:-1]
            if len(words):
                learn("word", bucket[words][~drop], gx[~drop, FEATURES : -rule.vector])
                learn("gram", own_grams, np.repeat(gx[:, -rule.vector :] / n[:, None], n, axis=0))
            for name, x in g.items():
                m[name] = 0.9 * m[name] + 0.1 * x
                v[name] = 0.999 * v[name] + 0.001 * x * x
                net.p[name] = (net.p[name] - rule.rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if step == rule.steps:
                break
    score = {k: _chance(x[1], x[0], n1, n0) for k, x in counts.items()}
    return Model(rule, score["word"], score["gram"], vectors, net)


def held_out(doc_id: str = "doc_id", of: int = 5) -> Column:
    """Whether a row is kept from training; rows without doc_id are."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of == 0


def fitted(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> Model:
    """A model of the labelled rows that are not held out. A doc_id with both labels counts as toxic; null labels and
    labels without doc_id don't. Of several texts with one doc_id the least counts; texts beyond max_chars are passed
    over when the sample is chosen, so they cost it no place. Without labels of both classes all texts get the share of toxic ones."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= rule.max_chars)
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    key = F.xxhash64("doc_id")
    sample = [known.filter(F.col("toxic") == y).orderBy(key, "doc_id").limit(rule.docs_per_class) for y in (0, 1)]
    rows = [tuple(r) for x in sample for r in x.collect()]  # at most 2 * docs_per_class
    if not rows:
        return trained([], np.zeros(0, np.int64), rule)
    of = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int")
    got = texts.join(F.broadcast(of), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in got.collect())
    model = trained([t for _, t, _ in got], np.array([y for _, _, y in got], np.int64), rule)
    if model.network is not None:
        all_ = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        taken = {y: sum(r[1] == y for r in rows) for y in (0, 1)}
        model.shift = float(np.log(all_[1] / all_[0]) - np.log(taken[1] / taken[0]))
    return model


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs.

    A null or empty text is one window without words and gets that window's score; repeated rows get equal scores; a text
    of any length has the score of its highest window; an empty table gives no rows. Columns other than doc_id and text
    are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")


@tidy
def _keep(batches: Iterator[pa.RecordBatch], text: str, model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(model.scores(pa.compute.fill_null(batch.column(text), "")) < 0.5))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, with a score under one half, with or without doc_id; a null text stays null."""
    return rows_kept(docs, partial(_keep, model=model))
