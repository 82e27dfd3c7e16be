"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is predicted after the `depth` bytes before it (a text starts after spaces), bit by bit: each context of 0 to
`depth` bytes has a binary tree of 255 nodes, one for every prefix of a byte's bits, and each node estimates its bit by
Krichevsky-Trofimov from its counts. A node's weighted probability is half its own estimate's and half the product of
those of its contexts one byte longer; at full depth it is the estimate's. So the code length of a byte mixes all depths
with the weights that the training data give them, and no depth has to be chosen.

A text ends with an event of its own: the byte END, which no UTF-8 text holds, is learned and coded like any other after
the last bytes. So a score is the probability of a text, not of all texts that begin like it.

The tree is never on one machine. A run of depth + 1 bytes (a gram, in one 64-bit number) stands for a context with its
next byte; the distinct grams of all texts with their training counts are the model's whole input.

1. Texts are dealt into chunks; each sends its distinct grams with their training counts, once, to buckets by the hash
   of the whole gram, packed into one binary value per bucket. There they are summed: what goes on is distinct grams.
2. These go to parts by the nearest JOINT bytes of the context. A part thus has all deeper nodes of its contexts: levels
   depth..JOINT are weighted there bottom up, vectorized over the sorted grams. A key has at most
   256**(depth - JOINT + 1) distinct grams, whatever the corpus and however often it has them.
3. The nodes of JOINT bytes pass their counts and weighted probabilities up, by their two nearest bytes, dealt over a
   fixed number of groups; sums of that level make level 1 (256 contexts of 255 nodes at most) and the root on the driver.
   Down the same way, the mixture of the upper levels is written as p = a + b * (the mixture from level JOINT on) for
   every node.
4. In the parts, the mixture runs top down to a code length for every distinct gram, seen in training or not. A context
   without a training count has no say: its share goes to the longest one that has.
   Chunks and buckets exchange cells by blocks where they are many (`common.Exchange`), so rows don't grow as their product.
5. The lengths go back to the buckets, each chunk gets those of its grams in the order it sent them, and sums them per text.

Word counts, for comparison with a unigram model of words, go the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Exchange, Rolling, blocks, by_chunk, chunked, mixed, side_table, ways, written


@dataclass(frozen=True)
class Rule:
    #: Bytes of context, at most 7.
    depth: int = 5
    chunk_chars: int = 16_000_000
    bucket_chars: int = 8_000_000
    #: Buckets or chunks up to which their exchange is one row a pair.
    fan: int = 4096


#: Bytes of context whose nodes are weighted together above the parts.
JOINT = 3
#: Characters of text from which the number of parts grows no further: contexts of JOINT bytes have a bound of their own.
PART_BOUND = 4_000_000_000
#: The event after a text's last byte.
END = 255
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For every byte and each row's end its gram: contexts nearest first from the top, then the byte in the lowest place."""
    low = np.insert(_LOWER[data], offsets[1:], np.uint64(END))
    offsets = offsets + np.arange(len(offsets))
    out, n = low.copy(), len(low)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, depth + 1):
        before = np.full(n, 32, np.uint64)
        before[k:] = low[:-k]
        before[place < k] = 32
        out |= before << np.uint64(8 * (depth + 1 - k))
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any one order."""
    return _log_half_factorial(n0) + _log_half_factorial(n1) - _log_factorial(n0 + n1)


_EXACT = 64
_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_EXACT) + 0.5))))
_FULL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_EXACT) + 1.0))))


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma(x) for x of 64 and more."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _log_half_factorial(n: np.ndarray) -> np.ndarray:
    """log of 1/2 * 3/2 * ... * (n - 1/2)."""
    return np.where(n <= _EXACT, _HALF[np.minimum(n, _EXACT)], _stirling(np.maximum(n, 64) + 0.5) - 0.5723649429247001)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return np.where(n <= _EXACT, _FULL[np.minimum(n, _EXACT)], _stirling(np.maximum(n, 64) + 1.0))


class Level:
    """The nodes of one depth: key = context << 8 | bit prefix (1..255), counts, and log weighted probability."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.key, self.n0, self.n1 = key, n0, n1
        own = _log_kt(n0, n1)
        self.weighted = own if below is None else np.logaddexp(own, below) - 0.6931471805599453
        #: The weight of a node's own estimate against its longer contexts'.
        self.alone = np.ones(len(key)) if below is None else np.exp(np.minimum(0.0, own - 0.6931471805599453 - self.weighted))
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)
        self.seen = n0 + n1 > 0

    @classmethod
    def given(cls, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray, alone: np.ndarray) -> Level:
        """Nodes whose weighted probabilities were found elsewhere, from the levels below them."""
        out = cls(key, n0, n1, None)
        out.weighted, out.alone = weighted, alone
        return out

    def up(self, bits: int = 8) -> Level:
        """The level of contexts one byte shorter. The farthest byte is the lowest one of the context."""
        context, node = self.key >> np.uint64(8), self.key & np.uint64(255)
        key = ((context >> np.uint64(bits)) << np.uint64(8)) | node
        own, which = np.unique(key, return_inverse=True)
        total = lambda x: np.bincount(which, weights=x, minlength=len(own))
        return Level(own, total(self.n0).astype(np.int64), total(self.n1).astype(np.int64), total(self.weighted))

    def mix(self, at: np.ndarray, p: np.ndarray, rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One level further down: the mixture so far, the weight that is left, the estimate of the longest seen context."""
        seen = self.seen[at]
        share = np.where(seen, self.alone[at], 0.0)
        return p + rest * share * self.one[at], rest * (1 - share), np.where(seen, self.one[at], last)

    def find(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, key)


def leaves(gram: np.ndarray, count: np.ndarray) -> Level:
    """The deepest level: for every gram the 8 nodes on its byte's way, counts summed by node."""
    context, byte = gram >> np.uint64(8), gram & np.uint64(255)
    keys, ones, counts = [], [], []
    for b in range(8):
        keys.append((context << np.uint64(8)) | (np.uint64(1) << np.uint64(b)) | (byte >> np.uint64(8 - b)))
        ones.append((byte >> np.uint64(7 - b)) & np.uint64(1))
        counts.append(count)
    own, which = np.unique(np.concatenate(keys), return_inverse=True)
    ones, counts = np.concatenate(ones), np.concatenate(counts)
    n1 = np.bincount(which, weights=counts * ones, minlength=len(own)).astype(np.int64)
    return Level(own, np.bincount(which, weights=counts, minlength=len(own)).astype(np.int64) - n1, n1, None)


def levels(gram: np.ndarray, count: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top..depth over these grams; the first one is level `top`."""
    out = [leaves(gram, count)]
    for _ in range(depth - top):
        out.insert(0, out[0].up())
    return out


def code(gram: np.ndarray, found: list[Level], top: int, depth: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 of each gram's byte's probability; by node of level `top`, for bit 1: a + b * what follows, c: the estimate above."""
    context, byte = gram >> np.uint64(8), gram & np.uint64(255)
    out = np.zeros(len(gram))
    for bit in range(8):
        node = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        p = rest = last = np.zeros(0)
        for k, level in enumerate(found):
            at = level.find(((context >> np.uint64(8 * (depth - top - k))) << np.uint64(8)) | node)
            if k == 0:
                p, rest, last = a[at], b[at], c[at]
            p, rest, last = level.mix(at, p, rest, last)
        p = p + rest * last
        out += np.log10(np.where(one, p, 1 - p))
    return out


_HASHER = Rolling(51)
GRAMS, WORDS = 0, 1


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(n_buckets)).astype(np.int64)


class _Counts:
    """A chunk's distinct keys of a kind with their training counts, by bucket."""

    def __init__(self, texts: pa.Table, kind: int, depth: int, n_buckets: int) -> None:
        trains, own, n = np.asarray(texts.column("trains").combine_chunks()), [], []
        for first, end, data, offsets in blocks(texts.column("text")):
            keys, rows = _keys(data, offsets, kind, depth)
            some, which = np.unique(keys, return_inverse=True)
            own.append(some)
            n.append(np.bincount(which, weights=np.repeat(trains[first:end], rows), minlength=len(some)))
        keys, which = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_inverse=True)
        count = np.bincount(which, weights=np.concatenate(n) if n else None, minlength=len(keys))
        bucket = _bucket(keys, n_buckets)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.n = keys[order], count[order].astype(np.uint32)
        self.bucket, begin = np.unique(bucket[order], return_index=True)
        self.bounds = np.append(begin, len(keys))


def _keys(data: np.ndarray, offsets: np.ndarray, kind: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block of texts, and how many each row has."""
    if kind == GRAMS:
        return grams(data, offsets, depth), np.diff(offsets) + 1
    words, _, _, row = _HASHER.words(data, offsets, lower=True)
    return words, np.diff(row)


def _send(number: int, texts: pa.Table, side: dict, depth: int, n_buckets: int, out: Exchange) -> pa.Table:
    sent = []
    for kind in (GRAMS, WORDS):
        c = _Counts(texts, kind, depth, n_buckets)
        part = lambda x: [x[a:b].tobytes() for a, b in zip(c.bounds[:-1], c.bounds[1:], strict=True)]  # noqa: B023,E731
        m = len(c.bucket)
        sent.append(pa.table({"kind": pa.array(np.full(m, kind, np.int32)), "bucket": pa.array(c.bucket, pa.int32()), "chunk": pa.array(np.full(m, number, np.int32)), "keys": pa.array(part(c.keys), pa.binary()), "n": pa.array(part(c.n), pa.binary())}))
    return out.sent(pa.concat_tables(sent))


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys, their counts, each sent key's number, how many each chunk sent)."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64), which, [len(x) for x in parts]


def _answers(table: pa.Table, kind: int, values: np.ndarray, which: np.ndarray, sizes: list[int], known: int, total: int, out: Exchange) -> pa.Table:
    raw = [x.tobytes() for x in np.split(values[which], np.cumsum(sizes)[:-1])]
    once = lambda x: pa.array([x] + [0] * (len(raw) - 1), pa.int64())
    return out.sent(pa.table({"chunk": table.column("chunk"), "kind": pa.array([kind] * len(raw), pa.int32()), "bucket": table.column("bucket"), "answer": pa.array(raw, pa.binary()), "known": once(known), "total": once(total)}))


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("n")])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(n[order].astype(np.int64), starts)


def _distinct(key, table: pa.Table, depth: int, n_parts: int, into: Exchange) -> pa.Table:
    """A bucket's distinct grams with their counts, packed for the parts of their contexts."""
    keys, n = _totals(into.cells(table))
    part = _bucket(keys >> np.uint64(8 * (depth + 1 - JOINT)), n_parts)
    order = np.argsort(part, kind="stable")
    own, begin = np.unique(part[order], return_index=True)
    bounds = np.append(begin, len(keys))
    packed = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return pa.table({"part": pa.array(own, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(own), pa.int32()), "keys": packed(keys), "n": packed(n)})


def _part_levels(table: pa.Table, depth: int) -> tuple[np.ndarray, list[Level]]:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n")])
    return keys, levels(keys, n, depth, JOINT)


def _lift(key, table: pa.Table, depth: int) -> pa.Table:
    """A part's nodes of level JOINT."""
    top = _part_levels(table, depth)[1][0]
    return pa.table({"part": pa.array(np.full(len(top.key), key[0].as_py(), np.int32))} | _columns(top))


def _lengths(key, table: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    """The code lengths of a part's grams, for the buckets that sent them."""
    keys, found = _part_levels(table, depth)
    order = np.argsort(above.column("node").to_numpy().view(np.uint64))
    a, b, c = (above.column(x).to_numpy()[order] for x in "abc")
    values = code(keys, found, JOINT, depth, a, b, c).astype(np.float32)
    sizes = np.array([len(x.as_buffer()) // 8 for x in table.column("keys")])
    raw = [x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])]
    return pa.table({"bucket": table.column("bucket"), "keys": table.column("keys"), "lengths": pa.array(raw, pa.binary())})


def _told(key, sent: pa.Table, lengths: pa.Table, into: Exchange, out: Exchange) -> pa.Table:
    """The code lengths of the grams that each chunk sent to a bucket, in its order."""
    sent = into.cells(sent)
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in lengths.column("keys")])
    values = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in lengths.column("lengths")])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("keys")]
    which = np.searchsorted(keys, np.concatenate(asked))
    return _answers(sent, GRAMS, values, which, [len(x) for x in asked], 0, 0, out)


def _word_counts(key, table: pa.Table, into: Exchange, out: Exchange) -> pa.Table:
    table = into.cells(table)
    _, n, which, sizes = _summed(table)
    return _answers(table, WORDS, n, which, sizes, int((n > 0).sum()), int(n.sum()), out)


#: Groups in which the levels above JOINT are worked out.
_GROUPS = 256
_NODES = "node long, n0 long, n1 long, weighted double, alone double"


def _columns(level: Level) -> dict[str, np.ndarray]:
    return {"node": level.key.view(np.int64), "n0": level.n0, "n1": level.n1, "weighted": level.weighted, "alone": level.alone}


def _given(table: pa.Table) -> tuple[Level, np.ndarray]:
    """The nodes in a table, in order, and that order."""
    key = table.column("node").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return Level.given(key[order], *(table.column(c).to_numpy()[order] for c in ("n0", "n1", "weighted", "alone"))), order


def _to_two(key, table: pa.Table) -> pa.Table:
    """The nodes of level 2 above these."""
    level, _ = _given(table)
    for _ in range(JOINT - 2):
        level = level.up()
    return pa.table(_columns(level))


def _from_two(key, table: pa.Table, above: list[Level]) -> pa.Table:
    """(part, node, a, b, c): what the levels above a node make of bit 1; c: the estimate of the longest seen context."""
    level, order = _given(table)
    node, context = level.key & np.uint64(255), level.key >> np.uint64(8)
    between, up = [], level
    for _ in range(JOINT - 2):
        up = up.up()
        between.insert(0, up)
    p, rest, last = np.zeros(len(order)), np.ones(len(order)), np.full(len(order), 0.5)
    for k, one in enumerate([*above, *between]):
        p, rest, last = one.mix(one.find(((context >> np.uint64(8 * (JOINT - k))) << np.uint64(8)) | node), p, rest, last)
    return pa.table({"part": table.column("part").take(pa.array(order)), "node": level.key.view(np.int64), "a": p, "b": rest, "c": last})


def _upper(nodes: DataFrame) -> DataFrame:
    """For each node of level JOINT, what the levels above make of bit 1: a + b * what follows.

    The driver sees level 1: 256 contexts of 255 nodes at most, a bound that no corpus moves.
    """
    near = F.pmod(F.xxhash64(F.shiftrightunsigned("node", 8 * (JOINT - 1))), F.lit(_GROUPS))
    of_two = nodes.withColumn("near", near).groupBy("near")
    parent = F.shiftleft(F.shiftrightunsigned("node", 16), 8) + F.col("node").bitwiseAND(255)
    two = of_two.applyInArrow(lambda key, t: _to_two(key, t), _NODES)
    rows = two.groupBy(parent.alias("node")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weighted"))).orderBy("node").toArrow()
    one = Level(rows.column("node").to_numpy().view(np.uint64), *(rows.column(c).to_numpy() for c in ("n0", "n1", "weighted")))
    above = [one.up(), one]
    return of_two.applyInArrow(lambda key, t: _from_two(key, t, above), "part int, node long, a double, b double, c double")


def _sums(number: int, texts: pa.Table, side: dict, depth: int, n_buckets: int, known: int, total: int, into: Exchange) -> pa.Table:
    """Per text: the sum of its bytes' code lengths, and its words by the unigram model (an end after each text)."""
    answers, n_rows = None if side["answers"] is None else into.cells(side["answers"]), len(texts)
    out = {"score": np.zeros(n_rows), "base_score": np.zeros(n_rows), "n_tokens": np.ones(n_rows, np.int64), "n_known": np.full(n_rows, int(side["ends"] > 0), np.int64), "n_bytes": np.zeros(n_rows, np.int64)}
    log = lambda c: np.log10((c + 0.1) / (total + 0.1 * (known + 1)))
    for kind, form in ((GRAMS, np.float32), (WORDS, np.int64)):
        c = _Counts(texts, kind, depth, n_buckets)
        values = np.zeros(len(c.keys), form)
        if answers is not None:
            own = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            for bucket, raw in zip(own.column("bucket").to_pylist(), own.column("answer").to_pylist(), strict=True):
                k = int(np.searchsorted(c.bucket, bucket))
                values[c.bounds[k] : c.bounds[k + 1]] = np.frombuffer(raw, form)
        order = np.argsort(c.keys)
        keys, values = c.keys[order], values[order]
        for first, end, data, offsets in blocks(texts.column("text")):
            found, rows = _keys(data, offsets, kind, depth)
            some, which = np.unique(found, return_inverse=True)
            got = values[np.searchsorted(keys, some)]
            bounds = np.concatenate(([0], np.cumsum(rows)))
            per_row = lambda x: (s := np.concatenate(([0.0], np.cumsum(x[which], dtype=np.float64))))[bounds[1:]] - s[bounds[:-1]]  # noqa: B023,E731
            if kind == GRAMS:
                out["score"][first:end], out["n_bytes"][first:end] = per_row(got), rows - 1
            else:
                out["base_score"][first:end] = per_row(log(got))
                out["n_tokens"][first:end] += rows
                out["n_known"][first:end] += np.rint(per_row(got > 0)).astype(np.int64)
    out["base_score"] += log(side["ends"])
    return pa.table({"doc_id": texts.column("doc_id")} | {c: pa.array(x) for c, x in out.items()})


def held_out(doc_id: str = "doc_id", of: int = 10) -> Column:
    """Whether a row is kept from training; rows without doc_id are."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of == 0


def scored(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_bytes, score (log10 probability of the text and its end by a model of the rows
    not held out), and a unigram model's n_tokens, n_known, train_tokens, base_score.

    A-Z are lower-cased. Null text: empty, only its end is scored. Rows without doc_id are held out. Repeated rows are
    learned from and scored each; the order of rows doesn't matter. A text longer than a chunk is a chunk of its own.
    Without training texts every bit has probability one half. An empty table gives no rows. Other columns are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("trains", (~held_out()).cast("int"))
    seen = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum("trains").alias("ends")).first()
    chars, ends = seen["chars"] or 0, seen["ends"] or 0
    n_chunks, n_buckets = ways(chars, rule.chunk_chars), ways(chars, rule.bucket_chars)
    args = {"depth": rule.depth, "n_buckets": n_buckets}
    n_parts = ways(min(chars, PART_BOUND), rule.bucket_chars)
    chunks = chunked(rows, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")], n_chunks)
    depth = rule.depth
    counts = Exchange("chunk", "bucket", n_buckets, rule.fan, (("keys", "binary"), ("n", "binary")), ("kind",))
    told = Exchange("bucket", "chunk", n_chunks, rule.fan, (("answer", "binary"), ("known", "long"), ("total", "long")), ("kind",))
    sent = chunks.mapInArrow(partial(by_chunk, work=_send, side={}, args=args | {"out": counts}), counts.schema())
    sent = written(counts.received(sent), "counts")
    # Tasks are as many as the buckets ask for, two each, whatever the session's number of partitions.
    by_bucket = lambda df: df.repartition(ways(n_buckets, 2), "bucket").groupBy("bucket")
    of_grams, of_words = (by_bucket(sent.filter(f"kind = {k}")) for k in (GRAMS, WORDS))
    distinct = of_grams.applyInArrow(lambda key, t: _distinct(key, t, depth, n_parts, counts), "part int, bucket int, keys binary, n binary")
    distinct = written(distinct, "grams")
    nodes = written(distinct.groupBy("part").applyInArrow(lambda key, t: _lift(key, t, depth), f"part int, {_NODES}"), "nodes")
    lengths = distinct.groupBy("part").cogroup(_upper(nodes).groupBy("part")).applyInArrow(lambda key, t, u: _lengths(key, t, u, depth), "bucket int, keys binary, lengths binary")
    lengths = of_grams.cogroup(by_bucket(lengths)).applyInArrow(lambda key, t, u: _told(key, t, u, counts, told), told.schema())
    words = of_words.applyInArrow(lambda key, t: _word_counts(key, t, counts, told), told.schema())
    answers = told.received(lengths.unionByName(words))
    path = side_table(answers, "answers", n_chunks)
    all_ = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) if told.wide else c).alias(c)
    sums = docs.sparkSession.read.schema(answers.schema).parquet(path).agg(all_("known"), all_("total")).first()
    known, total = (sums["known"] or 0) + (ends > 0), (sums["total"] or 0) + ends
    work = partial(_finished, known=known, total=total, ends=ends, into=told)
    out = chunks.mapInArrow(partial(by_chunk, work=work, side={"answers": path}, args=args), "doc_id long, score double, base_score double, n_tokens long, n_known long, n_bytes long")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")


def _finished(number: int, texts: pa.Table, side: dict, ends: int, **args) -> pa.Table:
    return _sums(number, texts, side | {"ends": ends}, **args)
