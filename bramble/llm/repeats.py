"""Removal of repeated passages by fixed-block anchors.

With windows of `window` words and blocks of half of that, every window holds one whole block of its document that
starts at a multiple of the block length. So a window that occurs twice has a block of one occurrence (its anchor)
among the rolling block-long windows of the other.

1. Chunks: texts are dealt into chunks by ranges of doc_id and written, a chunk to a file of one row group, so that
   every later pass reads whole chunks in order and no text is shuffled again.
2. Index and probes: a chunk sends, to buckets by hash, the hashes of its aligned blocks and of all its rolling windows
   of block length, each hash once, packed into one binary value per bucket. 32 bits of the hash and the bucket's own
   number are enough here, for this step only chooses candidates. A bucket task keeps the hashes that are in the index
   and occur more than once, and tells the chunks that have them.
3. Extension: in its chunk, each hit is extended to all windows of full length around it. Consecutive windows with an
   earlier occurrence make up the maximal exact repeats. The windows' 128-bit hashes go to buckets, each once per chunk;
   as chunks are in the order of doc_id, the smallest chunk with a hash has its first place, and each chunk gets back
   one bit a window that says whether it is that one.
   Chunks and buckets exchange cells by blocks where they are many (`common.Exchange`), so rows don't grow as their product.
4. A chunk marks the words under windows that start earlier, and takes them out.

A passage in a third of all documents comes once per chunk, not once per occurrence, so no key is hot; copies are
never paired up. The verdict rests on the 128-bit hashes of whole windows, the anchors only choose candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Exchange, Rolling, blocks, by_chunk, chunked, side_table, tidy_group, total_chars, ways, word_bounds


@dataclass(frozen=True)
class Repeats:
    window: int = 20
    #: Characters of text in one chunk, and rolling windows in one bucket, about.
    chunk_chars: int = 16_000_000
    bucket_chars: int = 16_000_000
    #: Buckets or chunks up to which their exchange is one row a pair.
    fan: int = 4096
    #: Whether kept_text is the text with the removed words cut out, all else as it is, and not the kept words joined.
    cut_out: bool = False

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


#: Two hashes of a window, of tables and bases of their own.
_HASHERS = (Rolling(21), Rolling(22, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _whole(row: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """For each of the runs of n words, whether it stays within one row."""
    m = max(0, n_words - n + 1)
    end = np.repeat(row[1:], np.diff(row))[:m] if m else np.zeros(0, np.int64)
    return np.arange(m) + n <= end


def _keys(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket, from a hash's upper half, above its lower half."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


#: Bytes of cells that travel in one batch, about, and values that a bucket's task compares at once.
_SENT, _AT_ONCE = 1_000_000, 250_000


def _cells(of: str, number: int, cells: Iterator[tuple], schema: pa.Schema, out: Exchange) -> Iterator[pa.Table]:
    """What a chunk or bucket has for others, (other, a few binary values) each, as tables of about _SENT bytes."""
    held, n = [], 0

    def table() -> pa.Table:
        columns = dict(zip([out.to, *(x for x, _ in out.fields)], zip(*held, strict=True), strict=True)) | {of: [number] * len(held)}
        return out.sent(pa.table({x.name: pa.array(columns[x.name], x.type) for x in schema}))

    for cell in cells:
        held.append(cell)
        n += sum(len(x) for x in cell[1:])
        if n >= _SENT:
            yield table()
            held, n = [], 0
    if held:
        yield table()


def _probe(number: int, texts: pa.Table, side: dict, rule: Repeats, n_buckets: int, out: Exchange) -> Iterator[pa.Table]:
    """(bucket, chunk, hashes, marks): mark 1: an aligned block is among the occurrences, 2: it occurs more than once."""
    found = []
    for first, end, data, offsets in blocks(texts.column("text")):
        words, _, _, row = _HASHERS[0].words(data, offsets, lower=False)
        at = np.flatnonzero(_whole(row, len(words), rule.block))
        owner = np.repeat(np.arange(end - first), np.diff(row))[at]
        keys = _keys(_HASHERS[0].runs(words, rule.block)[at], n_buckets)
        # The mark goes below the key, for one sort of both.
        found.append((keys << np.uint64(1)) | ((at - row[owner]) % rule.block == 0).astype(np.uint64))
    both = np.concatenate(found) if found else np.zeros(0, np.uint64)
    found.clear()
    both.sort()

    def cells() -> Iterator[tuple]:
        # A bucket at a time: few of them make no large arrays.
        bounds = np.searchsorted(both, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(33))
        for bucket in np.flatnonzero(np.diff(bounds)).tolist():
            own = both[bounds[bucket] : bounds[bucket + 1]]
            keys, aligned = own >> np.uint64(1), (own & np.uint64(1)).astype(np.uint8)
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            starts = np.flatnonzero(new)
            twice = np.diff(np.append(starts, len(keys))) > 1
            marks = np.maximum.reduceat(aligned, starts) | (twice.astype(np.uint8) << 1)
            yield bucket, keys[starts].astype(np.uint32).tobytes(), marks.tobytes()

    schema = pa.schema({"bucket": pa.int32(), "chunk": pa.int32(), "hashes": pa.binary(), "marks": pa.binary()})
    yield from _cells("chunk", number, cells(), schema, out)


def _slices(parts: list[np.ndarray]) -> Iterator[list[slice]]:
    """Of ascending arrays, slices for one range of values after the other, of about _AT_ONCE values together."""
    full = [x for x in parts if len(x)]
    if not full:
        return
    low, high = min(int(x[0]) for x in full), max(int(x[-1]) for x in full)
    n = -(-sum(len(x) for x in full) // _AT_ONCE)
    edges = np.array(sorted({low + (high - low) * k // n for k in range(1, n)}), full[0].dtype)
    at = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in parts]
    for k in range(len(edges) + 1):
        yield [slice(x[k], x[k + 1]) for x in at]


@tidy_group
def _hits(key, table: pa.Table, into: Exchange, out: Exchange) -> pa.Table:
    """A bucket's hashes with an aligned block that occur more than once, for each chunk that has them."""
    table = into.cells(table)
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")]
    own_marks = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("marks")]
    of = table.column("chunk").to_numpy()
    found = [(np.zeros(0, of.dtype), np.zeros(0, np.uint32))]
    for some in _slices(parts):
        hashes = np.concatenate([x[i] for x, i in zip(parts, some, strict=True)])
        marks = np.concatenate([x[i] for x, i in zip(own_marks, some, strict=True)])
        if not len(hashes):
            continue
        chunks = np.repeat(of, [i.stop - i.start for i in some])
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(ranked)))
        every = np.bitwise_or.reduceat(marks[order], starts)
        hit = order[np.repeat(((every & 1) == 1) & (((every & 2) == 2) | (sizes > 1)), sizes)]
        found.append((chunks[hit], hashes[hit]))
    chunks, hashes = (np.concatenate([x[i] for x in found]) for i in range(2))
    order = np.argsort(chunks, kind="stable")
    own, starts = np.unique(chunks[order], return_index=True)
    bounds = np.append(starts, len(order))
    bucket = np.uint64(key[0].as_py() << 32)
    keys = [(hashes[order[a:b]].astype(np.uint64) | bucket).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out.sent(pa.table({"chunk": pa.array(own, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(own), pa.int32()), "hashes": pa.array(keys, pa.binary())}))


@tidy_group
def _firsts(key, table: pa.Table, into: Exchange, out: Exchange) -> pa.Table:
    """For each chunk that sent hashes to a bucket, a bit for each: whether no chunk before it has that hash."""
    table = into.cells(table).sort_by("chunk")
    pairs = [np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for x in table.column("hashes")]
    told = [np.empty(x.shape[1], bool) for x in pairs]
    for some in _slices([x[0] for x in pairs]):
        h1, h2 = np.concatenate([x[:, i] for x, i in zip(pairs, some, strict=True)], axis=1)
        sizes = [i.stop - i.start for i in some]
        order = np.lexsort((np.repeat(np.arange(len(pairs)), sizes), h2, h1))
        first = np.ones(len(order), bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        own = np.empty(len(order), bool)
        own[order] = first
        for x, i, y in zip(told, some, np.split(own, np.cumsum(sizes)[:-1]), strict=True):
            x[i] = y
    bits = [np.packbits(x).tobytes() for x in told]
    return out.sent(pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())}))


class _Windows:
    """A chunk's candidate windows: for each block of texts their places in it, and the distinct ones' hashes, by bucket.

    places: also which of the distinct ones each candidate is, where it stands, and where each is first in the chunk.
    """

    def __init__(self, texts: pa.Table, hits: pa.Table | None, rule: Repeats, n_buckets: int, places: bool) -> None:
        self.blocks: list[np.ndarray] = []
        one, two, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for own, h1, h2, place in _candidates(texts, hits, rule, n_buckets):
            one.append(h1)
            two.append(h2)
            if places:
                self.blocks.append(own.astype(np.int32))
                at.append(place)
        h1 = np.concatenate(one)
        one.clear()
        h2 = np.concatenate(two)
        two.clear()
        self.at = np.concatenate(at)
        at.clear()
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        self.h1, self.h2 = h1[starts], h2[starts]
        del h1, h2
        if places:
            self.number = np.empty(len(order), np.int32)
            self.number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            self.first = np.minimum.reduceat(self.at[order], starts) if len(starts) else self.at
        bucket = (((self.h1 >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
        self.bucket, begin = np.unique(bucket, return_index=True)
        self.bounds = np.append(begin, len(starts))


def _candidates(texts: pa.Table, hits: pa.Table | None, rule: Repeats, n_buckets: int) -> Iterator[tuple]:
    """(candidate windows' first words in the block, two hashes, document and place in it) for each block of texts."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in hits.column("hashes")] if hits is not None else []
    known = np.concatenate([np.zeros(0, np.uint64), *parts])
    known.sort()
    # Rows with equal doc_id and text are one document.
    ids, copy = texts.column("doc_id"), texts.column("copy").to_numpy()
    null, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
    other = np.ones(len(ids), bool)
    other[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (copy[1:] != copy[:-1])
    document = np.cumsum(other)
    n, b = rule.window, rule.block
    for first, end, data, offsets in blocks(texts.column("text")):
        at, place, h1, h2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        words, _, _, row = _HASHERS[0].words(data, offsets, lower=False) if len(known) else (at, at, at, at)
        if len(words) >= n:
            keys = _keys(_HASHERS[0].runs(words, b), n_buckets)
            near = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
            hit = np.flatnonzero(near & _whole(row, len(words), b))
            # A full window that starts up to n - b words before a hit holds it.
            edge = np.zeros(len(words) + 1, np.int32)
            np.add.at(edge, np.maximum(hit - (n - b), 0), 1)
            np.add.at(edge, hit + 1, -1)
            full = _whole(row, len(words), n)
            at = np.flatnonzero(full & (np.cumsum(edge[:-1])[: len(full)] > 0))
            if len(at):
                owner = np.repeat(np.arange(end - first), np.diff(row))[at]
                h1 = _HASHERS[0].runs(words, n)[at]
                h2 = _HASHERS[1].runs(_HASHERS[1].words(data, offsets, lower=False)[0], n)[at]
                place = (document[first + owner].astype(np.int64) << 32) | (at - row[owner])
        yield at, h1, h2, place


def _got(side: dict, name: str, into: Exchange) -> pa.Table | None:
    return None if side[name] is None else into.cells(side[name])


def _send(number: int, texts: pa.Table, side: dict, rule: Repeats, n_buckets: int, hits: Exchange, out: Exchange) -> Iterator[pa.Table]:
    w = _Windows(texts, _got(side, "hits", hits), rule, n_buckets, places=False)
    cells = ((k, np.concatenate((w.h1[a:b], w.h2[a:b])).tobytes()) for k, a, b in zip(w.bucket.tolist(), w.bounds[:-1], w.bounds[1:], strict=True))
    yield from _cells("chunk", number, cells, pa.schema({"bucket": pa.int32(), "chunk": pa.int32(), "hashes": pa.binary()}), out)


def _taken_out(number: int, texts: pa.Table, side: dict, rule: Repeats, n_buckets: int, hits: Exchange, firsts: Exchange) -> Iterator[pa.Table]:
    """Every text without the words under windows that start earlier elsewhere."""
    w = _Windows(texts, _got(side, "hits", hits), rule, n_buckets, places=True)
    own = np.ones(len(w.first), bool)
    bits = _got(side, "firsts", firsts)
    if bits is not None:
        for bucket, raw in zip(bits.column("bucket").to_pylist(), bits.column("bits"), strict=True):
            k = int(np.searchsorted(w.bucket, bucket))
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            own[a:b] = np.unpackbits(np.frombuffer(raw.as_buffer(), np.uint8), count=b - a).astype(bool)
    earlier = ~(own[w.number] & (w.first[w.number] == w.at))
    w.at = w.first = w.number = w.h1 = w.h2 = None
    done = 0
    for at, (first, end, data, offsets) in zip(w.blocks, blocks(texts.column("text")), strict=True):
        s, e, row = word_bounds(data, offsets)
        gone = np.zeros(len(s) + 1, np.int32)
        mark = at[earlier[done : done + len(at)]]
        done += len(at)
        np.add.at(gone, mark, 1)
        np.add.at(gone, np.minimum(mark + rule.window, len(s)), -1)
        out = np.cumsum(gone[:-1]) > 0
        raw = data.tobytes()
        n_words, n_removed, kept = [], [], []
        for k in range(end - first):
            a, b = int(row[k]), int(row[k + 1])
            stay = np.flatnonzero(~out[a:b]) + a
            n_words.append(b - a)
            n_removed.append(b - a - len(stay))
            if rule.cut_out:
                kept.append(_cut_out(raw[offsets[k] : offsets[k + 1]], s[a:b] - offsets[k], e[a:b] - offsets[k], out[a:b]))
            else:
                kept.append(b" ".join([raw[i:j] for i, j in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]))
        mine = texts.slice(first, end - first)
        rest = {"rest": mine.column("rest")} if "rest" in texts.column_names else {}
        yield pa.table({"doc_id": mine.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).view(pa.string())} | rest)


def _cut_out(raw: bytes, s: np.ndarray, e: np.ndarray, out: np.ndarray) -> bytes:
    """A text without runs of removed words, each with the gap behind it; what stays keeps its own spacing."""
    if not out.any():
        return raw
    edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
    parts, at = [], 0
    for first, after in edge.reshape(-1, 2).tolist():
        parts.append(raw[at : s[first]])
        at = int(s[after]) if after < len(s) else int(e[-1])
    return b"".join([*parts, raw[at:]])


def without_repeats(docs: DataFrame, rule: Repeats = Repeats(), carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank) and, if any are `carried`, a struct `rest`
    of those columns, for every row of docs.

    A word goes if a window over it has the same words as one that starts earlier: in a smaller doc_id, or earlier in
    its own text. Null text: no words. Rows without doc_id come before all others; rows that share a doc_id are ordered
    by a hash of their texts, and those with equal texts too are one document, with one result. A text longer than a
    chunk is a chunk of its own. An empty table gives no rows. Carried columns may have any names; others are not used.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in carried)).alias("rest")] if carried else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rest).withColumn("copy", F.xxhash64("text"))
    total = total_chars(docs)
    n_chunks, n_buckets = ways(total, rule.chunk_chars), ways(total, rule.bucket_chars)
    chunks = chunked(docs, [F.col("doc_id").asc_nulls_first(), F.col("copy")], n_chunks)

    def passed(work, schema, side=None, **args):  # noqa: ANN001, ANN202
        return chunks.mapInArrow(partial(by_chunk, work=work, side=side or {}, args={"rule": rule, "n_buckets": n_buckets, **args}), schema)

    to_bucket = lambda *fields: Exchange("chunk", "bucket", n_buckets, rule.fan, fields)
    to_chunk = lambda *fields: Exchange("bucket", "chunk", n_chunks, rule.fan, fields)
    probes, hits = to_bucket(("hashes", "binary"), ("marks", "binary")), to_chunk(("hashes", "binary"))
    windows, firsts = to_bucket(("hashes", "binary")), to_chunk(("bits", "binary"))
    sent = probes.received(passed(_probe, probes.schema(), out=probes)).groupBy("bucket")
    hit = side_table(hits.received(sent.applyInArrow(lambda key, t: _hits(key, t, probes, hits), hits.schema())), "hits", n_chunks)
    sent = windows.received(passed(_send, windows.schema(), {"hits": hit}, hits=hits, out=windows)).groupBy("bucket")
    first = side_table(firsts.received(sent.applyInArrow(lambda key, t: _firsts(key, t, windows, firsts), firsts.schema())), "firsts", n_chunks)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string")
    schema = StructType(schema.fields + [f for f in docs.schema.fields if f.name == "rest"])
    return passed(_taken_out, schema, {"hits": hit, "firsts": first}, hits=hits, firsts=firsts)
