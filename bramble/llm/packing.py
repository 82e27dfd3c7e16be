"""Best-fit packing of token sequences behind a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: `capacity` counts, however many
documents there are. The driver solves the histogram; it never sees a document.

1. Every text is encoded once; its pieces' spans, lengths and ranks among equal lengths of the task are written.
2. `reduced` fixes small sets of lengths that dominate every other set with the same item: an item nothing fits
   beside, an exact pair, the largest partner where only one can join, the largest pair where only two can. Each rule
   is applied to all copies at once, which stays valid as taking items away only leaves fewer alternatives.
3. `best_fit` packs the rest in order of decreasing length, each into the fullest open bin that holds it, again by
   counts: bins of the same content are one group. A length splits at most one group and opens at most two.
4. A pattern of lengths with its count gives, for each length, intervals of ranks; a piece finds its sequence and
   offset from its rank by binary search in that table, whose size step 3 bounds by the capacity. What the ranks of a
   task's pieces start from lies in the shared folder, a small file for each task; nothing is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, side_part, side_table, tidy, tokenizer_path, written

#: Lengths in one sequence, largest first, and how many sequences have them.
Pattern = tuple[tuple[int, ...], int]

_PIECES = "chunk int, doc_id long, piece int, start long, length int, ids_crc32 long, own_rank long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Counts:
    """How many items of each length are left, with the few lookups that the rules need."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.copy()

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.n[: most + 1] > 0)
        return int(found[-1]) if len(found) else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """Up to k smallest items longer than `above`, copies counted."""
        out: list[int] = []
        for s in np.flatnonzero(self.n[above + 1 :] > 0)[:k] + above + 1:
            out += [int(s)] * min(int(self.n[s]), k - len(out))
            if len(out) == k:
                break
        return out


def _copies(left: _Counts, group: tuple[int, ...]) -> int:
    return min(int(left.n[s]) // group.count(s) for s in set(group))


def _dominating(left: _Counts, s: int, capacity: int) -> tuple[int, ...] | None:
    """A set with an item of length s that dominates every other set with it, if a rule finds one."""
    space = capacity - s
    left.n[s] -= 1
    try:
        first = left.smallest(3)
        if not first or first[0] > space:
            return (s,)
        partner = left.largest(space)
        if partner == space or len(first) < 2 or first[0] + first[1] > space:
            return (s, partner)
        if len(first) < 3 or sum(first) > space:
            left.n[partner] -= 1
            second = left.largest(space - partner)
            left.n[partner] += 1
            above = left.smallest(2, second)
            # Two items longer than `second` never fit, so every pair that joins has one item of at most `second`.
            if second and (len(above) < 2 or sum(above) > space):
                return (s, partner, second)
        return None
    finally:
        left.n[s] += 1


def reduced(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """The sets that are fixed for good, and the counts that are left. counts[s]: items of length s."""
    left, fixed, again = _Counts(counts), [], True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while left.n[s] > 0 and (group := _dominating(left, s, capacity)):
                m = _copies(left, group)
                fixed.append((tuple(sorted(group, reverse=True)), m))
                for x in group:
                    left.n[x] -= m
                again = True
    return fixed, left.n


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit in order of decreasing length, for all bins of the same content at once."""
    room: dict[int, list[list]] = {}  # by the space left: [content, count]
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        for space in sorted(x for x in room if x >= s):
            fit = space // s
            while n and room.get(space):
                content, bins = room[space].pop()
                use = min(bins, n // fit)
                if use:
                    room.setdefault(space - fit * s, []).append([content + (s,) * fit, use])
                    n -= use * fit
                if use < bins and n:  # fewer than `fit` are left for one more bin
                    room.setdefault(space - n * s, []).append([content + (s,) * n, 1])
                    use, n = use + 1, 0
                if use < bins:
                    room[space].append([content, bins - use])
        fit = capacity // s
        if n // fit:
            room.setdefault(capacity - fit * s, []).append([(s,) * fit, n // fit])
        if n % fit:
            room.setdefault(capacity - n % fit * s, []).append([(s,) * (n % fit), 1])
    return [(content, bins) for groups in room.values() for content, bins in groups]


def solved(counts: np.ndarray, capacity: int) -> list[Pattern]:
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Intervals of ranks: the n pieces of a length from rank `first` go to n sequences from `base`, at `offset`."""
    rows, used, base = [], {}, 0
    for content, n in patterns:
        offset = 0
        for s in content:
            first = used.get(s, 0)
            rows.append((s, first, base, offset))
            used[s] = first + n
            offset += s
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) | table[:, 1], "first": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


@tidy
def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    encode = encoder(path)
    schema = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("own_rank", pa.int64())])
    for batch in batches:
        doc_ids = batch.column(0)
        for first, ids, bounds in encode.encode(batch.column(1)):
            rows, piece, start, length, crc = [], [], [], [], []
            for k in range(len(bounds) - 1):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                at, n = 0, len(own)
                for i in range(-(-n // capacity)):
                    size = (n - 1) % capacity + 1 if i == 0 else capacity
                    rows.append(first + k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own[at : at + size].data))
                    at += size
            sizes = np.array(length, np.int64)
            order = np.argsort(sizes, kind="stable")
            ranked = sizes[order]
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk, np.int32)), doc_ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(rank)], schema=schema)


@tidy
def _place(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray], bases: str, capacity: int) -> Iterator[pa.RecordBatch]:
    chunk, base = None, np.zeros(capacity + 1, np.int64)
    for b in batches:
        length, rank = np.asarray(b.column("length")).astype(np.int64), np.asarray(b.column("own_rank")).copy()
        chunks = np.asarray(b.column("chunk"))
        for part in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(chunks)) + 1) if len(chunks) else ():
            if chunks[part[0]] != chunk:  # a chunk's few ranks, read where its pieces are
                chunk, own = int(chunks[part[0]]), side_part(bases, int(chunks[part[0]]))
                base[own.column("length").to_numpy()] = own.column("base").to_numpy()
            rank[part] += base[length[part]]
        at = np.searchsorted(table["key"], (length << 44) | rank, "right") - 1
        sequence = table["base"][at] + rank - table["first"][at]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("start"), pa.array(length), b.column("ids_crc32"), pa.array(sequence), pa.array(table["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of every text and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text (null: empty) gives its ids and end_id; only longer ones are cut, into `capacity` tokens a piece but the
    first. An empty text is a piece of one token. Rows with the same doc_id, or none, are packed one by one; equal lengths
    are packed in the order in which they are met. A text of any length is cut as it is encoded. An empty table gives no
    rows. Columns other than doc_id and text are not used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = tokenizer_path(tokenizer)
    pieces = written(rows.mapInArrow(partial(_cut, path=path, end_id=end_id, capacity=capacity), _PIECES), "pieces")
    by_chunk = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = written(by_chunk, "piece-counts")
    bases = side_table(by_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-ranks", by_chunk.select("chunk").distinct().count())
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    table = slots(solved(counts, capacity))
    return pieces.mapInArrow(partial(_place, table=table, bases=bases, capacity=capacity), _PACKED)
