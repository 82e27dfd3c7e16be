"""What the operators share: the shared folder, word hashing on whole Arrow batches, exact tokenizer encoding.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D. Words are hashed in numpy without a Python
loop: with one running sum over all bytes of a block, sum(T[b[i]] * R**i) mod 2**64, the hash of a word is a
difference of two sums times R**-start. Hashes of runs of words are made in the same way from word hashes.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.sources import shared
from bramble.sources.shared import file_system, fresh_path, put_file, shared_dir

#: Rows of an Arrow batch of texts.
ROWS = 1000
#: Bytes of text that one numpy block holds (a longer single text is a block of its own).
BLOCK_BYTES = 500_000
#: The contract's word pattern, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.arange(256, dtype=np.uint8)
_LOWER = _KEEP.copy()
_LOWER[65:91] += 32


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to the workers ROWS rows at a time at most: a batch of long texts is held several times on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS if int(before) <= 0 else min(ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df as a table in the shared folder, made from small batches of texts."""
    with small_batches(df.sparkSession):
        return shared.written(df, name, options)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_kept(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs, of any columns, that keep(batches, name of the text column) lets through."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    return plain.mapInArrow(lambda batches: keep(batches, text), plain.schema).toDF(*docs.columns)


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's work that gives memory that it freed back to the machine at its end: a worker waits for its next task
    beside others that run, and holds all that it ever held otherwise. Tokenizers go with the first task that asks for none."""

    @functools.wraps(work)
    def run(*args, **more):
        _ASKED.clear()
        try:
            yield from work(*args, **more)
        finally:
            if not _ASKED:
                _ENCODERS.clear()
            _give_back()

    return run


def tidy_group(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of one group, after each of them."""

    @functools.wraps(work)
    def run(*args, **more):
        try:
            return work(*args, **more)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    Rolling._powers.clear()  # made again in milliseconds
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def total_chars(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.length(column)).alias("n")).first()["n"] or 0


def ways(total: float, each: float, least: int = 4) -> int:
    """How many parts of about `each` units `total` makes."""
    return max(least, int(-(-total // each)))


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of a string column without nulls, zero-copy but for small
    pieces of a chunked column, which are joined up to the size of a block; the same ones for the same column."""
    before = 0
    for part in _parts(column, size):
        for first, end, data, offsets in _blocks(part, size):
            yield before + first, before + end, data, offsets
        before += len(part)


def _parts(column: pa.Array | pa.ChunkedArray, size: int) -> Iterator[pa.Array]:
    if not isinstance(column, pa.ChunkedArray):
        yield column
        return
    held, n = [], 0
    for k, piece in enumerate(column.chunks, 1):
        held.append(piece)
        n += piece.nbytes
        if n >= size or k == column.num_chunks:
            yield held[0] if len(held) == 1 else pa.concat_arrays(held)
            held, n = [], 0


def _blocks(column, size):
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


@tidy
def by_chunk(batches: Iterator[pa.RecordBatch], work, side: dict[str, str], args: dict) -> Iterator[pa.RecordBatch]:
    """Whole chunks from batches that hold one after the other; side: tables in the shared folder with a part per chunk.

    A work returns a table, or gives tables by turns: what it has given is not held here any more.
    """
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            number = held[0].column("chunk")[0].as_py()
            got = work(number, pa.Table.from_batches(held), {k: side_part(path, number) for k, path in side.items()}, **args)
            for table in [got] if isinstance(got, pa.Table) else got:
                yield from table.to_batches()
            held.clear()

    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        for part in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1) if len(chunk) else ():
            if held and held[0].column("chunk")[0].as_py() != chunk[part[0]]:
                yield from done()
            held.append(batch.slice(int(part[0]), len(part)))
    yield from done()


def side_part(path: str, number: int) -> pa.Table | None:
    """A chunk's rows of a side table."""
    fs, root = file_system(path)
    folder = f"{root}/chunk={number}"
    if fs.get_file_info(folder).type == pa.fs.FileType.NotFound:
        return None
    files = [x.path for x in fs.get_file_info(pa.fs.FileSelector(folder)) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]) if files else None


def side_table(df: DataFrame, name: str, n_chunks: int) -> str:
    """df in the shared folder, with a folder for each of n_chunks chunks, a few of them written by a task."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.repartition(ways(n_chunks, 4), "chunk").write.partitionBy("chunk").parquet(path)
    return path


def chunked(df: DataFrame, order: list, n: int) -> DataFrame:
    """df sorted by `order` in n chunks by ranges of it, written a chunk to a file of one row group, with a column chunk.

    A file of one row group is never divided among tasks, so every scan has each chunk whole and in order.
    """
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.select(F.spark_partition_id().alias("chunk"), *df.columns), "chunks", {"parquet.block.size": 2**30})


# ---- exchange between chunks and buckets
#
# A cell is what one chunk has for one bucket, or gets back from it: (chunk, bucket, a few fields). Both are as many as the
# corpus is large, so where there are more than `fan` of those that cells go to, cells don't travel as rows: a sender
# puts those for `fan` neighbours in one row, as lists, and between the two sides a task turns such blocks of `fan` by
# `fan` cells over, so that a receiver gets one row from `fan` senders. Fewer cells are rows of their own.


@dataclass(frozen=True)
class Exchange:
    """Cells from senders (column `of`) to receivers (column `to`); fields: (name, type) of the rest, in SQL's terms."""

    of: str
    to: str
    receivers: int
    fan: int
    fields: tuple[tuple[str, str], ...]
    #: Columns that tell apart what goes one way only, such as kinds.
    apart: tuple[str, ...] = ()

    @property
    def wide(self) -> bool:
        return self.receivers > self.fan

    def sent(self, cells: pa.Table) -> pa.Table:
        """Cells of one sender, as they travel."""
        if not self.wide:
            return cells.select([*self.apart, self.to, self.of, *(n for n, _ in self.fields)])
        cells = cells.sort_by([(c, "ascending") for c in (*self.apart, self.to)])
        keys = [np.asarray(cells.column(c)).astype(np.int64) for c in self.apart] + [np.asarray(cells.column(c)).astype(np.int64) // self.fan for c in (self.to, self.of)]
        return self._lists(cells, keys, [*self.apart, "wide", "other"], [self.to, self.of])

    def _lists(self, cells: pa.Table, keys: list[np.ndarray], names: list[str], listed: list[str]) -> pa.Table:
        """A row for each run of equal keys, the rest as lists."""
        new = np.ones(len(cells), bool)
        if len(cells):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        offsets = pa.array(np.append(starts, len(cells)), pa.int32())
        lists = {c: pa.ListArray.from_arrays(offsets, cells.column(c).combine_chunks()) for c in [*listed, *(n for n, _ in self.fields)]}
        return pa.table({n: pa.array(k[starts], pa.int32()) for n, k in zip(names, keys, strict=True)} | lists)

    def schema(self) -> str:
        """Of the rows that senders' tasks return."""
        if not self.wide:
            return ", ".join([*(f"{c} int" for c in (*self.apart, self.to, self.of)), *(f"{n} {t}" for n, t in self.fields)])
        return ", ".join([*(f"{c} int" for c in (*self.apart, "wide", "other")), *(f"{c} array<int>" for c in (self.to, self.of)), *(f"{n} array<{t}>" for n, t in self.fields)])

    def received(self, rows: DataFrame) -> DataFrame:
        """Rows of which each has one receiver, in the column `to`."""
        if not self.wide:
            return rows
        schema = ", ".join([*(f"{c} int" for c in (*self.apart, self.to)), f"{self.of} array<int>", *(f"{n} array<{t}>" for n, t in self.fields)])
        return rows.groupBy(*self.apart, "wide", "other").applyInArrow(lambda key, t: self._turned(t), schema)

    def _turned(self, table: pa.Table) -> pa.Table:
        each = {c: pa.compute.list_flatten(table.column(c)) for c in (self.to, self.of, *(n for n, _ in self.fields))}
        n = pa.compute.list_value_length(table.column(self.to))
        for c in self.apart:
            each[c] = pa.array(np.repeat(np.asarray(table.column(c)), np.asarray(n)), pa.int32())
        cells = pa.table(each).sort_by([(self.to, "ascending"), (self.of, "ascending")])
        keys = [np.asarray(cells.column(c)).astype(np.int64) for c in (*self.apart, self.to)]
        return self._lists(cells, keys, [*self.apart, self.to], [self.of])

    def cells(self, table: pa.Table) -> pa.Table:
        """The cells of what a receiver got; a side table's rows don't say whose they are."""
        if not self.wide:
            return table
        n = np.asarray(pa.compute.list_value_length(table.column(self.of)))
        own = {c: pa.array(np.repeat(np.asarray(table.column(c)), n), pa.int32()) for c in (*self.apart, self.to) if c in table.column_names}
        return pa.table(own | {c: pa.compute.list_flatten(table.column(c)) for c in (self.of, *(n for n, _ in self.fields))})


class Rolling:
    """Hashes of byte runs and of runs of words, a function of the seed and the content alone.

    Seeds differ in their tables; the powers of a base are shared by all of a worker's hashers that have it. Hashes that
    are to fail apart from each other need bases of their own besides.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int = 1, base: int = 0x2545F4914F6CDD1D, step: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.step = base, step
        r = np.random.Generator(np.random.PCG64(seed))
        self.table = r.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(base)
        if have is None or len(have[0]) < n:
            m = max(n, BLOCK_BYTES // 4 if have is None else n)
            up, down = np.full(m, base & (2**64 - 1), np.uint64), np.full(m, pow(base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            have = self._powers[base] = (np.cumprod(up), np.cumprod(down))
        return have

    def words(self, data: np.ndarray, offsets: np.ndarray, lower: bool, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, byte starts, byte ends, index of each row's first word, one more at the end)."""
        s, e, row = word_bounds(data, offsets, gap)
        if not len(data):
            return np.zeros(0, np.uint64), s, e, row
        up, down = self.powers(self.base, len(data))
        value = self.table[_LOWER[data] if lower else data]
        value *= up[: len(data)]
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        return mixed((total[e] - total[s]) * down[s]), s, e, row

    def runs(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The hash of each n consecutive words, by the first one's index; runs over row bounds are the caller's to drop."""
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        up, down = self.powers(self.step, len(hashes))
        total = np.empty(len(hashes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mixed((total[n:] - total[:m]) * down[:m])


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, index of each row's first word, one more at the end) of the words in a block."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[1:-1]
    at = at[at < len(data)]
    begins[at] = inside[at]
    at = at[at > 0]
    ends[at - 1] = inside[at - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CAPITAL_OR_SMALL = np.zeros(256, bool)
_CAPITAL_OR_SMALL[65:91] = _CAPITAL_OR_SMALL[97:123] = True
#: Bytes of signs and space: what is left are ASCII letters and digits and all of other scripts.
SIGNS = np.ones(256, bool)
SIGNS[128:] = SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = False
#: ASCII signs before which a word may be cut; not the apostrophe, which begins pre-tokens such as 's.
_SIGN = np.zeros(256, bool)
_SIGN[[33, 35, 36, 37, 38, 41, 42, 44, 46, 58, 59, 63, 93, 124, 125]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
#: Space other than blank and line feed: a text with any of it is encoded in one piece.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MAY_BE_ODD = np.zeros(256, bool)
_MAY_BE_ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_PLAIN = re.compile(r" ?[^ \n\x00]+\Z")


class PieceEncoder:
    """Exact encoding by the tokenizers library that encodes each distinct piece of text once.

    No pre-token of the public byte- and word-level BPE files goes on from a non-space to a space or from an ASCII
    letter to a sign other than the apostrophe, so cutting there leaves all pre-tokens whole, and the ids of a text
    are those of its pieces. Pieces are found and told apart by numpy; only new ones reach the tokenizer, many at a
    time, joined by a space that no piece can take in. A text with other space characters is encoded whole, and so is
    one with the string of an added token, unless those are ordinary text (`marks_as_text`). Known pieces stay for the
    worker's next tasks; all are forgotten when there are more than `most`.
    """

    def __init__(self, path: str, marks_as_text: bool = False, most: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = marks_as_text
        marks = () if marks_as_text else [str(x) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = [x.lower().encode() for x in marks]
        #: The word-level file drops white space and lower-cases; the byte-level one keeps both.
        self.drops_space = self.tokenizer.normalizer is not None
        #: What stands between pieces that are encoded together: a pre-token of its own, of one id, in no piece.
        self.gap = " \x00 " if self.drops_space else "\n"
        (self.gap_id,) = self.tokenizer.encode(self.gap, add_special_tokens=False).ids
        self.hasher, self.most = Rolling(7), most
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows one after the other, where each row's ids start and one more) by turns."""
        for first, end, data, offsets in blocks(texts):
            odd = self._whole(data, offsets) if len(data) else set()
            if not odd:
                yield first, *self._block(data, offsets)
                continue
            for row in range(end - first):
                own = data[offsets[row] : offsets[row + 1]]
                if row in odd:
                    ids = np.array(self.tokenizer.encode(_text(own, 0, len(own)), add_special_tokens=False).ids, np.uint32)
                    yield first + row, ids, np.array([0, len(ids)])
                else:
                    yield first + row, *self._block(own, np.array([0, len(own)]))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> set[int]:
        """The rows that are encoded in one piece."""
        of = lambda at: (np.unique(np.searchsorted(offsets, at, "right")) - 1).tolist()
        out = {r for r in of(np.flatnonzero(_MAY_BE_ODD[data])) if _ODD.search(_text(data, offsets[r], offsets[r + 1]))}
        low = data.tobytes().lower() if self.marks else b""
        for mark in self.marks:
            at = low.find(mark)
            while at >= 0:
                out.update(of(np.array([at])))
                at = low.find(mark, at + 1)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        gap = _BREAK[data]
        begin = np.zeros(n, bool)
        begin[1:] = _SIGN[data[1:]] & _CAPITAL_OR_SMALL[data[:-1]]
        if self.drops_space:
            begin[1:] |= ~gap[1:] & gap[:-1]
        else:
            begin[1:] |= gap[1:] & ~gap[:-1]
        rows = offsets[:-1]
        begin[rows[rows < n]] = True
        if self.drops_space:
            begin &= ~gap
        s = np.flatnonzero(begin)
        e = np.append(s[1:], n)
        if self.drops_space:
            stop = np.append(np.flatnonzero(gap), n)
            e = np.minimum(e, stop[np.searchsorted(stop, s)])
        up, down = self.hasher.powers(self.hasher.base, n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.hasher.table[_LOWER[data] if self.drops_space else data] * up[:n], out=total[1:])
        own, at, which = np.unique(mixed((total[e] - total[s]) * down[s]), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        place = np.searchsorted(self.known, own)
        new = self.known[np.minimum(place, len(self.known) - 1)] != own if len(self.known) else np.ones(len(own), bool)
        if new.any():
            self._add(own[new], [_text(data, a, b) for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)], place[new])
            place = np.searchsorted(self.known, own)
        size, first = self.size[place][which], self.first[place][which]
        ends = np.cumsum(size)
        where = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        bounds = np.concatenate(([0], ends))[np.searchsorted(s, offsets)]
        return self.ids[where], bounds

    def _add(self, hashes: np.ndarray, pieces: list[str], place: np.ndarray) -> None:
        first, size = np.empty(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        plain = np.array([bool(_PLAIN.match(p)) for p in pieces])
        for k in np.flatnonzero(~plain):
            self._put(self.tokenizer.encode(pieces[k], add_special_tokens=False).ids, [k], first, size, None)
        order = np.flatnonzero(plain)
        for k in range(0, len(order), 2048):
            some = order[k : k + 2048]
            got = self.tokenizer.encode_batch_fast([self.gap + self.gap.join([pieces[i] for i in some])], add_special_tokens=False)[0]
            self._put(got.ids, some, first, size, self.gap_id)
        self.known, self.first, self.size = np.insert(self.known, place, hashes), np.insert(self.first, place, first), np.insert(self.size, place, size)

    def _put(self, ids, which, first, size, gap_id) -> None:
        ids = np.asarray(ids, np.uint32)
        counts = np.array([len(ids)])
        if gap_id is not None:
            gaps = ids == gap_id
            counts = np.bincount(np.cumsum(gaps)[~gaps] - 1, minlength=len(which))
            ids = ids[~gaps]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(len(ids), len(self.ids)), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        first[which], size[which] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)


def _text(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}
#: The encoders that this worker's task has asked for.
_ASKED: set[tuple[str, bool]] = set()


def encoder(path: str, marks_as_text: bool = False) -> PieceEncoder:
    """This worker's encoder of a tokenizer file; it keeps its pieces from task to task, but only one file's."""
    key = path, marks_as_text
    _ASKED.add(key)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, marks_as_text)
    return _ENCODERS[key]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; looked up by each worker, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
