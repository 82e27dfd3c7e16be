"""Token ids as raw binary shards with a minimal perfect hash index over the document keys.

Shards. Documents are dealt by ranges of doc_id, encoded and written in ascending order; one task writes one shard:

    magic "BRIDS001" | width u32 (2 or 4 bytes an id) | documents u32 | ids u64
    payload: all ids, little-endian, `width` bytes each
    starts: u64 for every document and one more, in ids
    keys: i64 doc_id of every document, then one byte each: 1 where the doc_id is null

Index. Keys are spread by hash over index parts of about `part_keys` keys. A part holds a minimal perfect hash over its
distinct keys: levels of bit arrays; a key takes the first level where its bit is set by no other key, and its number
is the rank of that bit. Beside it stand, in the order of these numbers, a 32-bit fingerprint from another hash (so a
foreign key is refused) and, for each shard that has it, the shard, the first document there and how many there are. A look-up is a few
hashes and reads, whatever the number of keys.

Files go to the folder shared by driver and executors, under a temporary name first, so a task that runs again after an
executor was lost leaves whole files only. A manifest (one small row per shard) gives the ids before each shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, file_system, fresh_path, mixed, put_file, tidy, tokenizer_path, total_chars, ways, written

MAGIC = b"BRIDS001"
_HEAD = struct.Struct("<8sIIQ")
#: The hash input that stands for a null key; a doc_id with the same value is told apart by its null byte.
_NULL = 0x6E756C6C


def key_hashes(keys: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    x = np.where(null, np.uint64(_NULL), keys.view(np.uint64)) + null.astype(np.uint64) * np.uint64(0xA5A5A5A5)
    return mixed(mixed(x + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) ^ np.uint64(seed))


class PerfectHash:
    """Levels of bit arrays; numbers 0..n-1 for n distinct key hashes, nothing else is known of the keys."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.concatenate(([0], np.cumsum([int(np.bitwise_count(x).sum()) for x in levels]))).astype(np.int64)
        self.ranks = [np.concatenate(([0], np.cumsum(np.bitwise_count(x).astype(np.int64)))) for x in levels]

    @staticmethod
    def _bit(h: np.ndarray, level: int, words: int) -> np.ndarray:
        return mixed(h + np.uint64((level + 1) * 0xD1342543DE82EF95 & (2**64 - 1))) % np.uint64(words * 64)

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        left, levels = hashes, []
        while len(left):
            words = max(1, -(-len(left) * 2 // 64))
            bit = cls._bit(left, len(levels), words)
            _, at, n = np.unique(bit, return_inverse=True, return_counts=True)
            alone = n[at] == 1
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (bit[alone] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit[alone] & np.uint64(63)))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 where no level has its bit."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            if not len(open_):
                break
            bit = self._bit(hashes[open_], k, len(bits))
            word, low = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            found = (bits[word] >> low) & np.uint64(1) == 1
            below = bits[word[found]] & ((np.uint64(1) << low[found]) - np.uint64(1))
            out[open_[found]] = self.before[k] + self.ranks[k][word[found]] + np.bitwise_count(below)
            open_ = open_[~found]
        return out


_SEED_PART, _SEED_PLACE, _SEED_PRINT = 1, 2, 3


@dataclass(frozen=True)
class Part:
    """One part of the index, as read from its file."""

    hash: PerfectHash
    prints: np.ndarray
    #: Where each key's runs start in the three arrays that follow; a key has a run in every shard that holds it.
    runs: np.ndarray
    shard: np.ndarray
    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, null: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> Part:
        place, once, back = np.unique(key_hashes(keys, null, _SEED_PLACE), return_index=True, return_inverse=True)
        h = PerfectHash.of(place)
        number = h.number(place)
        prints = np.empty(len(place), np.uint32)
        prints[number] = (key_hashes(keys[once], null[once], _SEED_PRINT) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((first, shard, number[back]))
        runs = np.concatenate(([0], np.cumsum(np.bincount(number[back], minlength=len(place)))))
        return cls(h, prints, *(x.astype(np.uint32) for x in (runs, shard[order], first[order], count[order])))

    def bytes(self) -> list[bytes]:
        sizes = [len(x) for x in self.hash.levels]
        head = np.array([len(sizes), *sizes, len(self.prints), len(self.shard)], "<u4").tobytes()
        return [head, *(x.astype("<u8").tobytes() for x in self.hash.levels), *(x.astype("<u4").tobytes() for x in (self.prints, self.runs, self.shard, self.first, self.count))]

    @classmethod
    def read(cls, folder: str, number: int) -> Part | None:
        fs, path = file_system(folder)
        name = f"{path}/part-{number:08d}"
        if fs.get_file_info(name).type == pa.fs.FileType.NotFound:
            return None
        with fs.open_input_file(name) as f:
            raw = f.read()
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        *sizes, keys, runs = np.frombuffer(raw, "<u4", n + 2, 4).tolist()
        at, levels, rest = 4 * (n + 3), [], []
        for size in sizes:
            levels.append(np.frombuffer(raw, "<u8", size, at))
            at += 8 * size
        for size in (keys, keys + 1, runs, runs, runs):
            rest.append(np.frombuffer(raw, "<u4", size, at))
            at += 4 * size
        return cls(PerfectHash(levels), *rest)

    def find(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, which run) for every run of every key that is there."""
        at = self.hash.number(key_hashes(keys, null, _SEED_PLACE))
        prints = (key_hashes(keys, null, _SEED_PRINT) >> np.uint64(32)).astype(np.uint32)
        asked = np.flatnonzero((at >= 0) & (self.prints[np.maximum(at, 0)] == prints))
        begin, n = self.runs[at[asked]].astype(np.int64), np.diff(self.runs.astype(np.int64))[at[asked]]
        return np.repeat(asked, n), np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Shard:
    """Reads a shard's documents; only the parts of the file that are asked for."""

    def __init__(self, folder: str, number: int) -> None:
        fs, path = file_system(folder)
        self.file = fs.open_input_file(f"{path}/shard-{number:08d}")
        magic, self.width, self.n, self.ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        at = _HEAD.size + self.ids * self.width
        self.starts = np.frombuffer(self.file.read_at(8 * (self.n + 1), at), "<u8").astype(np.int64)
        keys = self.file.read_at(9 * self.n, at + 8 * (self.n + 1))
        self.keys, self.null = np.frombuffer(keys, "<i8", self.n), np.frombuffer(keys, np.uint8, self.n, 8 * self.n).astype(bool)

    def documents(self, first: int, n: int) -> list[np.ndarray]:
        """The ids of n documents that follow each other, as u32."""
        a, b = self.starts[first], self.starts[first + n]
        raw = self.file.read_at(int(b - a) * self.width, _HEAD.size + int(a) * self.width)
        ids = np.frombuffer(raw, f"<u{self.width}").astype("<u4")
        return np.split(ids, self.starts[first + 1 : first + n] - a)


@tidy
def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by doc_id become one shard; returns a row per run of equal doc_ids, with the shard's totals."""
    number = TaskContext.get().partitionId()
    encode = encoder(path)
    width = 2 if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 2**16 else 4
    kind = f"<u{width}"
    keys, null, sizes, payload = [], [], [], []
    for batch in batches:
        ids = batch.column(0)
        null.append(np.asarray(ids.is_null()))
        keys.append(np.asarray(ids.fill_null(0)))
        for _, some, bounds in encode.encode(batch.column(1)):
            n = np.diff(bounds)
            payload.append(np.insert(some.astype(kind), bounds[1:], np.array(end_id, kind)))
            sizes.append(n + 1)
    if not keys:
        return
    keys, null, sizes = (np.concatenate(x) for x in (keys, null, sizes))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    head = _HEAD.pack(MAGIC, width, len(keys), int(starts[-1]))
    put_file(folder, f"shard-{number:08d}", [head, *payload, starts.astype("<u8").tobytes(), keys.astype("<i8").tobytes(), null.astype(np.uint8).tobytes()])
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    n = len(first)
    columns = [pa.array(keys[first], mask=null[first]), pa.array(np.full(n, number, np.int32)), pa.array(first.astype(np.int32)), pa.array(np.diff(np.append(first, len(keys))).astype(np.int32)), pa.array(np.full(n, starts[-1]))]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "first", "count", "shard_ids"])


def _index(key, table: pa.Table, folder: str) -> pa.Table:
    ids = table.column("doc_id").combine_chunks()
    col = lambda c: table.column(c).to_numpy()
    null = np.asarray(ids.is_null())
    part = Part.of(np.asarray(ids.fill_null(0)), null, col("shard"), col("first"), col("count"))
    put_file(folder, f"part-{key[0].as_py():08d}", part.bytes())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([len(ids)], pa.int64())})


def _look_up(key, table: pa.Table, folder: str) -> pa.Table:
    ids = table.column("doc_id").combine_chunks()
    keys, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    part = Part.read(folder, key[0].as_py())
    which, run = part.find(keys, null) if part is not None else (np.zeros(0, np.int64),) * 2
    col = lambda x: pa.array(x[run].astype(np.int32)) if part is not None else pa.array([], pa.int32())
    return pa.table({"doc_id": ids.take(pa.array(which)), "shard": col(part.shard if part else run), "first": col(part.first if part else run), "count": col(part.count if part else run)})


@tidy
def _fetch(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Documents of rows (doc_id, shard, first, count), sorted by shard and place, straight from the shards."""
    shard, number = None, -1
    for batch in batches:
        doc_id, rows, start, ids = batch.column("doc_id"), [], [], []
        for k, (s, first, n, before) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "count", "before")), strict=True)):
            if s != number:
                shard, number = Shard(folder, s), s
            # One foreign key in 2**32 has a stored fingerprint: the key itself, beside the ids, has the last word.
            if shard.null[first] != (not doc_id[k].is_valid) or (not shard.null[first] and shard.keys[first] != doc_id[k].as_py()):
                continue
            for x, got in enumerate(shard.documents(first, n)):
                rows.append(k)
                start.append(before + int(shard.starts[first + x]))
                ids.append(got.tobytes())
            if len(ids) >= 2000:
                yield _rows(batch, rows, start, ids)
                rows, start, ids = [], [], []
        if rows:
            yield _rows(batch, rows, start, ids)


def _rows(batch, rows, start, ids) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("shard").take(at), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "shard", "start", "ids"])


@dataclass
class Store:
    """Shards and index in `folder`, with the ids before each shard."""

    folder: str
    n_parts: int
    manifest: DataFrame
    keys: DataFrame
    n_ids: int

    def part_of(self, column: str = "doc_id"):
        x = F.coalesce(F.xxhash64(F.col(column)), F.lit(0))
        return F.pmod(x, F.lit(self.n_parts)).cast("int")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, start, ids) of the documents with these doc_ids; ids: little-endian u32, bytes.

        keys: a column doc_id; a key that is asked for twice is answered twice. A key that no document has gives no row,
        even if its fingerprint is that of a stored one. start: ids before the document.
        """
        folder = self.folder
        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("part", self.part_of())
        places = asked.groupBy("part").applyInArrow(lambda key, t: _look_up(key, t, folder), "doc_id long, shard int, first int, count int")
        # A shard's documents are read in their order; ranges of places, not shards, are dealt out, to as many tasks as
        # the stored ids ask for.
        places = places.join(self.manifest, "shard").withColumn("run", F.floor(F.col("first") / 1024))
        places = places.repartition(ways(self.n_ids, 4_000_000), "shard", "run").sortWithinPartitions("shard", "first").drop("run")
        return places.mapInArrow(partial(_fetch, folder=folder), "doc_id long, shard int, start long, ids binary")


def stored(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shard_chars: int = 16_000_000, part_keys: int = 200_000) -> Store:
    """Encode all texts (null: empty), each with end_id after it, into shards in ascending doc_id order, and index them.

    Null doc_ids come first and are one key. Rows with the same doc_id follow each other, ordered by text, under one
    key. An empty table gives no shards, and look-ups give no rows. Texts of any length are encoded block by block, one
    that holds an added token's string whole. Columns other than doc_id and text are not used.
    """
    spark: SparkSession = docs.sparkSession
    folder = fresh_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = ways(total_chars(rows), shard_chars)
    # The hash splits a doc_id that many rows share; equal ids stay next to each other over the shards' bounds.
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    runs = written(dealt.mapInArrow(partial(_write, path=tokenizer_path(tokenizer), end_id=end_id, folder=folder), "doc_id long, shard int, first int, count int, shard_ids long"), "id-runs")
    totals = runs.groupBy("shard").agg(F.first("shard_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    manifest = written(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "manifest")
    keys = runs.select("doc_id").distinct()
    size = runs.agg(F.count("*").alias("runs")).first()["runs"]
    store = Store(folder, ways(size, part_keys, least=8), manifest, keys, totals.agg(F.sum("n").alias("n")).first()["n"] or 0)
    placed = runs.withColumn("part", store.part_of())
    written(placed.groupBy("part").applyInArrow(lambda key, t: _index(key, t, folder), "part long, keys long"), "index-parts")
    return store
