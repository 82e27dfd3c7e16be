"""Merkle fixity audit of WARC replicas.

A replica is a folder of WARC/1.1 files, a gzip member for each record. `replica` writes one from pages, where they are:
a task writes its own rows as they come, in files of at most RECORDS records and about OCTETS bytes, so no payload is
shuffled and no key, however common, makes a file or a task larger.

`trees` reads the files of a replica and walks them record by record, by their bytes alone. Where a member can't be read
to its end, the walk goes on at the next place where one begins; the record keeps its id if that much can be read. Over
each file stand two trees, of fan-out 16:

* content: leaves are records, by their id, with the SHA-256 of their stored bytes; they hang at the hexadecimal digits
  of the hash of the id, so a record that is lost, added or of another length touches its own branch only;
* order: leaves are the byte ranges, by their number in the file, with the id of the record that is there.

`compared` holds the roots of two replicas against each other and goes down where they differ, children of differing
nodes only. Content leaves that part are damaged, missing or extra records; order leaves that part show the records that
are whole but in another place (moved). A file that only one replica has parts in every record of it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_path, put_file, ways, written

#: Levels below the root of both trees; a file has up to 16**DEPTH records.
DEPTH = 4
RECORDS = 16**DEPTH
OCTETS = 64_000_000
#: Pages have no date of their own.
DATE = "2000-01-01T00:00:00Z"

_NOT_IN_URI = re.compile(r"[\x00-\x20\x7f]")
_RECORD_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>\r\n")
_MAGIC = b"\x1f\x8b\x08"


def record_id(name: str) -> str:
    h = hashlib.sha256(name.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def record(id_: str, url: str, html: str) -> bytes:
    """A page as a response record, its HTTP head included."""
    body = html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = _NOT_IN_URI.sub(lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{id_}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


_WRITTEN = "page_id long, record_id string, file string, octets long, record_sha256 string"


def _write(batches: Iterator[pa.RecordBatch], folder: str, records: int, octets: int) -> Iterator[pa.RecordBatch]:
    number, files = TaskContext.get().partitionId(), 0
    parts, rows, size, seen = [], [], 0, {}

    def closed() -> pa.RecordBatch:
        nonlocal files, size
        name = f"pages-{number:08d}-{files:06d}.warc.gz"
        put_file(folder, name, parts)
        files += 1
        out = pa.RecordBatch.from_pylist([{"page_id": p, "record_id": i, "file": name, "octets": n, "record_sha256": h} for p, i, n, h in rows], pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("octets", pa.int64()), ("record_sha256", pa.string())]))
        parts.clear()
        rows.clear()
        seen.clear()
        size = 0
        return out

    for batch in batches:
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = f"{'' if page is None else page}|{url}"
            seen[name] = seen.get(name, -1) + 1  # the same page again in a file is a record of its own
            id_ = record_id(f"{name}|{seen[name]}")
            raw = record(id_, url, html)
            parts.append(member(raw))
            size += len(parts[-1])
            rows.append((page, id_, len(raw), hashlib.sha256(raw).hexdigest()))
            if len(rows) >= records or size >= octets:
                yield closed()
    if rows:
        yield closed()


def replica(pages: DataFrame, records: int = RECORDS, octets: int = OCTETS) -> tuple[str, DataFrame]:
    """(folder, what was written: page_id, record_id, file, octets of the record, their SHA-256).

    Null page_id, url and html are empty; repeated rows are records of their own. A page of any length is one record. An
    empty table gives no files. Columns other than page_id, url and html are not used.
    """
    if records > RECORDS:
        raise ValueError(f"a file has at most {RECORDS} records")
    folder = fresh_path(pages.sparkSession, "replica")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return folder, written(rows.mapInArrow(partial(_write, folder=folder, records=records, octets=octets), _WRITTEN), "manifest", {"compression": "zstd"})


def walked(raw: bytes) -> Iterator[tuple[str | None, int, int, bytes]]:
    """(id, first byte, end, what could be unpacked) of each record of a file."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        out, end = _unpacked(view, at, 1 << 16)
        if end is None:
            out, _ = _unpacked(view, at, 16)  # by small steps, to see as much as there is
            end = raw.find(_MAGIC, at + 1)
            while end >= 0 and not _unpacked(view, end, 256, 4096)[0].startswith(b"WARC/"):
                end = raw.find(_MAGIC, end + 1)
            end = len(raw) if end < 0 else end
        found = _RECORD_ID.search(out, 0, 4096)
        yield found[1].decode() if found else None, at, end, out
        at = end


def _unpacked(view: memoryview, at: int, step: int, most: int | None = None) -> tuple[bytes, int | None]:
    """What a member holds, and its end; no end if it breaks off. `most`: bytes to look at."""
    d, out, p = zlib.decompressobj(31), [], at
    stop = len(view) if most is None else min(len(view), at + most)
    try:
        while p < stop and not d.eof:
            out.append(d.decompress(view[p : p + step]))
            p += step
        if d.eof:
            return b"".join(out), min(p, len(view)) - len(d.unused_data)
    except zlib.error:
        pass
    return b"".join(out), None


_NODES = "file string, tree string, level int, node string, parent string, hash string, record_id string, first long, end long"


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _trees(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(folder)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                raw = f.read()
            yield from _file_trees(name, raw).to_batches()


def _file_trees(name: str, raw: bytes) -> pa.Table:
    rows, seen = {"content": [], "order": []}, {}
    for k, (id_, first, end, _) in enumerate(walked(raw)):
        id_ = id_ or f"unreadable at {first}"
        seen[id_] = seen.get(id_, -1) + 1
        key = id_ if not seen[id_] else f"{id_} again {seen[id_]}"
        slot = hashlib.sha256(id_.encode()).hexdigest()[: DEPTH - 1]
        place = f"{k:0{DEPTH}x}"
        rows["content"].append((f"{slot}/{key}", slot, hashlib.sha256(memoryview(raw)[first:end]).hexdigest(), key, first, end))
        rows["order"].append((place, place[:-1], _hash([key, str(first), str(end)]), key, first, end))
    out = []
    for tree, leaves in rows.items():
        level = leaves
        for depth in range(DEPTH, -1, -1):
            out += [(name, tree, depth, *x) for x in level]
            below: dict[str, list] = {}
            for node, parent, hash_, _, first, end in level:
                below.setdefault(parent, []).append((node, hash_, first, end))
            level = [(node, node[:-1], _hash([f"{n} {h} {a} {b}" if tree == "order" else f"{n} {h}" for n, h, a, b in sorted(kids)]), None, min(x[2] for x in kids), max(x[3] for x in kids)) for node, kids in below.items()]
    columns = list(zip(*out, strict=True)) if out else [()] * 9
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _NODES.split(", ")])


def trees(folder: str, files: DataFrame) -> DataFrame:
    """All nodes of the trees over a replica's files (column file), one task for a few files, written."""
    names = files.select("file").distinct()
    n = ways(names.count(), 4, least=1)
    return written(names.repartition(n, "file").mapInArrow(partial(_trees, folder=folder), _NODES), "tree", {"compression": "zstd"})


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves at which two replicas' trees part: file, tree, node and each side's hash, record_id, first and end.

    Goes down from the roots, over children of differing nodes only; a side without a leaf has nulls.
    """
    keys, bad = ["file", "tree", "node"], None
    for level in range(DEPTH + 1):
        x, y = (t.filter(F.col("level") == level).select(*keys, "parent", *(F.col(c).alias(f"{n}_{c}") for c in ("hash", "record_id", "first", "end"))) for n, t in (("a", a), ("b", b)))
        if bad is not None:
            below = bad.select("file", "tree", F.col("node").alias("parent"))
            x, y = (t.join(below, ["file", "tree", "parent"], "left_semi") for t in (x, y))
        both = x.drop("parent").join(y.drop("parent"), keys, "full_outer")
        bad = written(both.filter(~F.col("a_hash").eqNullSafe(F.col("b_hash"))), "parted")
    return bad


def audited(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of the first replica's trees, and those that only the second has: file, record_id, first and end in
    the first, b_first and b_end in the second, fate (intact, moved, damaged, missing, extra). Records that are whole but
    elsewhere in their file are moved. A record that can't be read to its id goes by its place. Two empty replicas give no rows."""
    parted = compared(a, b)
    content = parted.filter("tree = 'content'")
    fate = F.when(F.col("a_hash").isNull(), "extra").when(F.col("b_hash").isNull(), "missing").otherwise("damaged")
    content = content.select("file", F.coalesce("a_record_id", "b_record_id").alias("record_id"), fate.alias("fate"), "a_first", "a_end", "b_first", "b_end")
    order = parted.filter("tree = 'order'")
    here, there = (order.filter(f"{n}_hash is not null").select("file", F.col(f"{n}_record_id").alias("record_id"), F.col(f"{n}_first").alias(f"o{n}_first"), F.col(f"{n}_end").alias(f"o{n}_end")) for n in "ab")
    moved = here.join(there, ["file", "record_id"]).filter("oa_first <> ob_first").drop("oa_first", "oa_end")
    own = a.filter(f"tree = 'content' and level = {DEPTH}").select("file", "record_id", "first", "end")
    bad = content.filter("fate <> 'extra'").select("file", "record_id", "fate", "b_first", "b_end")
    told = own.join(bad, ["file", "record_id"], "left").join(moved, ["file", "record_id"], "left")
    whole = F.when(F.col("ob_first").isNotNull(), "moved").otherwise("intact")
    same = lambda c: F.when(F.col("fate").isNotNull(), F.col(f"b_{c}")).otherwise(F.coalesce(f"ob_{c}", c)).alias(f"b_{c}")
    told = told.select("file", "record_id", "first", "end", same("first"), same("end"), F.coalesce("fate", whole).alias("fate"))
    more = content.filter("fate = 'extra'").select("file", "record_id", F.col("a_first").alias("first"), F.col("a_end").alias("end"), "b_first", "b_end", "fate")
    return told.unionByName(more)


def hurt(raw: bytes, one_in: int) -> bytes:
    """A file with some records hurt, by the first four digits of their ids modulo one_in: 0, a byte turned over; 1, left
    out; 2, a byte more; 3, another record after it."""
    out = []
    for id_, first, end, _ in walked(raw):
        own = raw[first:end]
        kind = int(id_[:4], 16) % one_in if id_ else -1
        at = len(own) * 7 // 8
        if kind == 0:
            own = own[:at] + bytes([own[at] ^ 0x55]) + own[at + 1 :]
        elif kind == 1:
            own = b""
        elif kind == 2:
            own = own[:at] + b"#" + own[at:]
        elif kind == 3:
            own += member(record(record_id(f"extra|{id_}"), "", ""))
        out.append(own)
    return b"".join(out)


def _hurt_files(batches: Iterator[pa.RecordBatch], folder: str, to: str, one_in: int) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(folder)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                put_file(to, name, [hurt(f.read(), one_in)])
        yield batch


def damaged(folder: str, files: DataFrame, one_in: int = 97) -> tuple[str, DataFrame]:
    """A second replica, with some records of every file hurt (see `hurt`): folder and files."""
    to = fresh_path(files.sparkSession, "replica")
    names = files.select("file").distinct()
    n = ways(names.count(), 4, least=1)
    return to, written(names.repartition(n, "file").mapInArrow(partial(_hurt_files, folder=folder, to=to, one_in=one_in), "file string"), "files")
