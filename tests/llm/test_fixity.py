"""The audit against what was done to a replica, and WARC files read back by their own rules."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from bramble.llm import common, fixity

R = random.Random(3)
PAGES = [(i, f"http://a.example/{i}", f"<p>{R.getrandbits(4000):x}</p>") for i in range(200)]
SCHEMA = "page_id long, url string, html string"


def _files(folder: str, names) -> dict[str, bytes]:
    fs, root = common.file_system(folder)
    out = {}
    for n in names:
        with fs.open_input_stream(f"{root}/{n}", compression=None) as f:
            out[n] = f.read()
    return out


@pytest.fixture(scope="module")
def one_file(spark):
    folder, held = fixity.replica(spark.createDataFrame(PAGES, SCHEMA).coalesce(1))
    (name,) = [r[0] for r in held.select("file").distinct().collect()]
    return folder, held, name, _files(folder, [name])[name], {r["record_id"]: r["page_id"] for r in held.collect()}


def _fates(spark, one_file, changed: bytes) -> dict:
    folder, held, name, _, pages = one_file
    other = common.fresh_path(spark, "changed")
    common.put_file(other, name, [changed])
    rows = fixity.audited(fixity.trees(folder, held), fixity.trees(other, held)).collect()
    assert len({r["record_id"] for r in rows}) == len(rows)
    return {pages.get(r["record_id"], r["record_id"]): r["fate"] for r in rows}


def _cuts(raw: bytes) -> list[tuple[int, int]]:
    return [(a, b) for _, a, b, _ in fixity.walked(raw)]


@pytest.mark.parametrize("what", ["same", "lost", "added", "longer", "flipped", "torn mark", "swapped"])
def test_exactly_the_hurt_record_is_told(spark, one_file, what):
    raw = one_file[3]
    a, b = _cuts(raw)[20]
    after = {k: "moved" for k in range(21, 200)}
    extra = fixity.record_id("one more")
    half = (a + b) // 2
    changed, wanted = {
        "same": (raw, {}),
        "lost": (raw[:a] + raw[b:], after | {20: "missing"}),
        "added": (raw[:a] + fixity.member(fixity.record(extra, "u", "x")) + raw[a:], after | {20: "moved", extra: "extra"}),
        "longer": (raw[:half] + b"#" + raw[half:], after | {20: "damaged"}),
        "flipped": (raw[:half] + bytes([raw[half] ^ 1]) + raw[half + 1 :], {20: "damaged"}),
        "torn mark": (raw[:a] + b"\x00" + raw[a + 1 :], {20: "missing", f"unreadable at {a}": "extra"}),
        "swapped": (raw[:a] + raw[b : _cuts(raw)[21][1]] + raw[a:b] + raw[_cuts(raw)[21][1] :], {20: "moved", 21: "moved"}),
    }[what]
    got = _fates(spark, one_file, changed)
    assert {k: v for k, v in got.items() if v != "intact"} == wanted and len(got) == 200 + (extra in wanted or what == "torn mark")


def test_nothing_below_equal_nodes_is_read(spark, one_file):
    folder, held, name, raw, _ = one_file
    a, b = _cuts(raw)[20]
    other = common.fresh_path(spark, "changed")
    common.put_file(other, name, [raw[: b - 1] + bytes([raw[b - 1] ^ 1]) + raw[b:]])
    parted = fixity.compared(fixity.trees(folder, held), fixity.trees(other, held)).collect()
    assert [(r["tree"], r["a_first"], r["a_end"]) for r in parted] == [("content", a, b)]


def test_files_are_legal_warc(spark, one_file):
    text = gzip.decompress(one_file[3])  # every member is whole
    n, at = 0, 0
    while at < len(text):
        head_end = text.index(b"\r\n\r\n", at)
        lines = text[at:head_end].split(b"\r\n")
        fields = dict(x.split(b": ", 1) for x in lines[1:])
        assert lines[0] == b"WARC/1.1" and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"WARC-Target-URI", b"Content-Length"} <= set(fields)
        assert re.fullmatch(rb"<urn:uuid:[0-9a-f-]{36}>", fields[b"WARC-Record-ID"])
        size = int(fields[b"Content-Length"])
        block = text[head_end + 4 : head_end + 4 + size]
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and block.split(b"\r\n\r\n", 1)[1].decode() == PAGES[n][2]
        assert text[head_end + 4 + size : head_end + 8 + size] == b"\r\n\r\n"
        at, n = head_end + 8 + size, n + 1
    assert n == 200


def test_edges(spark):
    """Nulls, equal rows, ids that are no ids, a page of 5 MB, clashing columns, empty tables; files cut by records."""
    rows = [(None, None, None), (7, "u 7\n", None), (7, "u 7\n", None), (8, "", ""), (9, "u", "é" * 2_500_000)]
    pages = spark.createDataFrame([(*r, "c", 1, "d") for r in rows * 3], f"{SCHEMA}, file string, octets long, record_id string")
    folder, held = fixity.replica(pages, records=4)
    assert held.count() == 15 and held.groupBy("file").count().agg(F.max("count")).first()[0] <= 4
    a = fixity.trees(folder, held)
    assert {r["fate"] for r in fixity.audited(a, a).collect()} == {"intact"} and fixity.audited(a, a).count() == 15
    other = common.fresh_path(spark, "gone")
    files = _files(folder, [r[0] for r in held.select("file").distinct().collect()])
    gone = sorted(files)[0]
    for n, raw in files.items():
        if n != gone:
            common.put_file(other, n, [raw])
    left = held.filter(F.col("file") != gone)
    got = fixity.audited(a, fixity.trees(other, left)).collect()
    assert {(r["file"] == gone) == (r["fate"] == "missing") for r in got} == {True} and len(got) == 15
    folder, held = fixity.replica(pages.limit(0))
    nothing = fixity.trees(folder, held)
    assert held.count() == 0 and fixity.audited(nothing, nothing).count() == 0
