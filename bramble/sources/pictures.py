"""Images as files: PNG and the portable maps (PGM, PPM), read and written with zlib and numpy alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type; fixed values.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decoded(raw: bytes) -> np.ndarray:
    """Height x width x 1 or 3 bytes; transparency is left out. Other formats are errors."""
    if raw.startswith(_PNG):
        return _png(raw)
    if raw[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _portable(raw)
    raise ValueError("neither a PNG nor a portable map")


def _png(raw: bytes) -> np.ndarray:
    at, data, palette, head = len(_PNG), [], None, None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or depth not in (8, 16):
        raise ValueError("an interlaced PNG, or one of less than 8 bits a sample")
    step = _SAMPLES[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.int32)  # a row above and a pixel to the left of zeros
    for y in range(height):
        line, kind = rows[y, 1:].reshape(width, step).astype(np.int32), rows[y, 0]
        own, up = out[y + 1], out[y]
        if kind == 0:
            own[1:] = line
        elif kind == 1:
            own[1:] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            own[1:] = (line + up[1:]) & 255
        else:
            for x in range(width):
                a, b, c = own[x], up[x + 1], up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                own[x + 1] = (line[x] + guess) & 255
    samples = out[1:, 1:].astype(np.uint8)[:, :, :: depth // 8]  # of 16 bits the upper 8
    if colour == 3:
        return palette[samples[:, :, 0]]
    return samples[:, :, : 3 if colour in (2, 6) else 1]


def _portable(raw: bytes) -> np.ndarray:
    words, at = [], 2
    while len(words) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        words.append(int(raw[at:end]))
        at = end
    width, height, most = words
    channels = 3 if raw[1:2] in b"36" else 1
    if raw[1:2] in b"23":
        values = np.array(raw[at:].split(), np.int64)
    else:
        values = np.frombuffer(raw[at + 1 :], ">u2" if most > 255 else np.uint8, width * height * channels).astype(np.int64)
    return (values.reshape(height, width, channels) * 255 // most).astype(np.uint8)


def as_png(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def as_portable(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    return f"P{6 if channels == 3 else 5}\n{width} {height}\n255\n".encode() + image.tobytes()


RASTERS = "image_id string, height int, width int, channels int, data binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        images = [decoded(x) for x in b.column("content").to_pylist()]
        sizes = [pa.array([i.shape[k] for i in images], pa.int32()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([b.column("image_id"), *sizes, pa.array([i.tobytes() for i in images], pa.binary())], ["image_id", "height", "width", "channels", "data"])


def rasters(files: DataFrame) -> DataFrame:
    """(image_id, height, width, channels, data: bytes row by row) of image files (image_id, content)."""
    return files.select("image_id", "content").mapInArrow(_decode, RASTERS)


def pixels(of: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of rasters: grey values, for three channels the rounded luma."""

    def grey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                h, w, c = (b.column(n)[k].as_py() for n in ("height", "width", "channels"))
                a = np.frombuffer(b.column("data")[k].as_buffer(), np.uint8).reshape(h, w, c)
                v = a[:, :, 0] if c == 1 else np.floor(a @ np.array([0.299, 0.587, 0.114]) + 0.5)
                y, x = np.divmod(np.arange(h * w), w)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("image_id")[k], h * w), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(v.ravel().astype(np.int32))], ["image_id", "y", "x", "v"])

    return of.mapInArrow(grey, "image_id string, y int, x int, v int")
