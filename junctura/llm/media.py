"""Texts as PNG images in binary columns: encoding, checked decoding, low-frequency cosine hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
PIECE = 1 << 16
SIDE, LOW = 32, 8
_k = np.arange(LOW)[:, None]
COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * _k / (2 * SIDE))


def pad(data: bytes) -> bytes:
    """Bytes 32 are added up to a positive multiple of a row of 192."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes, level: int = 6) -> bytes:
    """An RGB image 64 pixels wide, of one row for each 192 bytes; the filter is the one of none, left, above with least residuals."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    left = np.zeros_like(rows)
    left[:, CHANNELS:] = rows[:, :-CHANNELS]
    tried = (rows, rows - left, rows - above)
    kind = min(range(3), key=lambda k: int(np.abs(tried[k].view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind]
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *(chunk(b"IDAT", packed[i : i + PIECE]) for i in range(0, len(packed), PIECE)), chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Bytes of the image from filtered lines (first column: the filter). Runs of lines of one filter are undone together."""
    kinds, data = lines[:, 0], lines[:, 1:]
    out = np.empty_like(data)
    width = data.shape[1]
    ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, len(kinds))
    start = 0
    for end in ends.tolist():
        kind, part = int(kinds[start]), data[start:end]
        above = out[start - 1] if start else np.zeros(width, np.uint8)
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            out[start:end] = np.cumsum(part.reshape(end - start, -1, bpp), axis=1, dtype=np.uint8).reshape(end - start, width)
        elif kind == 2:
            out[start:end] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for r in range(start, end):
                up = (out[r - 1] if r else np.zeros(width, np.uint8)).astype(np.int32)
                a, c = np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
                for x in range(0, width, bpp):
                    b = up[x : x + bpp]
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        p = a + b - c
                        pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                    a = (data[r, x : x + bpp].astype(np.int32) + guess) & 255
                    out[r, x : x + bpp] = a
                    c = b
        else:
            raise ValueError(f"unknown filter {kind}")
        start = end
    return out


def decode(media: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of an 8-bit grey or RGB image that isn't interlaced. ValueError where a checksum or the structure is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if depth != 8 or colour not in (0, 2) or interlaced:
                raise ValueError("only 8-bit grey or RGB images that aren't interlaced")
            shape = (h, w, 3 if colour == 2 else 1)
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if shape is None or not ended:
        raise ValueError("a chunk is missing")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    h, w, c = shape
    if raw.size != h * (w * c + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(h, w * c + 1), c).reshape(shape)


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the grey image, averaged to 32 x 32, are above their median."""
    grey = pixels.sum(axis=2, dtype=np.float32)
    for axis in (0, 1):
        n = grey.shape[axis]
        at = np.arange(SIDE) * n // SIDE
        if n < SIDE:
            grey = np.take(grey, at, axis=axis)
        else:
            sums = np.add.reduceat(grey, at, axis=axis)
            counts = np.diff(np.append(at, n)).astype(np.float32)
            grey = sums / (counts[:, None] if axis == 0 else counts)
    low = COSINES @ grey @ COSINES.T
    low[0, 0] = 0
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


SCHEMA = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a PNG, read back from the stored bytes, and hashed.

    The text's UTF-8 bytes are padded with spaces to rows of 192 and stored losslessly as 8-bit RGB samples. The stored
    bytes are parsed again, every chunk's checksum is tested, and `payload` is what was read back. Null and empty texts
    give one row of spaces. Equal texts give equal columns; null and repeated keys are kept as they are; other columns
    are ignored; an empty table gives no rows. Work is by row: no shuffle, memory bounded by a few texts.
    Returns key, n_bytes, payload (binary), media (binary), feature (16 hex digits).
    """

    def store(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in found:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = data.as_py()
                    media = encode(pad(data))
                    pixels = decode(media)
                    payload = pixels.tobytes()
                    yield len(payload) + len(media), (k, len(data), payload, media, cosine_hash(pixels))

        yield from batches(rows(), SCHEMA)

    made = docs.select(F.col(key).cast("long").alias("key"), utf8(text).alias("data")).mapInArrow(store, "key long, n_bytes long, payload binary, media binary, feature string")
    return made.withColumnRenamed("key", key)
