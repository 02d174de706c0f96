"""Operator 9: media columns. Netpbm and BMP decoding, area resize, NPY tiles, difference hashes.

Images are numpy arrays of shape (height, width, channels), 8-bit. ``decode``
reads PBM/PGM/PPM (plain and raw, up to 16 bits a sample, scaled to 8) and
uncompressed BMP (1, 4, 8, 24, 32 bits). ``area_resize`` averages exact areas
by integral images, a strip of rows at a time. Tiles are NPY files; difference
hashes have 64 bits.

A text column is treated as a byte payload: UTF-8, padded with bytes 255 to a
positive multiple of 576, stored as a grey PGM of 24 columns (24 x 24 pixels a
block of 576), read back by the decoder, and hashed. Null is an empty payload.
Unreadable images give null features in ``describe``. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.llm.common import map_rows, rows_of, tidied, utf8

BLOCK, SIDE, PAD = 576, 24, b"\xff"
#: Rows of a picture that are summed at once.
STRIP = 1 << 14
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*)*(\d+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at = data[:2], 2
    header = []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("netpbm header")
        header.append(int(m[1]))
        at = m.end()
    width, height, top = (*header, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not (0 < top < 65536 and width > 0 and height > 0):
        raise ValueError("netpbm size")
    count = width * height * channels
    if kind == b"P4":
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        return (1 - np.unpackbits(packed, axis=1)[:, :width, None]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    elif kind == b"P1":
        digits = re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:count]
        if digits.strip(b"01"):
            raise ValueError("netpbm samples")
        flat = 1 - (np.frombuffer(digits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:count], np.int64)
    else:
        raise ValueError("not netpbm")
    if flat.size and (flat.min() < 0 or flat.max() > top):
        raise ValueError("netpbm samples")
    flat = flat.reshape(height, width, channels)
    return flat if flat.dtype == np.uint8 and top == 255 else ((flat.astype(np.int64) * 255 * 2 + top) // (2 * top)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    offset, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if data[:2] != b"BM" or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("bmp")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        picked = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)
        out = palette[picked[:, :width]]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _bounds(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(parts + 1) * (size / parts)
    low = np.minimum(edges.astype(np.int64), size)
    return low, edges - low


def _integral_rows(pixels: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The integral image's rows ``edges`` (sorted, 0 to height), STRIP rows of the picture at a time."""
    out = np.zeros((len(edges), pixels.shape[1] + 1, pixels.shape[2]))
    total = np.zeros(out.shape[1:])
    for at in range(0, pixels.shape[0], STRIP):
        sums = np.cumsum(np.cumsum(pixels[at : at + STRIP], 0, dtype=np.float64), 1)
        first, last = np.searchsorted(edges, (at + 1, at + len(sums) + 1))
        out[first:last] = total
        out[first:last, 1:] += sums[edges[first:last] - at - 1]
        total[1:] += sums[-1]
    return out


def area_resize(pixels: np.ndarray, *sizes: tuple[int, int]) -> list[np.ndarray]:
    """For each (height, width) the mean of each target pixel's exact source area, by an integral image with linear interpolation at its edges."""
    bounds = [_bounds(pixels.shape[0], height) for height, _ in sizes]
    edges = np.unique(np.concatenate([np.minimum(low + d, pixels.shape[0]) for low, _ in bounds for d in (0, 1)]))
    sums, out = _integral_rows(pixels, edges), []
    for (low, part), (height, width) in zip(bounds, sizes, strict=True):
        above, below = sums[np.searchsorted(edges, low)], sums[np.searchsorted(edges, np.minimum(low + 1, pixels.shape[0]))]
        rows = above * (1 - part)[:, None, None] + below * part[:, None, None]
        low, part = _bounds(pixels.shape[1], width)
        both = rows[:, low] * (1 - part)[None, :, None] + rows[:, np.minimum(low + 1, pixels.shape[1])] * part[None, :, None]
        area = pixels.shape[0] * pixels.shape[1] / (height * width)
        out.append(np.clip(np.rint((both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) / area), 0, 255).astype(np.uint8))
    return out


def features(pixels: np.ndarray, side: int = SIDE) -> tuple[bytes, str]:
    """The NPY tile, and 64 bits in hex, one for each pair of neighbours of an 8 x 9 grey thumbnail: one integral image for both."""
    tile, small = area_resize(pixels, (side, side), (8, 9))
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    grey = small.astype(np.int64).sum(2)
    return out.getvalue(), np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = utf8(text)
    return data + PAD * (-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def media_row(key: int | None, text: str | None) -> tuple:
    payload, n = payload_of(text)
    stored = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, SIDE))
    pixels = decode(stored)
    back = pixels.tobytes()
    tile, feature = features(pixels)
    return key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tile


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the digests of its payload as read back and of the stored image, its difference hash and its NPY tile."""
    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"
    return map_rows(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), media_row, ddl)


def describe(media: DataFrame, id_col: str = "id", data_col: str = "data", side: int = SIDE) -> DataFrame:
    """id, height, width, channels, tile (NPY bytes), dhash of images in a binary column; nulls where unreadable."""
    schema = pa.schema([("id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("channels", pa.int64()), ("tile", pa.binary()), ("dhash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data in rows_of(batches):
            try:
                pixels = decode(data or b"")
                found = (*pixels.shape, *features(pixels, side))
            except (ValueError, struct.error, IndexError, OverflowError):
                found = (None,) * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((key, *found), schema, strict=True)], schema=schema)

    return media.select(F.col(id_col).cast("bigint"), F.col(data_col)).mapInArrow(tidied(run), "id bigint, height bigint, width bigint, channels bigint, tile binary, dhash string")
