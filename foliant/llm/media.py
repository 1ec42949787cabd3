"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays, area-resized, hashed and tiled.

The decoders read P2, P3, P5 and P6 with 8-bit samples and uncompressed BMP of 24 bits; the resize takes means over
areas from integral images; a tile is written as NPY, with a difference hash of 64 bits beside it.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: 64 pixels of three 8-bit samples: a row of the images that carry payloads; also a multiple of BMP's four bytes.
ROW_BYTES = 192
TILE = 16
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
_HEADER = re.compile(rb"P([2356])((?:\s|#[^\n]*\n)+)(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if pixels.ndim == 3 else 5, width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits, rows from the bottom up, blue first, rows padded to four bytes."""
    height, width = pixels.shape[:2]
    rows = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    rows = np.pad(rows, ((0, 0), (0, -3 * width % 4)))
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x samples of uint8; ValueError for what the formats above don't cover."""
    if data[:2] == b"BM" and len(data) >= 54:
        at, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
        line = (3 * width + 3) // 4 * 4
        if bits != 24 or packed or width <= 0 or len(data) < at + line * abs(height):
            raise ValueError("not an uncompressed BMP of 24 bits")
        rows = np.frombuffer(data, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
        return rows[::-1] if height > 0 else rows
    if not (head := _HEADER.match(data)):
        raise ValueError("neither Netpbm nor BMP")
    kind, width, height, most = int(head[1]), int(head[3]), int(head[4]), int(head[5])
    samples = 3 if kind in (3, 6) else 1
    if not 0 < most < 256:
        raise ValueError("samples of more than 8 bits")
    if kind > 3:
        flat = np.frombuffer(data, np.uint8, width * height * samples, head.end())
    else:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[head.end() :]).split()[: width * height * samples], np.int64).astype(np.uint8)
    return flat.reshape(height, width, samples)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by an integral image that is read between its points linearly (exact for areas)."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, pixels.shape[2]))
    np.cumsum(np.cumsum(pixels, 0, dtype=np.float64), 1, out=sums[1:, 1:])

    def along(table: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((len(table) - 1) / n)
        low = np.minimum(at.astype(int), len(table) - 2)
        part = (at - low).reshape(-1, 1, 1)
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    area = along(along(sums, height).swapaxes(0, 1), width).swapaxes(0, 1)
    return area * (height * width / (pixels.shape[0] * pixels.shape[1]))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: is each of 8 x 8 areas darker than its right neighbour?"""
    grey = area_resize(pixels, 8, 9).mean(axis=2)
    bits = np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with spaces to a positive multiple of 192 bytes, as an image
    64 pixels wide; an even number of rows is stored as PPM, an odd one as BMP."""

    def store(batches):
        for b in batches:
            sizes, stored = [], []
            for x in b.column(1):
                data = x.as_py().encode()
                padded = data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES)
                pixels = np.frombuffer(padded, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
                sizes.append(len(data))
                stored.append(encode_bmp(pixels) if len(pixels) % 2 else encode_ppm(pixels))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(store, STORED)


def media_features(media: DataFrame) -> DataFrame:
    """Decodes the stored bytes of doc_id, n_bytes, media and computes digests of the samples and of the stored form,
    `feature` (the difference hash, 16 hex digits) and `tile` (NPY). Null media gives nulls; other columns are ignored."""

    def read(batches):
        for b in batches:
            rows = []
            for x in b.column(2):
                data = x.as_py()
                if data is None:
                    rows.append((None,) * 7)
                    continue
                pixels = decode(data)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{difference_hash(pixels):016x}", npy_tile(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(read, FEATURES)
