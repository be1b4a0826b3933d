"""Media columns: lossless PNG in binary columns, read back, checked and hashed.

`encode_media` stores bytes as an 8-bit grey PNG of 24 columns; `media_features` parses such
(and any other 8-bit grey, non-interlaced) PNG: chunk by chunk with checksum tests, inflating the
zlib stream, undoing the row filters in numpy, then hashing the low frequencies of a cosine
transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents, sub_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE = 24
TILE = SIDE * SIDE
PAD = b"\xff"
IDAT_BYTES = 1 << 16
LOW = 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """`data` and bytes 255 up to a positive multiple of 576."""
    return data + PAD * (-len(data) % TILE or (0 if data else TILE))


def to_png(payload: bytes, width: int = SIDE, level: int = 4) -> bytes:
    """A grey PNG whose samples are the payload; each row has that of the filters none, sub and up that leaves the smallest amounts."""
    plain = np.frombuffer(payload, np.uint8).reshape(-1, width)
    forms = np.stack([plain] * 3)
    forms[1, :, 1:] -= plain[:, :-1]
    forms[2, 1:] -= plain[:-1]
    kinds = np.abs(forms.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    rows = np.empty((len(plain), width + 1), np.uint8)
    rows[:, 0] = kinds
    rows[:, 1:] = np.take_along_axis(forms, kinds[None, :, None], 0)[0]
    packed = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters for one byte a pixel."""
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise ValueError("PNG: unknown row filter")
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    mixed = kinds > 2
    edges = np.r_[0, np.flatnonzero(mixed[1:] != mixed[:-1]) + 1, len(kinds)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        above = out[lo - 1] if lo else np.zeros(rows.shape[1], np.uint8)
        if mixed[lo]:
            out[lo:hi] = _waves(kinds[lo:hi], rows[lo:hi], above)
            continue
        # rows that add to the one above them: sums down to here, without what stands above the last other row
        up = kinds[lo:hi] == 2
        if up[0]:
            out[lo] += above
            up = np.r_[False, up[1:]]
        total = np.cumsum(out[lo:hi], axis=0, dtype=np.uint8)
        head = np.maximum.accumulate(np.where(up, 0, np.arange(hi - lo)))
        out[lo:hi] = total - np.where(head[:, None] > 0, total[head - 1], 0).astype(np.uint8)
    return out


def _waves(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Undo average (3) and Paeth (4) filters: all pixels of a diagonal at once, for they need the left, upper and upper left ones."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int16)
    out[0, 1:] = above
    for t in range(height + width - 1):
        i = np.arange(max(0, t - width + 1), min(height, t + 1))
        j = t - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[i + 1, j + 1] = (rows[i, j] + np.where(kinds[i] == 3, (left + up) // 2, paeth)) & 255
    return out[1:, 1:].astype(np.uint8)


def from_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG as rows; ValueError if a part is damaged, missing or unsupported."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: wrong signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("PNG: a chunk's checksum differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not a whole 8-bit grey image without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))  # tests the stream's Adler-32
    except zlib.error as e:
        raise ValueError(f"PNG: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("PNG: wrong amount of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _cosine(n: int, m: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(m)[:, None])


_DCT = _cosine(SIDE, LOW)


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n groups of rows as even as can be; few rows are repeated."""
    if len(a) < n:
        return a[np.arange(n) * len(a) // n].astype(float)
    edge = np.arange(n + 1) * len(a) // n
    return np.add.reduceat(a, edge[:-1], axis=0, dtype=np.float64) / np.diff(edge)[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits, hex: which of the 8 x 8 lowest frequencies of the 24 x 24 means lie above their median."""
    small = _shrink(_shrink(pixels, SIDE).T, SIDE).T
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_bytes, media (binary). A null or empty text makes a blank 24 x 24 image.

    A text of any length is one image, and equal texts make equal ones. Null and repeated ids keep their rows; an empty
    table gives an empty result. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 1)):
            data = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([to_png(pad(x)) for x in data], pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per row: the id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the
    columns of `encode_media` where `df` has them. A null media gives nulls; damaged media stop the job."""
    kind = df.schema[id_col].dataType.simpleString()
    extra = [c for c in ("n_bytes",) if c in df.columns]

    def row(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        pixels = from_png(media)
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 1)):
            cols = list(zip(*map(row, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *extra, *NAMES])

    return df.select(id_col, media_col, *extra).mapInArrow(run, f"`{id_col}` {kind}, {''.join(f'{c} long, ' for c in extra)}payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(read_documents(spark, sf_dir))).select("doc_id", "n_bytes", *NAMES)
