"""Operator 3: media columns. Netpbm and BMP to arrays, area resizing, NPY tiles, difference hashes.

encode_text stores a text as an 8-bit colour picture 64 pixels wide, 192 bytes a row, without loss.
A resized pixel is the mean of the area it covers, fractions of pixels included, from one integral
image with linear interpolation between its points. Pictures that can't be read (cut off, with sizes
that the bytes can't hold, samples beyond their maximum, of a kind that is not read) have null
features and say why in the column error; a null picture has nulls only. Null text counts as empty:
one row of spaces. Texts of any length are one picture. Repeated rows are pictures of their own,
equal texts have equal ones. An empty table gives an empty one. Other columns stay, except those
named like a result.
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
from pyspark.sql import DataFrame, SparkSession

from .common import materialise, table

ROW = 192
TILE = 16


#: A number of a Netpbm header, behind space and comments; more digits than these hold no picture.
NUMBER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,9})(?!\d)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6: (height, width) for bitmaps and grey, (height, width, 3) for colour; bitmaps 0 (black) or 255."""
    if raw[:1] != b"P" or raw[1:2] not in b"123456" or len(raw) < 3:
        raise ValueError("not a Netpbm picture")
    kind, at, head = int(raw[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = NUMBER.match(raw, at)
        if not m:
            raise ValueError("the header is cut off or has no number where one belongs")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = *head[:2], head[2] if len(head) > 2 else 1
    if not 0 < most < 65536 or width < 1 or height < 1:
        raise ValueError("the header has impossible sizes")
    planes = 3 if kind in (3, 6) else 1
    n, row = width * height * planes, -(-width // 8)
    # before anything is reserved: the bytes that are left must be able to hold so many samples
    needed = {1: n, 2: n, 3: n, 4: row * height, 5: n, 6: n}[kind] * (2 if kind > 4 and most > 255 else 1)
    if len(raw) - at < needed:
        raise ValueError("the samples are cut off")
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", raw[at:]), np.uint8) - 48
    elif kind in (2, 3):
        body = re.sub(rb"#[^\n]*", b" ", raw[at:]).split()[:n]
        if any(len(x) > 9 or not x.isdigit() for x in body):
            raise ValueError("a sample is no number below the maximum")
        values = np.array(body, np.int64)
    elif kind == 4:
        values = np.unpackbits(np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(raw, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(values) < n:
        raise ValueError("the samples are cut off")
    values = values[:n]
    if int(values.max()) > most:
        raise ValueError("a sample is no number below the maximum")
    if kind in (1, 4):
        values = (1 - values) * 255
    out = values.astype(np.uint16 if most > 255 else np.uint8)
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed 8-bit (by palette), 24-bit and 32-bit pictures: (height, width, 3), red first."""
    if raw[:2] != b"BM" or len(raw) < 54:
        raise ValueError("not a BMP picture")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if packed or head < 40 or bits not in (8, 24, 32) or width < 1 or not height:
        raise ValueError("a kind of BMP that is not read")
    rows, row = abs(height), -(-width * bits // 32) * 4
    if start < 14 + head or len(raw) < start + row * rows:
        raise ValueError("the samples are cut off")
    got = np.frombuffer(raw, np.uint8, row * rows, start).reshape(rows, row)[:, : width * bits // 8]
    if bits == 8:
        count = min(256, (start - 14 - head) // 4)
        palette = np.zeros((256, 3), np.uint8)
        palette[:count] = np.frombuffer(raw, np.uint8, count * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        out = palette[got]
    else:
        out = got.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def encode_bmp(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    row = -(-width * 3 // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    return struct.pack("<2sI4xIIiiHHIIiiII", b"BM", 54 + body.size, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def integral(planes: np.ndarray) -> np.ndarray:
    """At [y, x] the sum of all samples above y and left of x, one row and one column more than the picture."""
    out = np.zeros((planes.shape[0] + 1, planes.shape[1] + 1, planes.shape[2]))
    np.cumsum(planes, 0, np.float64, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], 1, out=out[1:, 1:])
    return out


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal areas, as float64, with the planes of the input."""
    planes = pixels if pixels.ndim == 3 else pixels[:, :, None]
    total = integral(planes)

    def edges(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The point of the integral image before each edge, and how far the edge is beyond it."""
        edge = np.arange(size + 1) * (n / size)
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    (y, dy), (x, dx) = edges(planes.shape[0], height), edges(planes.shape[1], width)
    dy, dx = dy[:, None, None], dx[None, :, None]
    corner = lambda a, b: total[np.ix_(a, b)]
    at = (corner(y, x) * (1 - dx) + corner(y, x + 1) * dx) * (1 - dy) + (corner(y + 1, x) * (1 - dx) + corner(y + 1, x + 1) * dx) * dy
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    out = sums * (height * width / (planes.shape[0] * planes.shape[1]))
    return out if pixels.ndim == 3 else out[:, :, 0]


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(grey(resize(pixels, 8, 9)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(resize(pixels, size, size)).astype(np.uint8 if pixels.dtype == np.uint8 else np.uint16), allow_pickle=False)
    return out.getvalue()


def encode_text(text: str) -> tuple[int, bytes]:
    """The text's bytes before padding, and a picture that holds them and spaces up to whole rows."""
    raw = text.encode()
    padded = raw + b" " * (-len(raw) % ROW if raw else ROW)
    return len(raw), b"P6\n%d %d\n255\n" % (ROW // 3, len(padded) // ROW) + padded


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media), written to the shared folder and read back."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, media = zip(*(encode_text(t.as_py() or "") for t in b.column(1)), strict=True) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return materialise(docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, media binary"), "media")


FEATURES = {"height": pa.int64(), "width": pa.int64(), "planes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary(), "error": pa.string()}


def features(media: DataFrame, column: str = "media", tiles: bool = True) -> DataFrame:
    """media without the column and with what its pictures hold: sizes, checksums of the decoded
    samples (payload), the difference hash (feature), and the resized picture as NPY (tile).
    Other columns of media that have these names give way."""
    rest = [c for c in media.columns if c != column and c not in FEATURES]
    have = [c for c in FEATURES if tiles or c != "tile"]
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(have)
        base = {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()}
        try:
            p = decode(raw)
            payload = p.tobytes()
            base |= {"height": p.shape[0], "width": p.shape[1], "planes": 1 if p.ndim == 2 else p.shape[2], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": difference_hash(p)}
            base |= {"tile": npy_tile(p)} if tiles else {}
        except (ValueError, OverflowError, MemoryError, struct.error) as e:  # a picture that can't be read is a row, not a failed job
            base["error"] = str(e) or type(e).__name__
        return tuple(base.get(c) for c in have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x.as_py()) for x in b.column(column)]
            cols = [pa.array([g[i] for g in got], FEATURES[c]) for i, c in enumerate(have)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *cols], [*rest, *have])

    schema = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {kinds[FEATURES[c]]}" for c in have)])
    return media.mapInArrow(run, schema)


def op3_netpbm_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = features(store_texts(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
