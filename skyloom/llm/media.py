"""Media columns: Netpbm and BMP images as bytes in a table.

``decode`` reads Netpbm (P1 to P6) and BMP (8, 24, 32 bits) bytes into numpy
arrays of 8-bit samples, ``resize`` shrinks or grows them by exact area means
from an integral image, ``npy_tile`` writes an array as NPY bytes and
``difference_hash`` gives 64 bits that compare neighbouring samples.
``media_columns`` applies all of it to a column of image bytes, and
``text_media`` stores texts as images and reads them back.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table

WIDTH = 64
#: Rows of an image whose integral is held at once.
BAND = 8192
_HEADER = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """Binary greyscale Netpbm (P5) of a height x width array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("not a Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        flat = 1 - np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8)[: width * height] % 2
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[: width * height * channels], np.int64)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width]
    elif kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", width * height * channels, at + 1)
    else:
        raise ValueError("not a Netpbm image")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8, copy=False).reshape((height, width, channels) if channels > 1 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, size, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("BMP kind not handled")
    if packed == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP masks not handled")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    lines = lines if height < 0 else lines[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[lines[:, :width]]
    return lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first, of a height x width x 3 array."""
    height, width, _ = samples.shape
    stride = (width * 24 + 31) // 32 * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0, lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width) or (height, width, 3) of Netpbm or BMP bytes; ValueError for anything else."""
    try:
        return _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    except (struct.error, IndexError) as e:
        raise ValueError(str(e)) from e


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma of a colour image; a grey one is returned as it is."""
    return image if image.ndim == 2 else ((image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grey image: each cell of the result averages the rectangle it covers, edges by their share.

    The integral image is built band by band and read only at the cells'
    borders, so memory does not grow with the image.
    """
    h, w = image.shape
    if not h or not w:
        return np.zeros((height, width), np.uint8)
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    need = np.unique(np.concatenate([np.floor(ys), np.minimum(np.floor(ys) + 1, h)]).astype(np.int64))
    rows = {0: np.zeros(w + 1, np.int64)}
    total = np.zeros(w, np.int64)
    for at in range(0, h, BAND):
        band = image[at : at + BAND]
        wanted = need[(need > at) & (need <= at + len(band))]
        sums = np.add.reduceat(band, np.concatenate([[0], wanted[wanted < at + len(band)] - at]), axis=0, dtype=np.int64) if len(wanted) else band.sum(axis=0, dtype=np.int64)[None]
        for y, part in zip(wanted.tolist(), sums, strict=False):
            total = total + part
            rows[y] = np.concatenate([[0], np.cumsum(total)])
        if len(sums) > len(wanted):
            total = total + sums[-1]
    integral = np.stack([rows[y] for y in sorted(rows)])
    index = {y: i for i, y in enumerate(sorted(rows))}

    def at_rows(v: float) -> np.ndarray:
        y = int(v)
        low = integral[index[y]]
        return low + (v - y) * (integral[index[min(y + 1, h)]] - low)

    x0 = np.minimum(xs.astype(np.int64), w)
    x1 = np.minimum(x0 + 1, w)
    lines = np.stack([at_rows(v) for v in ys])
    grid = lines[:, x0] + (xs - x0) * (lines[:, x1] - lines[:, x0])
    cells = np.diff(np.diff(grid, axis=0), axis=1) / ((h / height) * (w / width))
    return np.clip(np.rint(cells), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: bit 1 where a cell of the 8 x 9 area means is darker than its right neighbour."""
    small = resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    """The area-resized image as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, resize(image, height, width), allow_pickle=False)
    return out.getvalue()


def media_columns(df: DataFrame, key: str, data: str, height: int = 16, width: int = 16) -> DataFrame:
    """Rows (key, height, width, channels, tile binary, dhash) of a column of image bytes.

    Null bytes and bytes that are no image give nulls after the key; repeated
    keys give repeated rows, and columns other than the two named aren't read.
    """

    def make():
        def one(raw):
            if raw is None:
                return (None,) * 5
            try:
                image = decode(raw)
            except ValueError:
                return (None,) * 5
            flat = grey(image)
            return image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], npy_tile(flat, height, width), difference_hash(flat)

        def work(cols):
            rows = [one(x) for x in cols["data"]]
            return {"key": cols["key"]} | {n: [r[i] for r in rows] for i, n in enumerate(("height", "width", "channels", "tile", "dhash"))}

        return work

    kind = dict(df.dtypes)[key]
    out = map_slices(df.select(F.col(key).alias("key"), F.col(data).alias("data")), make, f"key {kind}, height int, width int, channels int, tile binary, dhash string")
    return out.withColumnRenamed("key", key)


def store_text(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded by zeros to a positive multiple of 64, as a PGM image of width 64; and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)), len(raw)


def text_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media binary): each text stored losslessly as an image.  A null text is an empty one."""

    def make():
        def work(cols):
            made = [store_text(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_bytes": [n for _, n in made], "media": [m for m, _ in made]}

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: DataFrame) -> DataFrame:
    """Read stored images back: payload digests, and the feature (difference hash, then the NPY tile's hash).

    ``media`` has (doc_id, n_bytes, media), as ``text_media`` gives them.
    """

    def make():
        def one(stored):
            image = decode(stored)
            payload = image.tobytes()
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(image)}-{hashlib.sha256(npy_tile(image)).hexdigest()[:16]}"

        def work(cols):
            rows = [one(x) for x in cols["media"]]
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    return map_slices(media, make, DIGEST)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """All documents as images: stored, read back and described."""
    return media_digest(text_media(table(spark, sf_dir, "documents")))
