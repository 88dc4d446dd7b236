"""Media columns: Netpbm and BMP images to numpy arrays, area-resized, stored as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

ship(__name__)

SIDE = 24
UNIT = SIDE * SIDE  # samples in a tile


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or BMP (8, 24 or 32 bits, uncompressed) image as rows x columns [x 3] of uint8 or uint16.

    Raises ValueError for anything else, or if samples are missing.
    """
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm or BMP image")
    kind, at, numbers = data[1] - 48, 2, []
    need = 2 if kind in (1, 4) else 3
    while len(numbers) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    w, h, top = (*numbers, 1)[:3]
    depth, body = 3 if kind in (3, 6) else 1, data[at + 1 :]
    if kind == 1:
        raw = np.frombuffer(b"".join(body.split()), np.uint8)[: w * h] - 48
    elif kind < 4:
        raw = np.array(body.split()[: w * h * depth], np.int64)
    elif kind == 4:
        raw = np.unpackbits(np.frombuffer(body, np.uint8, h * -(-w // 8)).reshape(h, -1), axis=1)[:, :w].ravel()
    else:
        raw = np.frombuffer(body, ">u2" if top > 255 else np.uint8, w * h * depth)
    if raw.size != w * h * depth:
        raise ValueError("samples are missing")
    out = raw.astype(np.uint16 if top > 255 else np.uint8)
    out = (1 - out) * 255 if kind in (1, 4) else out
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    def u(at: int, n: int, signed: bool = False) -> int:
        return int.from_bytes(data[at : at + n], "little", signed=signed)

    start, w, h, bits, packed = u(10, 4), u(18, 4, True), u(22, 4, True), u(28, 2), u(30, 4)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("unsupported BMP")
    row = -(-w * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    if bits == 8:
        n = u(46, 4) or 256
        colours = np.frombuffer(data, np.uint8, 4 * n, 14 + u(14, 4)).reshape(n, 4)[:, 2::-1]
        out = colours[raw]
    else:
        out = raw.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return out[::-1] if h > 0 else out


def pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(image.dtype)


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the h x w areas that divide the image, exact at fractional edges: differences of the integral image."""

    def at_edges(cum: np.ndarray, n: int) -> np.ndarray:
        """The running sum along the first axis at n + 1 equal steps, linear within a sample."""
        edge = np.arange(n + 1) * (cum.shape[0] - 1)
        low = edge // n
        part = (edge % n / n)[:, None]
        return cum[low] * (1 - part) + cum[np.minimum(low + 1, cum.shape[0] - 1)] * part

    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])
    sums = at_edges(at_edges(total, h).T, w).T
    return np.diff(np.diff(sums, axis=0), axis=1) * (h * w / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 areas is darker than the one to its right (by more than rounding)."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes().hex()


def npy(tiles: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tiles, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray) -> bytes:
    """An image of SIDE columns as NPY tiles of SIDE x SIDE samples; its rows are a multiple of SIDE."""
    return npy(np.ascontiguousarray(image).reshape(-1, SIDE, SIDE))


def untile(stored: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(stored), allow_pickle=False)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes with as many bytes 255 as make a positive multiple of UNIT; and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(text: str | None) -> tuple[int, bytes]:
    """The text as a PGM image of SIDE columns, decoded and written as NPY tiles."""
    n, data = payload(text)
    return n, tile(decode(pgm(np.frombuffer(data, np.uint8).reshape(-1, SIDE))))


MEDIA = "n_bytes long, media binary, feature string"


def media_column(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, media (NPY tiles) and feature (difference hash of the whole image) of each row.

    A null or empty text is one tile of 255. The id may be null, rows may repeat: each gives one row. An empty table
    gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):  # stored forms are as large as texts; small batches bound the memory
                part = b.slice(k, 500)
                made = [store(t.as_py()) for t in part.column(1)]
                marks = [difference_hash(untile(m).reshape(-1, SIDE)) for _, m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary()), pa.array(marks, pa.string())], [id_col, "n_bytes", "media", "feature"])

    return docs.select(id_col, text).mapInArrow(each, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {MEDIA}")


def digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes and hashes of the stored bytes and of the samples read back from them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for m in b.column(2):
                stored = m.as_py()
                back = untile(stored).tobytes()
                for c, v in zip(cols, (len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), sha256(stored).hexdigest())):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)], b.column(3)], [id_col, "n_bytes", *names, "feature"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media", "feature").mapInArrow(each, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
