"""Netpbm and BMP images as numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Images that cannot be decoded give null tiles and hashes and an error text; null bytes give nulls throughout.

Texts as media: null texts count as empty and have one row of 64 zero samples; texts of any length are taken whole. Payloads
of an even number of rows are stored as P5 greymaps, others as 8-bit BMP. Repeated rows and equal texts get equal values; an
empty table gives no rows. Extra columns do not matter, whatever their names.
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

from tracewright.llm.common import documents, shared_folder, small_batches, table, tidy, written

#: Samples in a stored row of the payload image, and rows and columns of a payload's tile.
WIDTH, TILE = 64, 16
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3) of 8 or 16 bits; bitmaps have 0 and 1, 1 being black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    if not (0 < top < 65536) or width < 1 or height < 1:
        raise ValueError("sizes out of range")
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n], np.uint8) - 48
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        return np.unpackbits(bits, axis=1)[:, :width]
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(flat) < n or (flat > top).any():
        raise ValueError("samples missing or out of range")
    flat = flat.astype(np.uint16 if top > 255 else np.uint8, copy=False)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width) for grey palettes, else (height, width, 3) RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("kind of BMP not supported")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    spread = np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1) if bits == 4 else raw
    colour = palette[spread[:, :width]]
    return np.ascontiguousarray(colour[:, :, 0]) if (palette == palette[:, :1]).all() else colour


def decode(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def write_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """A binary greymap of 8-bit samples; their number must be a multiple of the width."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def write_bmp(samples: bytes, width: int = WIDTH) -> bytes:
    """An uncompressed BMP of 8-bit grey samples, rows from the top; the width is a multiple of four."""
    rows, start = len(samples) // width, 14 + 40 + 4 * 256
    head = struct.pack("<2sIHHI", b"BM", start + len(samples), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -rows, 1, 8, 0, len(samples), 0, 0, 256, 0)
    grey = np.zeros((256, 4), np.uint8)
    grey[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    return head + grey.tobytes() + samples


def _areas(a: np.ndarray, size: int) -> np.ndarray:
    """Means of ``size`` equal spans of axis 0, from the running sum read at fractional places."""
    n = len(a)
    total = np.zeros((n + 1, *a.shape[1:]))
    np.cumsum(a, axis=0, out=total[1:])
    edge = np.arange(size + 1) * (n / size)
    low = np.minimum(edge.astype(np.int64), n - 1)
    part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
    return np.diff(total[low] + part * (total[low + 1] - total[low]), axis=0) * (size / n)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average at the new size: the integral image taken along the rows in blocks, then along the columns."""
    image = image.mean(2) if image.ndim == 3 else image
    block = max(1, (1 << 20) // image.shape[1])
    narrow = np.concatenate([_areas(image[i : i + block].T.astype(float), width).T for i in range(0, len(image), block)])
    return _areas(narrow, height)


def difference_hash(image: np.ndarray) -> str:
    """64 signs of steps along rows, then 64 along columns, as 32 hex digits."""
    image = image.mean(2) if image.ndim == 3 else image
    tile = np.round(resize(image, 9, 9), 6)
    bits = np.concatenate([(tile[:8, 1:] > tile[:8, :-1]).ravel(), (tile[1:, :8] > tile[:-1, :8]).ravel()])
    return np.packbits(bits).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, id_column: str = "doc_id", column: str = "media", size: int = 32) -> DataFrame:
    """Of each image: its shape, an NPY tile (size x size, float32), the difference hash, or an error text."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, made, hashes, errors = [], [], [], []
            for value in batch.column(1):
                data = value.as_py()
                shape = tile = mark = error = None
                try:
                    if data is not None:
                        image = decode(data)
                        shape, tile, mark = list(image.shape), npy(resize(image, size, size).astype(np.float32)), difference_hash(image)
                except (ValueError, struct.error, IndexError, OverflowError) as e:
                    error = str(e)
                shapes.append(shape)
                made.append(tile)
                hashes.append(mark)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.list_(pa.int32())), pa.array(made, pa.binary()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())], ["id", "shape", "tile_npy", "dhash", "error"])

    return media.select(media[id_column].cast("long").alias("id"), media[column].cast("binary").alias("media")).mapInArrow(rows, "id long, shape array<int>, tile_npy binary, dhash string, error string")


def payload_images(docs: DataFrame) -> DataFrame:
    """Texts as grey images: doc_id, n_bytes and media (a P5 or BMP file of the zero-padded UTF-8 bytes)."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [x.as_py().encode() for x in batch.column(1)]
            padded = [b.ljust(max(WIDTH, -(-len(b) // WIDTH) * WIDTH), b"\0") for b in raw]
            media = [write_bmp(b) if len(b) // WIDTH % 2 else write_pgm(b) for b in padded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def payload_features(media: DataFrame) -> DataFrame:
    """What payload_images stored, read back: digests of samples and file, the tail's CRC, the difference hash, and an NPY
    tile (TILE x TILE, 8 bits)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"]

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, tail, length, file_sha, feature, tile = [], [], [], [], [], [], []
            for value in batch.column(2):
                data = value.as_py()
                image = decode(data)
                samples = image.tobytes()
                size.append(len(samples))
                sha.append(hashlib.sha256(samples).hexdigest())
                tail.append(zlib.crc32(samples[-WIDTH:]))
                length.append(len(data))
                file_sha.append(hashlib.sha256(data).hexdigest())
                feature.append(difference_hash(image))
                tile.append(npy(np.round(resize(image, TILE, TILE)).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(tail, pa.int64()), pa.array(length, pa.int64()), pa.array(file_sha, pa.string()), pa.array(feature, pa.string()), pa.array(tile, pa.binary())],
                names,
            )

    return media.mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(payload_images(table(spark, sf_dir, "documents")), shared_folder(spark, "media"))
    return payload_features(stored)
