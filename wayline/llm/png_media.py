"""Media columns: bytes as greyscale PNG images in a binary column, read back with checksum tests, and hashed.

Storing pads the bytes with 255 to a positive multiple of WIDTH, makes each WIDTH of them a row of 8-bit samples, picks a
filter per row and writes the chunks. Reading tests the signature and every chunk's CRC, inflates, and undoes all five
filter types with numpy. The feature is a hash of the low-frequency cosine coefficients of the image.

Defined cases: a null text is the empty text, stored as one row of 255; equal texts give equal values; rows with equal ids
each give their own row; a null image gives null features; a damaged one raises ValueError; an empty table gives none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6
GRID, LOW = 32, 8
_ANGLES = np.pi * (2 * np.arange(GRID) + 1) / (2 * GRID)
_COSINES = np.cos(np.arange(LOW)[:, None] * _ANGLES[None, :])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def write_png(payload: bytes) -> bytes:
    """A greyscale image of WIDTH columns; of the filters none, sub and up, each row takes the one of least residual."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    best = np.minimum(tried, -tried).sum(2, dtype=np.int64).argmin(0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale image without interlacing, as rows."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("wrong amount of samples")
    return _unfilter(lines.reshape(height, width + 1))


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    rows[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
    for y in np.flatnonzero(kinds >= 2):
        above = rows[y - 1] if y else np.zeros_like(rows[0])
        if kinds[y] == 2:
            rows[y] += above
        else:
            rows[y] = _by_sample(rows[y].tolist(), above.tolist(), int(kinds[y]))
    return rows


def _by_sample(line: list[int], above: list[int], kind: int) -> list[int]:
    """Average and Paeth, in which each sample needs the one before it."""
    out, a, c = [], 0, 0
    for x, b in zip(line, above, strict=True):
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        a, c = (x + guess) & 255, b
        out.append(a)
    return out


def _fit(rows: np.ndarray, axis: int) -> np.ndarray:
    """GRID means along an axis; a shorter axis repeats its samples."""
    n = rows.shape[axis]
    edges = np.arange(GRID) * n // GRID
    sizes = np.maximum(1, np.diff(edges, append=n))
    return np.add.reduceat(rows, edges, axis) / (sizes[:, None] if axis == 0 else sizes)


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients exceed the median of those beside the mean."""
    grid = _fit(_fit(rows.astype(np.float64), 1), 0)
    low = (_COSINES @ grid @ _COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, ``n_bytes`` of its UTF-8 and ``image``, the PNG."""
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                data = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
                images = pa.array([write_png(pad(d)) for d in data], pa.binary())
                yield pa.record_batch([batch.column(0), pa.array([len(d) for d in data], pa.int64()), images], [id_col, "n_bytes", "image"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, image binary")


def features(media: DataFrame, image_col: str = "image") -> DataFrame:
    """The rows with ``payload`` (the samples read back) and ``dct_hash`` as binary columns."""
    kept = [c for c in media.columns if c not in ("payload", "dct_hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                images = [None if d is None else read_png(d) for d in batch.column(image_col).to_pylist()]
                payload = pa.array([None if r is None else r.tobytes() for r in images], pa.binary())
                hashes = pa.array([None if r is None else cosine_hash(r) for r in images], pa.binary())
                yield pa.record_batch([*(batch.column(c) for c in kept), payload, hashes], [*kept, "payload", "dct_hash"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(kept).schema), "payload binary, dct_hash binary"])
    return media.select(kept).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = features(common.written(store(common.table(spark, sf_dir, "documents")), "media"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("image").cast("long").alias("media_bytes"),
        F.sha2("image", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )
