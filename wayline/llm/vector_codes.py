"""Product codes of vectors from exact integer arithmetic on floating-point matrix products.

Components become integers. A matrix product of integers is taken limb by limb: each factor is split into limbs so narrow
that every product of two limb matrices stays below 2^53 and is therefore exact in float64 whatever order BLAS adds in; the
products are put together again in int64. Distances are exact, so the first least entry is the same on every machine.

A round reads the table once: a task sends on one row per part, entry and component, not per vector, and the driver keeps
the codebooks alone (parts x entries x width integers). The integers are written once to the shared folder.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped; a vector shorter than the
longest counts as zero behind its end, and so does the rest of the last part where the length is no multiple of the parts;
null ids come after all others when the first codebook is taken, equal ids in the order of their integers' bytes; rows with
equal ids or vectors each give their own row; with fewer rows than entries the codebooks have as many entries as rows; an
empty table gives an empty result and empty codebooks. A component or distance that 31 or 63 bits cannot hold raises OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
ROWS = 4_096  # vectors that a task works on at a time


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices whose sum, each shifted by ``bits`` more than the one before, is ``a``; all but the last are not negative."""
    out = []
    while a.size and (a.min() < -(1 << bits) or a.max() >= 1 << bits):
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact where the result fits (else modulo 2^64)."""
    inner = max(1, a.shape[1])
    bits = (53 - (inner - 1).bit_length()) // 2  # inner * 2^(2 * bits) <= 2^53
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for i, left in enumerate(limbs(a, bits)):
        for j, right in enumerate(limbs(b, bits)):
            shift = bits * (i + j)
            if shift < 64:
                out += (left @ right).astype(np.int64) << np.int64(shift)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first entry of least squared distance for each row, and that distance."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] >= 1 << 63:
        raise OverflowError("squared distances pass 63 bits")
    squares = (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2 * exact_dot(x, entries.T)
    best = squares.argmin(1)
    return best, np.take_along_axis(squares, best[:, None], 1)[:, 0]


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``ints``: floor(scale * x) of the vectors kept, as little-endian 32-bit integers; written."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.filter(sound).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(2)
                ints = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
                if len(ints) and np.abs(ints).max() >= 1 << 31:
                    raise OverflowError("a component passes 31 bits")
                ends = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).astype(np.int32) * 4
                data = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ints.astype("<i4").tobytes())])
                yield pa.record_batch([batch.column(0), batch.column(1), data], ["id", "label", "ints"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return common.written(rows.mapInArrow(run, f"id {types['id']}, label {types['label']}, ints binary"), "integers")


def _matrix(column: pa.BinaryArray, width: int) -> np.ndarray:
    """The rows of ``ints`` padded with zeros to ``width``, as int64."""
    data = column.to_pylist()
    if any(len(d) != 4 * width for d in data):
        data = [d.ljust(4 * width, b"\0") for d in data]
    return np.frombuffer(b"".join(data), "<i4").reshape(len(data), width).astype(np.int64)


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after ``rounds`` rounds from the vectors of the least ids."""
    longest = ints.agg(F.max(F.octet_length("ints"))).first()[0] or 0
    width = -(-longest // (4 * parts)) * parts
    first = ints.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    seeds = _matrix(pa.array([r.ints for r in first], pa.binary()), width)
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width // parts).swapaxes(0, 1))
    for _ in range(rounds if books.size else 0):
        books = _moved(ints, books)
    return books


def _moved(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts nearest to them; unused ones stay."""
    parts, entries, size = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), np.int64)  # last: how many
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                x = _matrix(whole.column(0).slice(at, ROWS), parts * size)
                ones = np.ones((len(x), 1), np.int64)
                for p in range(parts):
                    mine = x[:, p * size : (p + 1) * size]
                    chosen = nearest(mine, books[p])[0][None, :] == np.arange(entries)[:, None]
                    total[p] += exact_dot(chosen.astype(np.int64), np.hstack([mine, ones]))
        used = np.flatnonzero(total[:, :, -1].ravel())
        for lo in range(0, len(used), 1_000):  # few rows at a time, as wide parts make them many
            cells = used[lo : lo + 1_000]
            cell, place = np.repeat(cells, size + 1), np.tile(np.arange(size + 1), len(cells))
            yield pa.record_batch([pa.array(cell), pa.array(place), pa.array(total.reshape(-1, size + 1)[cells].ravel())], ["cell", "place", "value"])

    found = ints.select("ints").mapInArrow(sums, "cell long, place long, value long")
    total = np.zeros((parts * entries, size + 1), object)
    for cell, place, value in found.groupBy("cell", "place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        total[cell, place] = int(value)
    moved = books.reshape(parts * entries, size).copy()
    for cell in np.flatnonzero(total[:, -1]):
        moved[cell] = [int(v) // int(total[cell, -1]) for v in total[cell, :-1]]
    return moved.reshape(books.shape)


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """Each row's ``id``, ``label``, ``code`` (binary, the entry of each part) and ``error``, the squared distance to what it stands for."""
    parts, entries, size = books.shape
    if entries > 256:
        raise ValueError("a code has one byte per part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column(2), parts * size)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    best, apart = nearest(x[:, p * size : (p + 1) * size], books[p])
                    code[:, p] = best
                    error += apart
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.record_batch([batch.column(0), batch.column(1), codes, pa.array(error)], ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in ints.schema}
    return ints.mapInArrow(run, f"id {types['id']}, label {types['label']}, code binary, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """The rows with ``approximation``, the integers that the code stands for."""
    table = [[[int(v) for v in entry] for entry in book] for book in books]
    entries = F.lit(table).cast("array<array<array<bigint>>>") if books.size else F.lit(None).cast("array<array<array<bigint>>>")
    at = lambda p: F.conv(F.hex(F.expr(f"substring(`{code_col}`, {p + 1}, 1)")), 16, 10).cast("int")
    parts = [F.element_at(F.element_at(entries, p + 1), at(p) + 1) for p in range(books.shape[0])]
    return codes.withColumn(common.unused(codes.columns, "approximation"), F.flatten(F.array(*parts)))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = integers(common.table(spark, sf_dir, "embeddings"), SCALE, "vec_id", "embedding", "label")
    books = fit(ints)
    coded = common.written(encode(ints, books), "codes")
    common.discard(ints)
    # One row per label beside the rows: a hot label's rows are split by the adaptive join, the sums are not.
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    both = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
