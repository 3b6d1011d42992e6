"""Token-id store: one wavelet matrix per shard of consecutive documents.

A shard file holds the bit-planes of its ids, most significant first, each plane stably partitioned by the one above it,
with a directory of ones per block: access, rank (counting) and select (occurrence lookup) work on the planes alone, and
16 bits hold an id of a vocabulary of 50,257. In the file every plane is a zstandard frame of its own, opened when it is first
read. Spark deals the documents out by ranges of their id and writes the shard
files as rows of a Parquet table in the shared folder, so that lost executors only cost their own tasks.

Defined cases: a null text is the empty text and gets the end id alone; rows with equal ids stand in order of their
texts; null ids stand first; ids are integers of at most 64 bits; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.pretokens import Pieces, library_pieces, library_tokenizer, pretokens

MAGIC = b"WLWM\x02"
SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits between two entries of the rank directory


class WaveletMatrix:
    """Ids in bit-planes. ``zeros`` are the zero bits of each, ``ones`` its directory; a plane is packed little-endian."""

    def __init__(self, n: int, planes: list[np.ndarray | bytes], zeros: list[int], ones: list[np.ndarray]):
        self.n, self._planes, self.zeros, self.ones = n, planes, zeros, ones
        self._none: dict[int, np.ndarray] = {}

    def plane(self, k: int) -> np.ndarray:
        """Plane ``k``; one that is still a frame of the file is opened."""
        if isinstance(self._planes[k], bytes):
            self._planes[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._planes[k]), np.uint8)
        return self._planes[k]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        level = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for bit in range(width - 1, -1, -1):
            set_ = (level >> bit & 1).astype(bool)
            level = np.concatenate([low := level.compress(~set_), level.compress(set_)])
            plane = np.packbits(set_, bitorder="little")
            planes.append(plane)
            zeros.append(len(low))
            ones.append(_directory(plane))
        return cls(len(ids), planes, zeros, ones)

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        width = len(self.zeros)
        level = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for k in range(width - 1, -1, -1):
            set_ = np.unpackbits(self.plane(k), count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[k]
            above = np.empty_like(level)
            above[np.flatnonzero(~set_)] = level[:zeros]
            above[np.flatnonzero(set_)] = level[zeros:] | level.dtype.type(1 << (width - 1 - k))
            level = above
        return level

    def _ones_before(self, k: int, i: int) -> int:
        block = i // BLOCK
        start = block * (BLOCK // 8)
        part = int.from_bytes(self.plane(k)[start : i // 8 + 1].tobytes(), "little")
        return int(self.ones[k][block]) + (part & ((1 << (i - block * BLOCK)) - 1)).bit_count()

    def _bit(self, k: int, i: int) -> int:
        return int(self.plane(k)[i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.zeros)):
            ones, bit = self._ones_before(k, i), self._bit(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where, under the last plane, the occurrences of ``symbol`` before ``i`` stand."""
        lo, hi, width = 0, i, len(self.zeros)
        if symbol < 0 or symbol >> width:
            return 0, 0
        for k in range(width):
            a, b = self._ones_before(k, lo), self._ones_before(k, hi)
            if symbol >> (width - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before position ``i``."""
        lo, hi = self._range(symbol, min(i, self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, nth: int) -> int:
        """Position of the occurrence number ``nth`` (from 0) of ``symbol``."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Position of the bit number ``nth`` of this value in plane ``k``: binary search for its block, then inside it."""
        before = self.ones[k]
        if not bit:
            if k not in self._none:
                self._none[k] = np.arange(len(before)) * BLOCK - before
            before = self._none[k]
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.plane(k)[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def to_bytes(self, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        """The shard file: header, document directory, planes with their rank directories."""
        known = np.array([d is not None for d in doc_ids], np.uint8)
        out = [
            MAGIC,
            struct.pack("<QBI", self.n, len(self.zeros), len(doc_ids)),
            known.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
        ]
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, (zeros, ones) in enumerate(zip(self.zeros, self.ones, strict=True)):
            frame = pack(self.plane(k).tobytes())
            out += [struct.pack("<QQ", zeros, len(frame)), frame, ones.astype("<u4").tobytes()]
        body = b"".join(out)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
        """The matrix, the document ids and their lengths; a damaged file raises ValueError."""
        if data[: len(MAGIC)] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a shard file, or damaged")
        n, width, docs = struct.unpack_from("<QBI", data, len(MAGIC))
        at = len(MAGIC) + 13

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        known, ids, lengths = take("u1", docs), take("<i8", docs), take("<u4", docs)
        planes, zeros, ones = [], [], []
        for _ in range(width):
            zeros.append(int(take("<u8", 1)[0]))
            planes.append(take("u1", int(take("<u8", 1)[0])).tobytes())
            ones.append(take("<u4", (n + 7) // 8 // (BLOCK // 8) + 2))
        return cls(n, planes, zeros, ones), [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and before the end where the bits fill their last block."""
    step = BLOCK // 8
    padded = np.zeros((len(plane) // step + 1) * step, np.uint8)
    padded[: len(plane)] = plane
    per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(1, dtype=np.uint32)
    return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)])


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = library_tokenizer(path)

    return Pieces(lambda pieces: library_pieces(tokenizer, pieces), limit=1_000_000)


@lru_cache(2)
def _added(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in library_tokenizer(path).get_added_tokens_decoder().values())


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """The library's ids of each text as native unsigned 32-bit integers; pre-tokens are encoded once and kept."""
    special = [any(s in t for s in _added(path)) for t in texts]
    plain = iter(_pieces(path).ids([pretokens(t) for t, s in zip(texts, special, strict=True) if not s]))
    library = library_tokenizer(path)
    return [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() if s else next(plain) for t, s in zip(texts, special, strict=True)]


def write_store(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Write every document's ids, then ``end_id``, in ascending id order; returns the store read back.

    Columns: ``part`` and ``seq`` (the shards' order), ``n_docs``, ``n_tokens`` and ``shard`` (the file's bytes).
    """
    ordered = common.id_and_text(docs, id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    end = array("I", [end_id]).tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, sizes, chunks, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(chunks), np.uint32))
            data = matrix.to_bytes(keys, sizes)
            return pa.record_batch([[part], [seq], [len(keys)], [matrix.n], pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for key, ids in zip(rows.column(0).to_pylist(), token_ids(rows.column(1).to_pylist(), tokenizer_path), strict=True):
                    keys.append(key)
                    sizes.append(len(ids) // 4 + 1)
                    chunks += [ids, end]
                    total += sizes[-1]
                    if total >= shard_tokens:
                        yield flush()
                        seq, keys, sizes, chunks, total = seq + 1, [], [], [], 0
        if keys:
            yield flush()

    return common.written(ordered.mapInArrow(shards, "part long, seq long, n_docs long, n_tokens long, shard binary"), "tokens")


def read_store(store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``part``, ``seq``, ``at`` (tokens of the shard before it) and ``ids`` (little-endian u32)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "part", "seq", "at", "ids"]
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, data = (batch.column(i)[row].as_py() for i in range(3))
                matrix, keys, lengths = WaveletMatrix.from_bytes(data)
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                for lo in range(0, len(keys), 512):
                    span = range(lo, min(lo + 512, len(keys)))
                    starts = [int(ends[i] - lengths[i]) for i in span]
                    data = [ids[a : int(ends[i])].tobytes() for a, i in zip(starts, span, strict=True)]
                    yield pa.record_batch([pa.array([keys[i] for i in span], pa.int64()), pa.array([part] * len(span), pa.int64()), pa.array([seq] * len(span), pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names)

    return store.select("part", "seq", "shard").mapInArrow(documents, f"`{id_col}` long, part long, seq long, at long, ids binary")


def offsets(store: DataFrame) -> DataFrame:
    """``before``: tokens of all earlier shards; one task orders the sums of the parts, the shards of a part are ordered apart."""
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", earlier(Window.orderBy("part")).alias("base"))
    inside = store.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("inside"))
    return inside.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("before"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    store = write_store(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    rows = read_store(store).select(
        "doc_id", "part", "seq", "at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    return rows.join(offsets(store), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
