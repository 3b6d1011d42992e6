"""Token counts from pre-token frequencies, without any document's ids.

The documents are read once in blocks of bounded text. A block keeps its distinct pre-tokens and, per document, how often
each of them stands in it. The blocks' vocabularies are brought together, each distinct pre-token is counted once, and the
counts are joined back to the blocks, where a document's tokens are the sum of frequency times count. A frequent pre-token
travels once per block, not per document, so no key is hot; a block, not a document or the corpus, is what a task holds.
The exchange deals pre-tokens out by a checksum, a block's pre-tokens of one bucket packed into one row.

Defined cases: a null text is the empty text with no bytes and no tokens; special strings inside a text are the library's
special tokens, as its default has it; rows with equal ids or texts each give their own row; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.pretokens import library_pieces, library_tokenizer, pretokens

BLOCK_CHARS = 32_000_000  # of text whose pre-tokens one block counts


@lru_cache(2)
def _special(path: str) -> re.Pattern | None:
    added = [t.content for t in library_tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def frequencies(text: str, path: str) -> Counter:
    """How often each pre-token, or special string, of the text stands in it."""
    special = _special(path)
    if not special or not special.search(text):
        return Counter(pretokens(text))
    out: Counter = Counter()
    for k, part in enumerate(special.split(text)):
        out.update([part] if k % 2 else pretokens(part))
    return out


def _pack(index: np.ndarray, freq: np.ndarray) -> bytes:
    """Ascending indexes as steps, and frequencies, in planes of bytes, which shuffles compress well."""
    order = np.argsort(index, kind="stable")
    both = np.empty((2, len(index)), "<u4")
    both[0] = np.diff(index[order], prepend=0)
    both[1] = freq[order]
    return np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int64), both[1].astype(np.int64)


def block_frequencies(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, block_chars: int, buckets: int) -> DataFrame:
    """Rows of two kinds: a document's packed frequencies, or (``bucket`` not null) a block's pre-tokens of one bucket.

    A block numbers its pre-tokens by bucket (a checksum) and then by their bytes; ``packed`` refers to these numbers.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    names = [id_col, "n_bytes", "block", "packed", "bucket", "pieces"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vocabulary, chars, held = TaskContext.get().partitionId() << 32, {}, 0, []

        def close(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            coded = [p.encode("utf-8", "surrogatepass") for p in vocabulary]
            of = [zlib.crc32(p) % buckets for p in coded]
            order = sorted(range(len(coded)), key=lambda i: (of[i], coded[i]))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            for lo in range(0, len(held), 512):
                part = held[lo : lo + 512]
                packed = [_pack(place[index], freq) for _, _, index, freq in part]
                n = len(part)
                values = [[p[1] for p in part], [block] * n, packed, [None] * n, [None] * n]
                yield pa.record_batch([pa.array([p[0] for p in part], id_type), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names)
            groups = [(k, b"\0".join(coded[i].replace(b"\0", b"\xff") for i in g)) for k, g in groupby(order, key=of.__getitem__)]
            n = len(groups)
            values = [[None] * n, [block] * n, [None] * n, [k for k, _ in groups], [g for _, g in groups]]
            yield pa.record_batch([pa.nulls(n, id_type), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts, add = frequencies(text, tokenizer_path), vocabulary.setdefault
                    index = np.array([add(p, len(vocabulary)) for p in counts], np.int32)
                    held.append((key, len(text.encode("utf-8", "surrogatepass")), index, np.array(list(counts.values()), np.int32)))
                    chars += len(text)
                    if chars >= block_chars:
                        yield from close(id_type)
                        block, vocabulary, chars, held = block + 1, {}, 0, []
        if held:
            yield from close(id_type)

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, block long, packed binary, bucket int, pieces binary")


def piece_counts(vocabularies: DataFrame, tokenizer_path: str) -> DataFrame:
    """``block``, ``bucket``, ``counts``: the tokens of each block's pre-tokens, each distinct one encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at, known = library_tokenizer(tokenizer_path), None, {}
        for whole in batches:  # sorted by bucket; equal pre-tokens of all blocks have the same bucket
            for lo in range(0, whole.num_rows, 64):
                batch, out = whole.slice(lo, 64), []
                for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if bucket != at:
                        at, known = bucket, {}
                    pieces = data.split(b"\0")
                    new = [p for p in pieces if p not in known]
                    texts = [p.replace(b"\xff", b"\0").decode("utf-8", "surrogatepass") for p in new]
                    ids = library_pieces(tokenizer, texts)
                    known.update((p, len(ids[t]) // 4) for p, t in zip(new, texts, strict=True))
                    out.append(np.fromiter(map(known.__getitem__, pieces), "<u4", len(pieces)).tobytes())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "counts"])

    dealt = vocabularies.select("block", "bucket", "pieces").repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(count, "block long, bucket int, counts binary")


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's id, ``n_bytes`` of UTF-8 and ``n_tokens``."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = common.written(block_frequencies(docs, tokenizer_path, id_col, text_col, block_chars, buckets), "frequencies")
    counts = piece_counts(rows.filter(F.col("bucket").isNotNull()), tokenizer_path)
    documents = rows.filter(F.col("bucket").isNull()).select("block", id_col, "n_bytes", "packed")
    id_type = rows.schema[id_col].dataType.simpleString()

    def total(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        parts = sorted(zip(theirs.column("bucket").to_pylist(), theirs.column("counts").to_pylist(), strict=True))
        per_piece = np.frombuffer(b"".join(c for _, c in parts), "<u4").astype(np.int64)
        n = [int(per_piece[index] @ freq) for index, freq in map(_unpack, mine.column("packed").to_pylist())]
        return pa.table([mine.column(id_col), mine.column("n_bytes"), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return documents.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(total, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
