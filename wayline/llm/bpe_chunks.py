"""Byte-level BPE encoding and decoding over overlapping chunks.

A text of up to CHUNK characters is one chunk. A longer one is cut into chunks that overlap by OVERLAP characters. Neighbours
are stitched at a pre-token boundary
that both have in their overlap. What a pre-token matches depends only on the text after its start, so from a common
boundary on both chunks agree; it is a boundary of the whole text if the earlier chunk's are, or if white space follows
other characters there, for no pre-token contains that. The pieces between such boundaries are encoded in parallel; where
an overlap has none (a run of thousands of letters), its chunks are joined into one piece. So the result is always that of
the whole text, whose ids are then put together in order.

Chunks of one text are cut, stitched and encoded in the task that has it. A text of more than DEALT characters is first cut
in the same way into chunks of that size, which are dealt out over the tasks, so that no task holds a very long text alone.

Defined cases: a null text is the empty text; an empty text has no ids; rows with equal ids or equal texts each give
their own row; an empty table gives an empty result; a null id stays null.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.pretokens import _OUTSIDE, Pieces, boundaries, pretokens, read_ranks

CHUNK, OVERLAP = 4_096, 256
DEALT, DEALT_OVERLAP = 32_768, 1_024


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    import tiktoken

    from wayline.llm.pretokens import PATTERN

    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    single = encoding._encode_single_piece  # one pre-token, as encode_ordinary encodes each of its matches
    return Pieces(lambda pieces: {p: array("I", single(p)).tobytes() for p in pieces})


@lru_cache(2)
def _vocabulary(path: str) -> pa.BinaryArray:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return pa.array(out, pa.binary())


def encode_texts(texts: list[list[str]], ranks_path: str) -> pa.ListArray:
    """The ids of texts given as their pre-tokens."""
    ids = _pieces(ranks_path).ids(texts)
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decode_ids(ids: pa.ListArray, ranks_path: str) -> pa.BinaryArray:
    """The bytes of each list of ids: their vocabulary entries one after the other."""
    first, last = (ids.offsets[k].as_py() for k in (0, len(ids)))
    entries = _vocabulary(ranks_path).take(ids.values.slice(first, last - first))
    places = np.frombuffer(entries.buffers()[1], np.int32)[: len(entries) + 1] if len(entries) else np.zeros(1, np.int32)
    ends = places[np.asarray(ids.offsets) - first]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), entries.buffers()[2] or pa.py_buffer(b"")])


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, chunk) pairs that cover ``text``, each neighbour sharing ``overlap`` characters."""
    at = 0
    while True:
        yield at, text[at : at + chunk]
        if at + chunk >= len(text):
            return
        at += chunk - overlap


def edges(starts: list[int], n: int, overlap: int) -> tuple[list[int], list[int]]:
    """Of a chunk of ``n`` characters, its pre-token boundaries in its first ``overlap``, and those in its last that no text behind it can change."""
    # A pre-token is settled if it ends two characters before the end of the chunk: none looks further ahead.
    settled, shift = n - 2, n - overlap
    return [b for b in starts if b < overlap], [b for b, end in zip(starts, starts[1:]) if b >= shift and end <= settled]


def sure(text: str, b: int) -> bool:
    """Whether ``b`` is a boundary whatever stands before: white space after another character."""
    return b > 0 and text[b].isspace() and not text[b - 1].isspace() and not _OUTSIDE.search(text[b - 1 : b + 1])


def chunk_pretokens(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of a text, each chunk pre-tokenised by itself and stitched to the next."""
    if len(text) <= chunk:
        return pretokens(text)
    parts = list(cut(text, chunk, overlap))
    found = [boundaries(part) for _, part in parts]
    pieces, exact, tail = [(0, 0)], True, set()  # pieces begin in a chunk, at a place of the text
    for k, ((at, part), starts) in enumerate(zip(parts, found, strict=True)):
        head, settled = edges(starts, len(part), overlap)
        if k:
            met = [at + b for b in head if at + b in tail]
            certain = [x for x in met if sure(part, x - at)]
            exact = bool(certain) or (exact and bool(met))  # boundaries of the whole text, not of the chunk alone
            if exact:
                pieces.append((k, (certain or met)[0]))
        tail = {at + b for b in settled}
    out: list[str] = []
    for (k, lo), (after, hi) in zip(pieces, [*pieces[1:], (len(parts), len(text))], strict=True):
        if after > k + 1:  # chunks without a common boundary are one piece
            out += pretokens(text[lo:hi])
            continue
        at, part = parts[k]
        marks = [b for b in found[k] if lo - at <= b < hi - at] + [hi - at]
        out += [part[x:y] for x, y in zip(marks, marks[1:])]
    return out


def encode(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT, dealt_overlap: int = DEALT_OVERLAP
) -> DataFrame:
    """One row per document: its id and ``ids`` array<int>, as tiktoken's encode_ordinary would give them."""
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, ids array<int>"
    if 2 * overlap > chunk or 2 * dealt_overlap > dealt:  # a chunk's two overlaps must not cross
        raise ValueError("overlap is more than half of a chunk")

    def encoded(texts: list[str]) -> pa.ListArray:
        return encode_texts([chunk_pretokens(t, chunk, overlap) for t in texts], ranks_path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield pa.record_batch([part.column(0), encoded(part.column(1).to_pylist())], [id_col, "ids"])

    long = F.length(text_col) > dealt
    short_rows = rows.filter(~long).mapInArrow(whole, schema)
    return short_rows.unionByName(_encode_long(rows.filter(long), encoded, dealt, dealt_overlap))


def _encode_long(rows: DataFrame, encode_pieces: Callable[[list[str]], pa.ListArray], chunk: int, overlap: int) -> DataFrame:
    """``encode`` for (id, text) rows of more than ``chunk`` characters."""
    id_col, text_col = rows.columns
    id_type = rows.schema[id_col].dataType.simpleString()

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text, tag = (batch.column(i)[row] for i in range(3))
                parts = list(cut(text.as_py(), chunk, overlap))
                for lo in range(0, len(parts), 32):
                    some = parts[lo : lo + 32]
                    n = len(some)
                    yield pa.record_batch(
                        [pa.repeat(tag, n), pa.array(range(lo, lo + n), pa.int64()), pa.repeat(key, n), pa.array([at for at, _ in some], pa.int64()), pa.array([t for _, t in some])],
                        ["tag", "no", "id", "at", "text"],
                    )

    def edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 32):
                heads, tails, sures = [], [], []
                for at, text in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    head, tail = edges(boundaries(text), len(text), overlap)
                    heads.append([at + b for b in head])
                    tails.append([at + b for b in tail])
                    sures.append([at + b for b in head if sure(text, b)])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails, sures)]
                yield pa.record_batch([*part.columns, *lists], [*part.schema.names, "head", "tail", "sure"])

    tagged = rows.select(id_col, text_col, F.monotonically_increasing_id().alias("tag"))  # tells rows with equal ids and texts apart
    dealt = tagged.mapInArrow(cut_rows, f"tag long, no long, id {id_type}, at long, text string").repartition("tag", "no")
    chunks = common.written(dealt.mapInArrow(edge_rows, f"tag long, no long, id {id_type}, at long, text string, head array<long>, tail array<long>, sure array<long>"), "chunks")

    # Where the chunk meets the one before it, and whether that is a boundary of the whole text.
    before = chunks.select("tag", (F.col("no") + 1).alias("no"), "tail")
    both = chunks.select("tag", "no", "at", F.length("text").alias("n"), "head", "sure").join(before, ["tag", "no"], "left")
    surely, either = (F.array_min(F.array_intersect(c, "tail")) for c in ("sure", "head"))
    seams = both.select("tag", "no", "at", "n", surely.isNotNull().alias("surely"), F.coalesce(surely, either).alias("meet"))
    so_far = Window.partitionBy("tag").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    last_sure = F.max(F.when(F.col("surely") | (F.col("no") == 0), F.col("no"))).over(so_far)
    last_none = F.max(F.when(F.col("meet").isNull() & (F.col("no") > 0), F.col("no"))).over(so_far)
    cuts = seams.select("tag", "no", "at", "n", F.when(F.col("no") == 0, 0).when(last_sure > F.coalesce(last_none, F.lit(-1)), F.col("meet")).alias("start"))
    next_start = F.lead("start").over(Window.partitionBy("tag").orderBy("no"))
    spans = cuts.select(
        "tag", "no", F.count("start").over(so_far).alias("piece"),
        (F.coalesce("start", F.col("at") + overlap) - F.col("at")).alias("lo"), F.coalesce(next_start - F.col("at"), "n").alias("hi"),
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def encoded() -> pa.RecordBatch:
            ids = encode_pieces(["".join(p[4][p[5] : p[6]] for p in g) for g in held])
            firsts = [g[0] for g in held]
            return pa.record_batch([pa.array([f[0] for f in firsts], pa.int64()), pa.array([f[1] for f in firsts], pa.int64()), pa.array([f[3] for f in firsts], id_arrow), ids], ["tag", "piece", "id", "ids"])

        for batch in batches:
            id_arrow = batch.schema.field(3).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0][:2] == row[:2]:
                    held[-1].append(row)
                    continue
                if len(held) == 32:
                    yield encoded()
                    held = []
                held.append([row])
        if held:
            yield encoded()

    met = chunks.select("tag", "no", "id", "text").join(spans.hint("merge"), ["tag", "no"]).select("tag", "piece", "no", "id", "text", "lo", "hi")
    met = met.repartition("tag", "piece").sortWithinPartitions("tag", "piece", "no")
    found = met.mapInArrow(pieces, f"tag long, piece long, id {id_type}, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    whole = found.groupBy("tag").agg(F.first("id").alias(id_col), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return whole.select(id_col, "ids")


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Each row's id, ids and ``decoded`` binary, the bytes that the ids stand for."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield pa.record_batch([part.column(0), part.column(1), decode_ids(part.column(1), ranks_path)], [id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 of decoded rows; the ids as decimals joined by one space."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decode(encode(common.table(spark, sf_dir, "documents"), path), path))


def sha(ids: list[int], decoded: bytes) -> tuple[str, str]:
    """The digests of one document, for tests."""
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
