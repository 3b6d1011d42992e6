"""Which tokens of two tokenizers stand on the same bytes, by merging all documents of a batch in lockstep.

Both sides are cut into lanes where both surely end a token, before a space that follows another character, so that a long
document is many lanes. One vector holds a pointer into A's tokens and one into B's for every lane of the batch. Each step
emits the link of the two tokens that every lane stands on, a cut where both end at the same byte, moves the pointers whose
token ends first (both at a cut), and drops the lanes that are done. So a lane takes as many steps as it has links, and a
batch as many as its longest lane, whatever the number of its documents.

Pre-tokens of A and space-led words of B are encoded once and kept in bounded caches, which never change a result. Counts of
linked id pairs over the corpus come from blocks: a block sends each distinct pair once with its frequency, the sums are
joined back to the blocks, and a document adds up frequency times count. A task holds one block.

A is a byte-level BPE file of the tokenizers library, encoding a space and the text; B a sentencepiece model that puts a
space in front and keeps white space.

Defined cases: null and empty texts, and those whose tokens do not give back the text's bytes (it holds U+2581, or a model
normalises it), have no tokens: zeros and an empty digest; strings of special tokens are plain text; rows with equal ids or
texts each give their own row and all of them count; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.pretokens import library_pieces, library_tokenizer, pretokens
from wayline.llm.token_counts import _pack, _unpack

LANE_CHARS = 2_048  # after which a lane ends at the next place where both tokenizers do
BATCH_CHARS, BATCH_ROWS = 4_000_000, 4_096  # characters or documents that are merged in one lockstep
PAIR_BITS = 40  # of a pair of ids
BLOCK_CHARS = 32_000_000  # whose pairs one block counts
SPACE = "▁"
KEPT_UNITS, KEPT_CHARS = 300_000, 64  # pre-tokens or words whose ids are kept, and the longest of them

_WORD = re.compile(" +[^ ]*")
_END = re.compile(r"(?<=\S) ")


class Side:
    """One tokenizer: the bytes of its tokens and the ids of its units (pre-tokens or words), of which short ones are kept."""

    def __init__(self, entries: list[bytes]):
        self.entries, self.lengths, self.known = entries, np.array([len(e) for e in entries], np.int64), {}

    def units(self, lane: str) -> list[str]:
        raise NotImplementedError

    def encode(self, units: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _sound(self, units: list[str], coded: list[bytes]) -> Iterator[tuple[str, bytes | None]]:
        """Units with their ids, or None where the ids' bytes are not the unit's."""
        ids = np.frombuffer(b"".join(coded), np.uint32)
        texts = [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.cumsum([0, *map(len, coded)]) // 4]
        apart = np.diff(sizes) != np.fromiter(map(len, texts), np.int64, len(texts))
        entry = self.entries.__getitem__
        if not apart.any() and b"".join(map(entry, ids.tolist())) == b"".join(texts):
            return zip(units, coded, strict=True)
        whole = (b"".join(map(entry, array("I", c))) == t for c, t in zip(coded, texts, strict=True))
        return ((u, c if w else None) for u, c, w in zip(units, coded, whole, strict=True))

    def lanes(self, lanes: list[str]) -> list[bytes | None]:
        """The ids of each lane as unsigned 32-bit integers; None where they do not give back its bytes."""
        texts = [self.units(t) for t in lanes]
        every = set().union(*texts)
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        new = [u for u in every if u not in self.known]
        self.known.update(self._sound(new, self.encode(new)))
        out = []
        for units in texts:
            try:
                out.append(b"".join(map(self.known.__getitem__, units)))
            except TypeError:  # a None
                out.append(None)
        for unit in new:
            if len(unit) > KEPT_CHARS:
                del self.known[unit]
        return out


class ByteLevel(Side):
    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        # The alphabet of byte-level vocabularies: printable bytes are their own character, the others follow from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in printable)
        of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        super().__init__(entries)

    def units(self, lane: str) -> list[str]:
        return pretokens(lane)

    def encode(self, units: list[str]) -> list[bytes]:
        return list(map(library_pieces(self.tokenizer, units).__getitem__, units))


class SpaceLed(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        places = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in places]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in zip(places, names, strict=True)])
        #: No piece reaches over the beginning of a word, so words, and lanes, can be encoded one by one.
        self.apart = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.last = array("I", self.model.encode("a ")[len(self.model.encode("a")) :]).tobytes()  # a space at the end of a text

    def units(self, lane: str) -> list[str]:
        return _WORD.findall(lane) if self.apart else [lane]

    def encode(self, units: list[str]) -> list[bytes]:
        found = self.model.encode([u[1:] for u in units], num_threads=1)
        return [self.last if u == " " else array("I", ids).tobytes() for u, ids in zip(units, found, strict=True)]


@lru_cache(2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, SpaceLed]:
    return ByteLevel(path_a), SpaceLed(path_b)


def cut_lanes(text: str, chars: int = LANE_CHARS) -> list[str]:
    """A space and the text in lanes of at least ``chars`` characters but the last, each of which begins with a space after another character."""
    whole, at, out = " " + text, 0, []
    while m := _END.search(whole, at + chars):
        out.append(whole[at : m.start()])
        at = m.start()
    return [*out, whole[at:]]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and cuts of all lanes, each as positions of A's and of B's tokens.

    ``end_a`` and ``end_b`` are the places where the tokens of all lanes, one after the other, end; a lane begins at
    ``first_a`` and ``first_b``, has tokens, and is done when its pointer into A reaches ``last_a``.
    """
    state = np.stack([first_a, first_b])
    links, cuts = [], []
    while state.shape[1]:
        a, b = end_a[state[0]], end_b[state[1]]
        links.append(state)
        cuts.append(state[:, a == b])
        state = state + np.stack([a <= b, b <= a])
        running = state[0] < last_a
        if not running.all():
            state, last_a = state[:, running], last_a[running]
    return tuple(np.concatenate([x[k] for x in some]) if some else np.zeros(0, np.int64) for some in (links, cuts) for k in (0, 1))


class Aligned:
    """The tokens, links and groups of a batch of texts; ``bounds_a[i] : bounds_a[i + 1]`` are the tokens of text ``i``."""

    def __init__(self, texts: list[str], a: ByteLevel, b: SpaceLed, lane_chars: int = LANE_CHARS):
        cut = [(cut_lanes(t, lane_chars) if b.apart else [" " + t]) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        ids_a, ids_b = (side.lanes([lane for c in cut for lane in c]) for side in (a, b))
        bad = np.array([x is None or y is None for x, y in zip(ids_a, ids_b, strict=True)], bool)
        good = ~np.isin(owner, owner[bad])
        owner = owner[good]
        ids_a, ids_b = ([x for x, g in zip(ids, good, strict=True) if g] for ids in (ids_a, ids_b))
        self.a, self.b = (np.frombuffer(b"".join(ids), np.uint32).astype(np.int64) for ids in (ids_a, ids_b))
        last_a, last_b = (np.cumsum([len(x) // 4 for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        first_a, first_b = (np.concatenate([[0], last[:-1]]).astype(np.int64) for last in (last_a, last_b))
        ends = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.link_a, self.link_b, cut_a, cut_b = lockstep(*ends, first_a, first_b, last_a)
        self.cut_a, self.cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.cut_a[cut_a], self.cut_b[cut_b] = True, True
        n = len(texts)
        self.bounds_a, self.bounds_b = (np.concatenate([[0], np.cumsum(np.bincount(owner, last - first, n).astype(np.int64))]) for first, last in ((first_a, last_a), (first_b, last_b)))
        self.owner_a = np.repeat(np.arange(n), np.diff(self.bounds_a))

    def counts(self) -> tuple[np.ndarray, ...]:
        """``n_a``, ``n_b``, ``n_groups`` and ``n_links`` of each text."""
        n = len(self.bounds_a) - 1
        return np.diff(self.bounds_a), np.diff(self.bounds_b), np.bincount(self.owner_a[self.cut_a], minlength=n), np.bincount(self.owner_a[self.link_a], minlength=n)

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's linked id pairs, a pair as ``a * width + b``: text, pair, how often; in order."""
        pair = self.a[self.link_a] * width + self.b[self.link_b]
        both, freq = np.unique(self.owner_a[self.link_a] << PAIR_BITS | pair, return_counts=True)
        return both >> PAIR_BITS, both & ((1 << PAIR_BITS) - 1), freq

    def groups(self, a: ByteLevel, b: SpaceLed) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        wide_a, wide_b, labels = len(a.entries), len(b.entries), _labels(len(a.entries), len(b.entries))
        of_a, of_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        n = int(self.cut_a.sum())
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        index = np.empty(len(self.a) + len(self.b), np.int64)
        index[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[of_a]] = self.a + wide_a * self.cut_a
        index[np.arange(len(self.b)) + np.cumsum(in_a)[of_b]] = 2 * wide_a + self.b + wide_b * self.cut_b
        taken = labels.take(pa.array(index))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data, bounds = memoryview(taken.buffers()[2] or b""), places[self.bounds_a + self.bounds_b].tolist()
        return (bytes(data[lo : max(lo, hi - 1)]) for lo, hi in zip(bounds, bounds[1:], strict=False))


@lru_cache(2)
def _labels(wide_a: int, wide_b: int) -> pa.Array:
    """Ids as decimals with what stands behind them: A's inside and at the end of a group, then B's."""
    return pa.array([f"{i}{end}".encode() for wide, ends in ((wide_a, ",|"), (wide_b, ",;")) for end in ends for i in range(wide)], pa.large_binary())


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds: a document's counts, digest and packed pairs, or (``pair`` not null) a block's pair with its place and frequency.

    ``packed`` refers to a block's pairs by their place in ascending order. A pair is A's id times the size of B's vocabulary plus B's id.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "packed", "place", "pair", "n"]
    types = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        width = len(b.entries)
        if len(a.entries) * width > 1 << PAIR_BITS:
            raise ValueError("vocabularies too large for a pair's bits")
        block, held, chars, texts, waiting = TaskContext.get().partitionId() << 32, [], 0, [], 0

        def merge() -> None:
            """Align the waiting texts and add them to the block."""
            found = Aligned([t for _, t in texts], a, b)
            owner, pair, freq = found.pairs(width)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            for k, (counts, groups) in enumerate(zip(zip(*found.counts(), strict=True), found.groups(a, b), strict=True)):
                sha = hashlib.sha256(groups).hexdigest() if counts[0] else ""
                held.append((texts[k][0], *map(int, counts), sha, pair[at[k] : at[k + 1]], freq[at[k] : at[k + 1]]))

        def close(id_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
            every, where = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
            total = np.bincount(where, np.concatenate([h[7] for h in held]), len(every)).astype(np.int64)  # exact: far below 2^53
            ends = np.cumsum([len(h[6]) for h in held])
            for lo in range(0, len(held), 512):
                part = held[lo : lo + 512]
                n = len(part)
                packed = [_pack(where[end - len(h[6]) : end], h[7]) for h, end in zip(part, ends[lo : lo + 512].tolist(), strict=True)]
                values = [*([h[k] for h in part] for k in range(1, 6)), [block] * n, packed, [None] * n, [None] * n, [None] * n]
                yield pa.record_batch([pa.array([h[0] for h in part], id_arrow), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names)
            for lo in range(0, len(every), 8_192):
                part = every[lo : lo + 8_192]
                n = len(part)
                values = [*[[None] * n] * 5, [block] * n, [None] * n, np.arange(lo, lo + n), part, total[lo : lo + n]]
                yield pa.record_batch([pa.nulls(n, id_arrow), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names)

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    texts.append((key, text))
                    waiting += len(text)
                    if waiting >= BATCH_CHARS or len(texts) == BATCH_ROWS:
                        merge()
                        chars, texts, waiting = chars + waiting, [], 0
                        if chars >= block_chars:
                            yield from close(id_arrow)
                            block, held, chars = block + 1, [], 0
        if texts:
            merge()
        if held:
            yield from close(id_arrow)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, packed binary, place int, pair long, n long")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """``pair``, ``b`` and ``count`` over all documents of ``blocks``, and ``best``: whether no pair of that B id has a higher count; written."""
    counts = common.written(found.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("count")), "pairs").withColumn("b", F.col("pair") % width)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    # One row per id of B: its vocabulary bounds what is sent to the tasks.
    return counts.join(F.broadcast(most), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``a_ids``, ``b_ids``, ``link_a`` and ``link_b`` (positions of linked tokens, in order) and ``cut_a``, ``cut_b`` (positions that end a group)."""
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"]

    def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        for whole in batches:
            texts = whole.column(1).to_pylist()
            for lo, hi in common.by_size(texts, BATCH_ROWS, BATCH_CHARS):
                found = Aligned(texts[lo:hi], a, b)
                owner = found.owner_a[found.link_a]
                order = np.argsort(owner, kind="stable")
                # A step emits one link of each lane, so a text's links are put in order by their tokens.
                order = order[np.lexsort([found.link_b[order], found.link_a[order]])]
                at = np.searchsorted(owner[order], np.arange(hi - lo + 1))
                starts_a, starts_b = found.bounds_a[:-1], found.bounds_b[:-1]
                cut_a, cut_b = np.flatnonzero(found.cut_a), np.flatnonzero(found.cut_b)
                cuts = np.searchsorted(found.owner_a[cut_a], np.arange(hi - lo + 1))
                of = np.repeat(np.arange(hi - lo), np.diff(cuts))
                columns = [
                    lists(found.a, found.bounds_a), lists(found.b, found.bounds_b),
                    lists(found.link_a[order] - starts_a[owner[order]], at), lists(found.link_b[order] - starts_b[owner[order]], at),
                    lists(cut_a - starts_a[of], cuts), lists(cut_b - starts_b[of], cuts),
                ]
                yield pa.record_batch([whole.column(0).slice(lo, hi - lo), *columns], names)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def summaries(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    found = common.written(blocks(docs, path_a, path_b, id_col, text_col, block_chars), "alignments")
    width = len(sides(path_a, path_b)[1].entries)
    counts = pair_counts(found, width).select("pair", "count", "best")
    shared = found.filter(F.col("pair").isNotNull()).select("block", "place", "pair").join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    documents = found.filter(F.col("pair").isNull()).drop("place", "pair", "n")
    id_type = found.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def total(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs.column("place").to_numpy())
        count, best = theirs.column("count").to_numpy()[order], theirs.column("best").to_numpy()[order].astype(np.int64)
        sums, bests = [], []
        for data in mine.column("packed").to_pylist():
            index, freq = _unpack(data)
            sums.append(int(count[index] @ freq))
            bests.append(int(best[index] @ freq))
        return pa.table([*(mine.column(c) for c in names[:5]), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), mine.column(names[-1])], names)

    schema = f"`{id_col}` {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(shared.groupBy("of")).applyInArrow(total, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return summaries(common.table(spark, sf_dir, "documents"), *paths)
