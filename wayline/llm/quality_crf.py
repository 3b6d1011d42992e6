"""Document quality from a conditional random field that labels every line good or bad.

A line is described by shares of kinds of bytes, lengths, and its likeness to lines of the same text; its neighbours'
descriptions are inputs too. The field learns from labelled documents, each line taking its document's mark. A
document's quality is the mean of its lines' forward-backward marginals weighted by their bytes, put through a logistic
curve fitted on the same rows.

Defined cases: a null text is the empty text, and an empty text is one empty line and gets a score like any other; rows
with equal ids each give their own row; labels that are null or without a document are not used; if no row is marked, or
all alike, every score is the share of good ones (0.5 if none); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.crf import CRF
from wayline.llm.optimise import minimise
from wayline.llm.spans import span_hashes

TRAIN_DOCS = 3_000  # labelled documents that the field is fitted on at most
BATCH_CHARS = 2_000_000  # of texts that are described together, beyond one
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b".,;:", b"!", b"?", b"|", b"#$%&*", b"'\"()[]{}<>", b"-_=+/\\@~^`")
_KIND = np.full(256, len(GROUPS), np.uint8)  # the last kind: bytes beyond ASCII and control characters
for _k, _group in enumerate(GROUPS):
    _KIND[list(_group)] = _k
KINDS = len(GROUPS) + 1
OWN = KINDS + 7


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features of all texts (own, before, after), lines per text, bytes per line."""
    own, lengths, sizes = lines(texts)
    return _with_neighbours(own, lengths), lengths, sizes


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, lines per text, bytes per line."""
    data = ("\n".join(texts)).encode("utf-8", "surrogatepass")
    lengths = np.array([t.count("\n") + 1 for t in texts], np.int64)
    buffer = np.frombuffer(data + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    kinds = _KIND[buffer]
    safe = np.maximum(sizes, 1)
    own = np.empty((len(starts), OWN), np.float64)
    counted = np.empty(len(buffer) + 1, np.int32)
    counted[0] = 0
    for k in range(KINDS):
        np.cumsum(kinds == k, out=counted[1:], dtype=np.int32)
        own[:, k] = (counted[ends] - counted[starts]) / safe
    spaces = kinds == 3
    np.cumsum(spaces[1:] & ~spaces[:-1], out=counted[2:], dtype=np.int32)
    counted[1] = 0
    words = np.maximum(counted[ends] - counted[starts], 0) + 1
    own[:, KINDS] = np.log1p(sizes) / 5
    own[:, KINDS + 1] = np.minimum(sizes / words, 40) / 10
    own[:, KINDS + 2] = sizes == 0
    own[:, KINDS + 3] = np.log1p(words) / 5
    own[:, KINDS + 4 :] = _repeats(buffer, starts, ends, lengths)
    return own, lengths, sizes


def _repeats(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per line: whether it stands more than once in its text, the share of such lines in the text, and the share of its
    words that repeat the word before."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    keys = span_hashes(buffer, starts, ends)
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    share = np.add.reduceat(twice, np.cumsum(lengths) - lengths) / lengths
    blank = np.concatenate([[True], (buffer == 32) | (buffer == 10)])
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    last = np.flatnonzero(~blank[:-1] & blank[1:])
    words = span_hashes(buffer, first, last)
    line = np.searchsorted(ends, first, side="left")
    again = np.zeros(len(first), bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    repeated = np.bincount(line[again], minlength=len(starts)) / np.maximum(np.bincount(line, minlength=len(starts)), 1)
    return np.stack([twice, share[text], repeated], 1)


def _with_neighbours(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts = np.cumsum(lengths) - lengths
    before[starts], after[starts + lengths - 1] = 0, 0
    return np.concatenate([own, before, after], 1)


@dataclass
class QualityModel:
    field: CRF | None
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.field is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.shift)))
        own, lengths, sizes = lines(texts)
        odds = evidence(self.field.marginals_of(_emissions(self.field, own, lengths), lengths), lengths, sizes)
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift)))


def _emissions(field: CRF, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label scores of all lines: as of ``_with_neighbours``, which would take three times the memory."""
    mine, before, after = np.split(field.weights[:-1], 3)
    starts = np.cumsum(lengths) - lengths
    emit = own @ mine + field.weights[-1]
    from_before, from_after = (own @ before)[:-1], (own @ after)[1:]
    inner = np.ones(len(own), bool)
    inner[starts] = False
    emit[1:][inner[1:]] += from_before[inner[1:]]
    emit[:-1][inner[1:]] += from_after[inner[1:]]
    return emit


def evidence(marginals: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of "good" in each text."""
    good = marginals[:, 1]
    weight = sizes + 1.0
    starts = np.cumsum(lengths) - lengths
    mean = np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, limit: int) -> DataFrame:
    """(text, mark, id) of at most ``limit`` labelled documents outside the held-out third, chosen by a hash of their id."""
    key = F.col(id_col).cast("string")
    marked = (
        labels.filter(F.col(label_col).isNotNull() & (F.crc32(key) % 3 != 1))
        .select(F.col(id_col).alias("wl_id"), F.col(label_col).cast("int").alias("wl_mark"))
        .orderBy(F.md5(key), "wl_mark")
        .limit(limit)
    )
    rows = common.id_and_text(docs, id_col)
    return rows.join(F.broadcast(marked), F.col(id_col) == F.col("wl_id")).select(F.col("text").alias("wl_text"), "wl_mark", "wl_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", limit: int = TRAIN_DOCS) -> QualityModel:
    """Line descriptions are made in the tasks; those of at most ``limit`` labelled documents come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, lengths, sizes = describe([batch.column(0)[row].as_py()])
                yield pa.record_batch([pa.array([batch.column(1)[row].as_py()], pa.int32()), pa.array([batch.column(2)[row].as_py()], pa.int64()), pa.array([x.astype(np.float32).tobytes()]), pa.array([sizes.astype(np.int64).tobytes()])], ["mark", "id", "x", "sizes"])

    rows = training_rows(docs, labels, label_col, id_col, limit).mapInArrow(run, "mark int, id long, x binary, sizes binary").collect()
    marks = np.array([r.mark for r in rows])
    if len(set(marks.tolist())) < 2:
        share = min(max(float(marks.mean()) if len(marks) else 0.5, 1e-3), 1 - 1e-3)
        return QualityModel(None, 0.0, float(np.log(share / (1 - share))))
    rows.sort(key=lambda r: (r.id, r.mark, r.x))
    marks = np.array([r.mark for r in rows])
    sizes = [np.frombuffer(r.sizes, np.int64) for r in rows]
    lengths = np.array([len(s) for s in sizes])
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, 3 * OWN) for r in rows]).astype(np.float64)
    field = CRF.fit(x, np.repeat(marks, lengths), lengths, l2=1.0, steps=60)
    odds = evidence(field.marginals(x, lengths), lengths, np.concatenate(sizes))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * odds + p[1]
        error = 1 / (1 + np.exp(-z)) - marks
        value = np.logaddexp(0, z).sum() - (marks * z).sum() + 0.05 * p[0] ** 2
        return float(value) / len(z), np.array([error @ odds + 0.1 * p[0], error.sum()]) / len(z)

    slope, shift = minimise(loss, np.array([1.0, 0.0]))
    return QualityModel(field, float(slope), float(shift))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with all their columns, and ``name``: the quality from 0 to 1."""
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = [t or "" for t in whole.column(text_col).to_pylist()]
            for lo, hi in common.by_size(texts, 512, BATCH_CHARS):
                batch = whole.slice(lo, hi - lo)
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(model.scores(texts[lo:hi]), pa.float64())], [*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema), f"`{name}` double"])
    return docs.select(kept).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents whose quality is 0.5 or more, with their columns as they are."""
    name = common.unused(docs.columns, "wl_score")
    return score(docs, model, text_col, name).filter(F.col(name) >= 0.5).select(docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
