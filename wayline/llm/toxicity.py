"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are a text's words and the beginnings of its words, which words of one stem share. Grades: 0 for a document
marked clean; 1 to 3 for a marked one, by the tercile of how many of its features the marked rows hold far more often than
the clean ones. One weight per feature is shared by the three ordered thresholds: P(grade > k) = sigmoid(w x - theta_k).
The expected severity is the sum of the three probabilities; a document is toxic if P(grade > 0) is 0.5 or more. Features
are counted by Spark over a bounded sample of labelled rows (TRAIN_DOCS), those with the strongest evidence are kept, and
the fit uses the same rows.

Defined cases: a null text is the empty text, and an empty text has no features and its grade's base rate; rows with equal
ids each give their own row; labels that are null or without a document are not used; without marked or clean rows every
severity is 0; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.optimise import minimise
from wayline.llm.quality_crf import training_rows
from wayline.llm.wu_manber import words

TRAIN_DOCS = 6_000  # labelled documents that are counted and fitted at most
FEATURES = 2_000  # words and beginnings with the strongest evidence
STEMS = (4, 5, 6, 7)  # characters of a word's beginnings that are features beside the word
GRADES = 4


@dataclass
class SeverityModel:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, one less than grades

    def severities(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        used = lru_cache(200_000)(lambda word: tuple(filter(self.weights.__contains__, forms(word))))
        pull = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: dict[str, int] = {}
            for word, n in Counter(words(text)).items():
                for form in used(word):
                    found[form] = found.get(form, 0) + n
            pull[i] = sum(self.weights[form] * math.log1p(n) for form, n in sorted(found.items()))
        return 1 / (1 + np.exp(self.thresholds - pull[:, None]))


def forms(word: bytes) -> list[str]:
    """A word's features: itself, and its beginnings of STEMS characters, which words of one stem share."""
    w = word.decode("utf-8", "replace")
    return [w, *(f"{w[:k]}*" for k in STEMS if len(w) > k)]


def _word_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, limit: int) -> DataFrame:
    """Labelled rows as their distinct words and counts, made in the tasks and kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Counter(f for w in words(t) for f in forms(w)) for t in batch.column(0).to_pylist()]
            held = [list(r) for r in rows]
            yield pa.record_batch([batch.column(1), batch.column(2).cast(pa.int64()), pa.array(held, pa.list_(pa.string())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], ["mark", "id", "held", "n"])

    rows = training_rows(docs, labels, label_col, id_col, limit)
    return common.written(rows.mapInArrow(run, "mark int, id long, held array<string>, n array<int>"), "words")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", limit: int = TRAIN_DOCS, features: int = FEATURES) -> SeverityModel:
    rows = _word_rows(docs, labels, label_col, id_col, limit)
    totals = {r["mark"]: r["count"] for r in rows.groupBy("mark").count().collect()}
    marked, clean = sum(n for m, n in totals.items() if m > 0), totals.get(0, 0)
    if not marked or not clean:
        return SeverityModel({}, np.full(GRADES - 1, 50.0))
    per_word = rows.select("mark", F.explode("held").alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("mark") > 0, 1)).alias("a"), F.count(F.when(F.col("mark") == 0, 1)).alias("b")
    )
    odds = F.log((F.col("a") + 0.5) / (marked + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = per_word.filter(F.col("a") + F.col("b") >= 3).select("word", odds.alias("odds"), strength.alias("z")).orderBy(F.desc("z"), "word").limit(features).collect()
    place = {r.word: i for i, r in enumerate(chosen)}
    telling = {r.word for r in chosen if r.odds > 2 and r.z > 3}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            kept = [[(place[w], k) for w, k in zip(held, n, strict=True) if w in place] for held, n in rows]
            index, counts = ([[p[i] for p in row] for row in kept] for i in (0, 1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(index, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["mark", "id", "places", "n"])

    found = rows.mapInArrow(sparse, "mark int, id long, places array<int>, n array<int>").collect()  # at most ``limit`` rows
    found.sort(key=lambda r: (r.id, r.mark, r.places, r.n))
    words_of = list(place)
    x = np.zeros((len(found), len(place)))
    weight = np.zeros(len(found))
    for i, r in enumerate(found):
        for j, n in zip(r.places, r.n, strict=True):
            x[i, j] = math.log1p(n)
            weight[i] += n * (words_of[j] in telling)
    mark = np.array([r.mark for r in found]) > 0
    cuts = np.quantile(weight[mark], [1 / 3, 2 / 3])
    grade = np.where(mark, 1 + (weight[:, None] > cuts).sum(1), 0)
    w, thresholds = fit_ordinal(x, grade, GRADES)
    return SeverityModel({word: float(w[i]) for word, i in place.items() if abs(w[i]) > 1e-4}, thresholds)


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, l2: float = 0.5, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by penalised maximum likelihood; gaps between thresholds are exponentials."""
    k = grades - 1
    rows = np.arange(len(x))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, first, gaps = p[: x.shape[1]], p[x.shape[1]], np.exp(p[x.shape[1] + 1 :])
        theta = first + np.concatenate([[0], np.cumsum(gaps)])
        below = 1 / (1 + np.exp(-np.clip(theta - (x @ w)[:, None], -60, 60)))  # P(grade <= k)
        edges = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], 1)
        chance = np.maximum(edges[rows, grade + 1] - edges[rows, grade], 1e-12)
        steep = below * (1 - below)
        d_theta = np.zeros((len(x), k))  # of the log likelihood
        for j in range(k):
            d_theta[:, j] = steep[:, j] / chance * ((grade == j).astype(float) - (grade == j + 1))
        d_w = -(x.T @ d_theta.sum(1))
        total = d_theta.sum(0)
        d_gaps = np.array([total[j:].sum() for j in range(1, k)]) * gaps
        slope = -np.concatenate([d_w, [total.sum()], d_gaps])
        slope[: x.shape[1]] += l2 * w
        return float(-np.log(chance).sum() + l2 / 2 * (w @ w)) / len(x), slope / len(x)

    p = minimise(loss, np.concatenate([np.zeros(x.shape[1]), [1.0], np.full(k - 1, -1.0)]), steps)
    return p[: x.shape[1]], p[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(p[x.shape[1] + 1 :]))])


def score(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, expected ``severity`` (0 to 3), most likely ``grade``, ``p_toxic`` and ``toxic``."""
    rows = common.id_and_text(docs, id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                above = model.severities(batch.column(1).to_pylist())
                edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
                grade = (edges[:, :-1] - edges[:, 1:]).argmax(1)
                yield pa.record_batch([batch.column(0), pa.array(above.sum(1)), pa.array(grade, pa.int32()), pa.array(above[:, 0])], [id_col, "severity", "grade", "p_toxic"])

    scored = rows.mapInArrow(run, f"`{id_col}` {id_type}, severity double, grade int, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
