"""The vector search deals its work out by pairs of vectors, and keeps ties over tiles."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import joins


def test_pairs_of_blocks_get_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 64)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<float>")
    a, b = joins._block_pairs(df, df, "id", "v", 8)
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 25
    assert a.schema["v"].dataType == df.schema["v"].dataType


def test_nearest_over_tiles_with_ties(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE_ROWS", 4)
    monkeypatch.setattr(joins, "TILE_COLUMNS", 5)
    x = np.random.default_rng(2).integers(-2, 3, (40, 3)).astype(float) + [0.0, 0.0, 0.5]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:6]}
    got = joins.nearest_vectors(df, df, "id", "v", 6).collect()
    assert {(r.query, r.neighbour) for r in got} == want and len(got) == 240


def test_pairs_of_blocks_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 25)  # a quarter of a pair of blocks
    df = spark.range(80).select(F.col("id"), F.array(F.lit(1.0)).alias("v"))
    left, _ = joins._block_pairs(df, df, "id", "v", 10)
    pairs = left.select("qb", "rb", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(pairs) == 64 and max(Counter(r.task for r in pairs).values()) <= 2
