"""Joins of entity histories: mappings, ladders, intervals, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_values(df: DataFrame, mapping: DataFrame, on: dict[str, str], take: list[str]) -> DataFrame:
    """Left join of a mapping by null-safe equality; ``on`` names df's column for each of the mapping's keys.

    Spark broadcasts the mapping if it is small by its own measure, else shuffles both sides on the keys.
    """
    m = mapping.select(*(F.col(k).alias(f"wl_{k}") for k in on.values()), *take)
    condition = None
    for left, right in on.items():
        part = df[left].eqNullSafe(m[f"wl_{right}"])
        condition = part if condition is None else condition & part
    return df.join(m, condition, "left").drop(*(f"wl_{k}" for k in on.values()))


def fallback_ladder(df: DataFrame, steps: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Join dimensions from specific to general; ``value`` of the first that has the row's key.

    A step is (df's column, dimension with that key and ``value``, source label).
    """
    out, values = df, []
    for k, (key, dimension, label) in enumerate(steps):
        out = out.join(dimension.select(F.col(key), F.col(value).alias(f"wl_v{k}")), key, "left")
        values.append((label, F.col(f"wl_v{k}")))
    source = F.lit(None).cast("string")
    for label, v in reversed(values):
        source = F.when(v.isNotNull(), F.lit(label)).otherwise(source)
    out = out.withColumns({value: F.coalesce(*(v for _, v in values)), f"{value}_source": source})
    return out.drop(*(f"wl_v{k}" for k in range(len(steps))))


def one_per_key(df: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """The right side of a join without fan-out: the least value of each column per key."""
    return df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in take))


def dominated_intervals(df: DataFrame, entity: str, row: str, start: str, end: str, rank: list[Column], share: float = 0.5) -> DataFrame:
    """Add ``dominated``: another row of the entity shares ``share`` or more of the shorter interval's days and outranks it.

    ``rank`` goes from the most to the least weighty, larger is better; the lower row wins what is left of ties. Rows meet by
    entity and by the calendar years that both touch, so a long history is not compared with itself as a whole;
    bound an entity's rows first (``bounded_entities``) where one may hold a share of the table.
    """
    days = F.datediff(F.col(end), F.col(start)) + 1
    mine = df.select(
        F.col(entity).alias("wl_entity"), F.col(row).alias("wl_row"), F.col(start).alias("wl_s"), F.col(end).alias("wl_e"), days.alias("wl_days"),
        F.struct(*(c.alias(f"r{k}") for k, c in enumerate(rank)), (-F.col(row)).alias("row")).alias("wl_rank"),
    ).withColumn("wl_year", F.explode(F.sequence(F.year("wl_s"), F.greatest(F.year("wl_s"), F.year("wl_e")))))
    a, b = mine.alias("a"), mine.alias("b")
    shared = F.datediff(F.least("a.wl_e", "b.wl_e"), F.greatest("a.wl_s", "b.wl_s")) + 1
    met = a.join(b, (F.col("a.wl_entity") == F.col("b.wl_entity")) & (F.col("a.wl_year") == F.col("b.wl_year")) & (F.col("b.wl_rank") > F.col("a.wl_rank")))
    hit = met.filter(shared >= share * F.least("a.wl_days", "b.wl_days")).select(F.col("a.wl_row").alias("wl_row")).distinct()
    return df.join(hit.withColumn("dominated", F.lit(True)), F.col(row) == F.col("wl_row"), "left").drop("wl_row").na.fill({"dominated": False})


def active_at(df: DataFrame, anchors: DataFrame, entity: str, start: str, end: str, at: Column, order: list[Column]) -> DataFrame:
    """The row of each anchored entity that is active at ``at``, the first by ``order``."""
    w = Window.partitionBy(entity).orderBy(*order)
    inside = df.join(anchors, entity).filter((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) >= at)))
    return inside.withColumn("wl_rn", F.row_number().over(w)).filter("wl_rn = 1").drop("wl_rn")


def lagged_states(panel: DataFrame, entity: str, year: str, state: str, lag: int = 1) -> DataFrame:
    """``n`` entities per (year, from, to), the diagonal included."""
    later = panel.select(entity, (F.col(year) - lag).alias(year), F.col(state).alias("to_state"))
    pairs = panel.select(entity, year, F.col(state).alias("from_state")).join(later, [entity, year])
    return pairs.groupBy(year, "from_state", "to_state").agg(F.count("*").alias("n"))


def within_window(events: DataFrame, anchors: DataFrame, entity: str, at: Column, anchor: str, low: int, high: int) -> DataFrame:
    """Events whose time lies between ``low`` and ``high`` after the entity's anchor."""
    return events.join(anchors, entity).filter((at - F.col(anchor)).between(low, high))


def unique_core(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for one value only; ambiguous ones are dropped."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("wl_n")).filter("wl_n = 1").drop("wl_n")


def token_neighbours(left: DataFrame, right: DataFrame, key: str, text: str, least: float, k: int) -> DataFrame:
    """For each left value its ``k`` best right values by Jaccard of word sets, ``least`` or more, equal texts excluded.

    An inverted index: both sides are joined on words, so only values that share one meet. A value that shares a word with
    ``least`` overlap must share one of its rarest words, which keeps frequent words out of the join. Texts meet once however
    many rows have them: of the best right texts, the ``k`` least keys each are all that can be among a value's ``k`` best.
    """
    ka, kb = f"{key}_a", f"{key}_b"

    def texts(df: DataFrame, suffix: str) -> DataFrame:
        one = df.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(f"{key}_{suffix}"))
        return one.select(f"{key}_{suffix}", F.col(text).alias(f"{text}_{suffix}"), F.array_distinct(F.split(F.lower(F.col(text)), " ")).alias(f"t_{suffix}"))

    a, b = texts(left, "a"), texts(right, "b")
    words = a.select(F.explode("t_a").alias("w")).union(b.select(F.explode("t_b").alias("w"))).groupBy("w").agg(F.count("*").alias("wl_n"))

    def rare(df: DataFrame, suffix: str) -> DataFrame:
        """The rarest words of a value, one more than it may miss; only its key and size go along."""
        w = Window.partitionBy(f"{key}_{suffix}").orderBy("wl_n", "w")
        out = df.select(f"{key}_{suffix}", F.size(f"t_{suffix}").alias(f"size_{suffix}"), F.explode(f"t_{suffix}").alias("w"))
        out = out.join(words, "w").withColumn("wl_rn", F.row_number().over(w))
        return out.filter(F.col("wl_rn") <= F.col(f"size_{suffix}") - F.ceil(F.col(f"size_{suffix}") * least - 1e-9) + 1).drop("wl_n").withColumnRenamed("wl_rn", f"at_{suffix}")

    # Few words in few bytes, but many meetings: Spark would merge them into a task or two.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rare(a, "a").repartition(tasks, "w").join(rare(b, "b").repartition(tasks, "w"), "w").filter(F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9)
    # Both sides are in one order, so from the first shared word on no more can be shared than either has left; only pairs that meet early enough go on.
    most = 1 + F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    able = met.filter(most >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9).select(ka, kb).repartition(tasks, ka, kb).distinct()
    pairs = able.join(a, ka).join(b, kb)
    pairs = pairs.filter(F.col(f"{text}_a") != F.col(f"{text}_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    pairs = pairs.withColumn("jaccard", both / (F.size("t_a") + F.size("t_b") - both)).filter(F.col("jaccard") >= least)
    first = Window.partitionBy(f"{text}_a").orderBy(F.desc("jaccard"), kb)
    pairs = pairs.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select(f"{text}_a", f"{text}_b", "jaccard")
    keys = right.select(F.col(text).alias(f"{text}_b"), F.col(key).alias(kb)).withColumn("wl_rn", F.row_number().over(Window.partitionBy(f"{text}_b").orderBy(kb)))
    pairs = pairs.join(keys.filter(F.col("wl_rn") <= k).drop("wl_rn"), f"{text}_b")
    best = pairs.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return left.select(F.col(key).alias(ka), F.col(text).alias(f"{text}_a")).join(best, f"{text}_a").select(ka, kb, "jaccard", "rank")


BLOCK_ROWS = 4_096  # titles of either side that a task holds
BLOCK_BYTES = 8 << 20  # of vectors of either side, as doubles, that a task holds: the larger, the less often a vector is sent and the longer the task
TASK_PAIRS = 1 << 26  # pairs of vectors that are worth a task of their own
LINK_ROWS = 16_384  # vectors of either side where a task marks all pairs, a byte each
TILE_ROWS, TILE_COLUMNS = 512, 8_192  # of the scores that it has at a time
FIRST_COLUMNS = 256  # of its first tile, whose best are sorted out in full and bound what counts in later ones


def _block_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt into blocks of about ``block_rows`` (else of BLOCK_BYTES) and repeated for every block of the other: as many blocks as the rows ask for."""
    sides = [df.select(F.col(key).alias("id"), F.col(vector).alias("v")) for df in (left, right)]
    if block_rows is None:
        width = sides[1].select(F.size("v")).filter("size(v) > 0").head()
        block_rows = max(1_024, BLOCK_BYTES // (8 * (width[0] if width else 1)))
    sizes = [df.count() for df in (left, right)]
    n, m = (max(1, -(-size // block_rows)) for size in sizes)
    tasks = -(-sizes[0] * sizes[1] // TASK_PAIRS)  # more than pairs of large blocks, which a hash then deals out more evenly; empty ones cost nothing
    a = sides[0].withColumns({"qb": F.pmod(F.xxhash64("id"), F.lit(n)), "rb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})
    b = sides[1].withColumns({"rb": F.pmod(F.xxhash64("id"), F.lit(m)), "qb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))})
    if tasks > 1:  # small in bytes, long in time: Spark would deal all pairs of blocks into a few tasks
        a, b = (x.repartition(tasks, "qb", "rb") for x in (a, b))
    return a, b


def nearest_vectors(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int, block_rows: int | None = None, keep_self: bool = False) -> DataFrame:
    """``k`` nearest reference vectors of each query by cosine, exactly: every query against all rows, in blocks.

    Both sides are dealt into blocks of about ``block_rows`` (by default as many as a task can hold); a task multiplies tiles of one block of queries by one of
    references and keeps ``k`` per query, and the partial lists are merged.
    """
    key_type = queries.schema[key].dataType.simpleString()
    q, r = _block_pairs(queries, reference, key, vector, block_rows)

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, a = _unit(mine)
        others, b = _unit(theirs)
        i, j, score = nearest(ids, a, others, b, k, keep_self)
        id_type = mine.schema.field("id").type
        return pa.table({"query": pa.array(ids[i], id_type), "neighbour": pa.array(others[j], id_type), "similarity": pa.array(score, pa.float64())})

    partial = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(block, f"query {key_type}, neighbour {key_type}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, keep_self: bool, undefined: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the ``k`` best of each row by products, in tiles; products that are no numbers count as ``undefined``."""
    rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(ids), TILE_ROWS):
        mine_ids, edge = ids[lo : lo + TILE_ROWS], None
        i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = min(TILE_COLUMNS, max(FIRST_COLUMNS, 16 * k))
        for co, upto in [(0, first), *((c, c + TILE_COLUMNS) for c in range(first, len(others), TILE_COLUMNS))]:
            raw = a[lo : lo + TILE_ROWS] @ b[co:upto].T
            if undefined is not None:
                raw = np.where(np.isnan(raw), undefined, raw)
            if edge is None:
                ti, tj, ts = _best(raw, mine_ids, others[co:upto], k, keep_self)
            else:  # of later tiles, only what comes up to a row's k-th best, before rounding
                ti, tj = np.nonzero(raw >= edge[:, None] - 1e-9)
                other = np.ones(len(ti), bool) if keep_self else mine_ids[ti] != others[co + tj]
                ti, tj = ti[other], tj[other]
                ts = np.round(raw[ti, tj], 9)
            i, j, score = np.concatenate([i, ti]), np.concatenate([j, tj + co]), np.concatenate([score, ts])
            order = np.lexsort((others[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            i, j, score, last = i[place < k], j[place < k], score[place < k], place[place < k] == k - 1
            edge = np.full(len(mine_ids), -np.inf)
            edge[i[last]] = score[last]
        rows.append(i + lo)
        cols.append(j)
        scores.append(score)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _best(score: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, keep_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of a tile's ``k`` best of each row, and of what ties with the last of them."""
    score = np.round(score, 9)
    if not keep_self:
        score[ids[:, None] == others[None, :]] = -np.inf
    at = max(0, score.shape[1] - k)
    edge = np.partition(score, at, axis=1)[:, at]
    i, j = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
    return i, j, score[i, j]


def similar_vector_links(vectors: DataFrame, key: str, vector: str, least: float, block_rows: int = LINK_ROWS) -> DataFrame:
    """``a``, ``b``: links whose connected components are those of all pairs of that cosine or more.

    Every pair is looked at, in pairs of blocks; a task returns a forest of its pairs, not the pairs.
    """
    key_type = vectors.schema[key].dataType.simpleString()
    left, right = _block_pairs(vectors, vectors, key, vector, block_rows)

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, a = _unit(mine)
        others, b = _unit(theirs)
        if not len(ids) or not len(others):
            i = j = np.zeros(0, np.int64)
        else:
            near = np.empty((len(a), len(b)), bool)
            for lo in range(0, len(a), 128):
                np.greater_equal(np.round(a[lo : lo + 128] @ b.T, 9), least, out=near[lo : lo + 128])
            label, far = np.arange(len(others)), len(others)  # of theirs; mine take the least around, until nothing changes
            while True:
                around = np.concatenate([np.where(near[lo : lo + 128], label[None, :], far).min(1) for lo in range(0, len(a), 128)])
                new = np.concatenate([np.where(near[:, lo : lo + 128], around[:, None], far).min(0) for lo in range(0, len(b), 128)])
                new = np.minimum(label, new)
                if (new == label).all():
                    break
                label = new
            i = np.flatnonzero(around < far)
            j = around[i]
            used = np.flatnonzero(near.any(0))
            hub = np.full(far, -1)
            hub[j[::-1]] = i[::-1]  # one of mine for every component
            i, j = np.concatenate([i, hub[label[used]]]), np.concatenate([j, used])
        id_type = mine.schema.field("id").type
        return pa.table({"a": pa.array(ids[i], id_type), "b": pa.array(others[j], id_type)})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(block, f"a {key_type}, b {key_type}").filter("a <> b").distinct()


def _unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    v = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
    return t.column("id").to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
