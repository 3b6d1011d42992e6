"""Codes proposed by vectors, crosswalks and families, and the gates that let them land."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.aggregates import top_value
from wayline.operators.joins import BLOCK_BYTES, BLOCK_ROWS, TASK_PAIRS, TILE_COLUMNS, TILE_ROWS, nearest
from wayline.sources.scratch import written

BLOCKS = 16  # of a side that ask for no larger ones


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_by_words(queries: DataFrame, reference: DataFrame, key: str, vector: str, text: str, k: int = 1) -> DataFrame:
    """``query``, ``neighbour``, ``similarity``, ``rank``: the nearest references all of whose words the query has, by cosine.

    Texts with the same words are one set. A reference's set meets those of queries on the word of its own that fewest of them
    have; only sets go through that join. The vectors of the sets that fit are dealt into blocks, as many as a set's rows ask
    for and small sets together; a task multiplies tiles and keeps ``k`` per query. References without words are left out.
    Vectors that are null, hold nulls or have no length have no similarity, nor have vectors of two lengths; they come last.
    """
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.trim(text)), " +")), "")
    length = lambda v: F.sqrt(_dot(v, v))
    fit = F.when(length(F.col(vector).cast("array<double>")) > 0, F.col(vector))
    side = lambda df: df.select(F.col(key).alias("id"), F.array_join(F.array_sort(words), " ").alias("s"), fit.alias("v")).filter("s <> ''")
    q, r = side(queries), side(reference)
    split = lambda c: F.split(c, " ")
    asked = q.groupBy("s").agg(F.count("*").alias("n_q"))
    has = asked.select(F.col("s").alias("s_q"), "n_q", F.explode(split("s")).alias("w"))
    common = has.groupBy("w").agg(F.count("*").alias("n"))
    named = r.groupBy("s").agg(F.count("*").alias("n_r")).select(F.col("s").alias("s_r"), "n_r", F.explode(split("s")).alias("w"))
    rarest = named.join(common, "w", "left").groupBy("s_r", "n_r").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("t"))
    met = has.join(rarest.select("s_r", "n_r", F.col("t.w").alias("w")), "w").filter(F.size(F.array_except(split("s_r"), split("s_q"))) == 0)
    fits = written(met.select("s_q", "s_r", "n_q", "n_r"), "word_sets")
    width = r.agg(F.max(F.size("v"))).head()[0] or 1
    rows = max(1_024, BLOCK_BYTES // (8 * max(1, width)))
    blocks = lambda n: F.ceil(F.col(n) / rows)
    sets = fits.groupBy("s_q", "n_q").agg(F.sum("n_r").alias("n_r")).select(F.col("s_q").alias("s"), "n_q", "n_r", blocks("n_q").alias("qn"), blocks("n_r").alias("rn"))
    sent, pairs = sets.agg(F.greatest(F.sum(F.col("n_q") * F.col("rn")), F.sum(F.col("n_r") * F.col("qn"))), F.sum(F.col("n_q").cast("double") * F.col("n_r"))).head()
    cells, tasks = max(1, -(-(sent or 0) // rows)), int((pairs or 0) // TASK_PAIRS) + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.pmod(F.xxhash64("s"), F.lit(cells)).alias("cell")
    mine = q.join(sets, "s").select("id", "s", "v", cell, F.pmod(F.xxhash64("id"), "qn").alias("qb"), every("rn").alias("rb"))
    meant = r.withColumnRenamed("s", "s_r").join(fits.select("s_r", F.col("s_q").alias("s")), "s_r").join(sets, "s")
    theirs = meant.select("id", "s", "v", cell, F.pmod(F.xxhash64("id"), "rn").alias("rb"), every("qn").alias("qb"))
    if tasks > 1:  # small in bytes, long in time
        mine, theirs = (x.repartition(tasks, "cell", "qb", "rb") for x in (mine, theirs))
    key_type = queries.schema[key].dataType.simpleString()

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, others = (t.column("id").to_numpy() for t in (mine, theirs))
        (values, widths, starts), (their_values, their_widths, their_starts) = _flat(mine), _flat(theirs)
        names = np.concatenate([t.column("s").to_numpy() for t in (mine, theirs)])
        at = np.unique(names, return_inverse=True)[1]
        groups, their_groups = at[: len(ids)], at[len(ids) :]
        order, by_id = np.lexsort((widths, groups)), np.lexsort((others, their_groups))
        cuts = np.flatnonzero(np.diff(groups[order]) | np.diff(widths[order])) + 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows in np.split(order, cuts):
            of = groups[rows[0]] if len(rows) else -1
            cols = by_id[np.searchsorted(their_groups[by_id], of) : np.searchsorted(their_groups[by_id], of, "right")]
            if not len(rows) or not len(cols):
                continue
            width = widths[rows[0]]
            able = (their_widths[cols] == width) & (width > 0)
            good = cols[able]
            a, b = _units(values, starts[rows], width), _units(their_values, their_starts[good], width)
            odd = None if np.isfinite(a).all() and np.isfinite(b).all() else 2.0
            i, j, score = nearest(ids[rows], a, others[good], b, k, True, odd)
            found.append((rows[i], good[j], np.where(score > 1.5, np.nan, score)))
            last = cols[~able][: max(0, k - len(good))]  # without a similarity, where others do not suffice
            found.append((np.repeat(rows, len(last)), np.tile(last, len(rows)), np.full(len(rows) * len(last), -np.inf)))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        id_type = mine.schema.field("id").type
        return pa.table({"query": pa.array(ids[i], id_type), "neighbour": pa.array(others[j], id_type), "similarity": pa.array(score, pa.float64(), mask=np.isneginf(score))})

    partial = mine.groupBy("cell", "qb", "rb").cogroup(theirs.groupBy("cell", "qb", "rb")).applyInArrow(block, f"query {key_type}, neighbour {key_type}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all vectors on end, and each vector's width and start; null is of width 0."""
    v = t.column("v").combine_chunks()
    widths = v.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return v.flatten().to_numpy(zero_copy_only=False), widths, np.cumsum(widths) - widths


def _units(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    v = values[starts[:, None] + np.arange(width)].astype(float)
    with np.errstate(invalid="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True) if width else v


def vector_proposals(df: DataFrame, key: str, own: Column, near: DataFrame, reference: DataFrame, label: str, least: float, rest: Column) -> DataFrame:
    """``value``, ``source``, ``similarity``: a row's own value, else its nearest reference's label from ``least`` on, else ``rest``.

    ``near`` has query, neighbour, similarity and rank; a row's own value is never replaced by a proposal.
    """
    first = near.filter("rank = 1").select(F.col("query").alias(key), F.col("neighbour").alias("wl_r"), F.col("similarity").alias("wl_s"))
    named = first.join(reference.select(F.col(key).alias("wl_r"), F.col(label).alias("wl_l")), "wl_r").drop("wl_r")
    j = df.withColumns({"wl_o": own, "wl_f": rest}).join(named, key, "left")
    near_enough = F.when(F.col("wl_s") >= least, F.col("wl_l"))
    source = F.when(F.col("wl_o").isNotNull(), "own").when(near_enough.isNotNull(), "proposed").when(F.col("wl_f").isNotNull(), "rest")
    return j.select(key, F.coalesce("wl_o", near_enough, "wl_f").alias("value"), source.alias("source"), F.when(source == "proposed", F.col("wl_s")).alias("similarity"))


def hybrid_codes(queries: DataFrame, key: str, title: str, description: str, candidates: DataFrame, codes: DataFrame, code: str, vector: str, plain: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key``, ``code``, ``title_term``, ``description_term``: the code of greatest title and description similarity, the least code on a tie.

    The title term is the greatest cosine to a code's ``candidates``, the description term the cosine to its row in ``codes``.
    Rows where ``plain`` holds go by the description alone. Rows without both vectors, and rows for which no code has a
    score, are left out. Codes and queries are dealt into blocks of ``block_rows``, of BLOCK_BYTES where that would make more
    than BLOCKS of them, and never more blocks of codes than codes; a task keeps the best code of its block per query.
    """
    code_type, key_type = codes.schema[code].dataType.simpleString(), queries.schema[key].dataType.simpleString()
    array = lambda c: F.col(c).cast("array<double>")
    terms = candidates.select(F.col(code).alias("c"), array(vector).alias("v"), F.lit(True).alias("title")).union(codes.select(code, array(vector), F.lit(False))).dropna()
    asked = queries.select(F.col(key).alias("id"), array(title).alias("t"), array(description).alias("d"), F.coalesce(plain if plain is not None else F.lit(False), F.lit(False)).alias("plain")).dropna()
    sizes = [df.count() for df in (asked, terms, codes)]
    width = terms.select(F.size("v")).head()
    wide = max(1_024, BLOCK_BYTES // (8 * max(1, width[0] if width else 1)))
    n, m = (max(1, min(-(-size // block_rows), max(BLOCKS, -(-size // wide)))) for size in sizes[:2])
    m = max(1, min(m, sizes[2]))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = asked.withColumns({"qb": F.pmod(F.xxhash64("id"), F.lit(n)), "rb": every(m)})
    right = terms.withColumns({"rb": F.pmod(F.xxhash64("c"), F.lit(m)), "qb": every(n)})
    tasks = min(n * m, -(-sizes[0] * sizes[1] // TASK_PAIRS))
    if tasks > 1:  # small in bytes, long in time
        left, right = (x.repartition(tasks, "qb", "rb") for x in (left, right))

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        v = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        schema = pa.schema([("id", mine.schema.field("id").type), ("c", theirs.schema.field("c").type), ("score", pa.float64()), ("title", pa.float64()), ("description", pa.float64())])
        theirs = theirs.take(np.argsort(theirs.column("c").to_numpy(), kind="stable"))
        is_title = theirs.column("title").to_numpy()
        described = theirs.filter(pa.array(~is_title))
        if not mine.num_rows or not described.num_rows:
            return schema.empty_table()
        names_of = described.column("c").to_pylist()
        at = {c: i for i, c in enumerate(names_of)}
        places = np.array([at.get(c, -1) if title else -1 for c, title in zip(theirs.column("c").to_pylist(), is_title, strict=True)], int)
        titled = theirs.filter(pa.array(places >= 0))
        places = places[places >= 0]
        ids, plain_rows = mine.column("id").to_pylist(), mine.column("plain").to_numpy()
        t, d, about = unit(mine.column("t")), unit(mine.column("d")), unit(described.column("v"))
        starts = np.flatnonzero(np.r_[True, np.diff(places) > 0]) if len(places) else []
        names = unit(titled.column("v")) if len(places) else None
        step = max(16, min(512, (TILE_ROWS * TILE_COLUMNS) // max(1, len(places))))
        out: dict[str, list] = {f: [] for f in schema.names}
        for lo in range(0, len(ids), step):
            by_text = np.round(d[lo : lo + step] @ about.T, 9)
            by_title = np.full(by_text.shape, -np.inf)
            if len(places):
                by_title[:, places[starts]] = np.round(np.maximum.reduceat(t[lo : lo + step] @ names.T, starts, axis=1), 9)
            score = np.where(plain_rows[lo : lo + step, None], by_text, by_title + by_text).round(9)
            for i, best in enumerate(score.argmax(1)):
                if score[i, best] > -np.inf:
                    term = by_title[i, best]
                    for name, value in zip(schema.names, (ids[lo + i], names_of[best], score[i, best], term if term > -np.inf else None, by_text[i, best]), strict=True):
                        out[name].append(value)
        return pa.table(out, schema)

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(block, f"id {key_type}, c {code_type}, score double, title double, description double")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "c", "title", "description")).alias("b"))
    return best.select(F.col("id").alias(key), F.col("b.c").alias(code), F.col("b.title").alias("title_term"), F.col("b.description").alias("description_term"))


def crosswalk_bridge(roles: DataFrame, key: str, code: str, support: str, major: str, crosswalk: DataFrame, label: str, score: str, major_of: Column, least: int = 3, prior: float = 0.3) -> DataFrame:
    """``label``, ``confidence``, ``source``: a role's label through its own code of ``least`` rows, else its major group's usual one.

    ``crosswalk`` has one row per ``code``; the prior of a major group is the label most of its codes map to. Others abstain.
    """
    usual = top_value(crosswalk.withColumn("wl_m", major_of), ["wl_m"], label).select("wl_m", F.col(label).alias("wl_p"))
    own = crosswalk.select(F.col(code).alias("wl_c"), F.col(label).alias("wl_l"), F.col(score).alias("wl_s"))
    j = roles.join(own, (F.col(code) == F.col("wl_c")) & (F.col(support) >= least), "left").join(usual, F.col(major) == F.col("wl_m"), "left")
    source = F.when(F.col("wl_l").isNotNull(), "code").when(F.col("wl_p").isNotNull(), "major").otherwise("abstain")
    confidence = F.when(source == "code", F.col("wl_s")).when(source == "major", prior).otherwise(0.0)
    return j.select(key, F.coalesce("wl_l", "wl_p").alias("label"), confidence.alias("confidence"), source.alias("source"))


def family_gate(populations: dict[str, DataFrame], family: str, stratum: str, anchor: str, gold: str, weight: str, least: int, bar: float, never: list[str]) -> DataFrame:
    """Per family and stratum and for each population of known rows: ``n``, precision of the family's anchor, the same by weight; ``landable``.

    A family lands in a stratum if every population has ``least`` rows and both precisions reach ``bar``. Rows without an
    anchor or a gold value don't count.
    """
    hit = F.col(anchor) == F.col(gold)
    tables = []
    for name, df in populations.items():
        g = df.filter(F.col(anchor).isNotNull() & F.col(gold).isNotNull()).groupBy(family, stratum)
        g = g.agg(F.count("*").alias(f"{name}_n"), F.avg(hit.cast("int")).alias("p"), F.try_divide(F.sum(F.when(hit, F.col(weight)).otherwise(0)), F.sum(weight)).alias("w"))
        tables.append(g.select(family, stratum, f"{name}_n", F.round("p", 6).alias(f"{name}_precision"), F.round("w", 6).alias(f"{name}_weighted")))
    j = reduce(lambda a, b: a.join(b, [family, stratum], "full"), tables).na.fill(0, [f"{name}_n" for name in populations])
    passes = [(F.col(f"{n}_n") >= least) & (F.col(f"{n}_precision") >= bar) & (F.col(f"{n}_weighted") >= bar) for n in populations]
    return j.withColumn("landable", F.coalesce(reduce(lambda a, b: a & b, passes), F.lit(False)) & ~F.col(family).isin(never))
