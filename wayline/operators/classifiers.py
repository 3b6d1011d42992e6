"""Classifiers of entities: neighbours' votes, ensembles, mined words, overrides, clusters of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.aggregates import top_value
from wayline.operators.components import connected_components
from wayline.operators.joins import similar_vector_links
from wayline.sources.scratch import discard, written


def neighbour_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str, floor: float) -> DataFrame:
    """Per query the label of greatest summed similarity (the least on a tie), null below a share of ``floor``."""
    votes = neighbours.join(labels.select(F.col(key).alias("neighbour"), label), "neighbour")
    top = top_value(votes, ["query"], label, F.round("similarity", 6))
    share = F.try_divide(F.round("support", 6), F.round("total", 6))
    return top.select("query", F.when(share >= floor, F.col(label)).alias("predicted"), F.round(share, 4).alias("share"))


def leave_one_out_sweep(neighbours: DataFrame, labels: DataFrame, key: str, label: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy of the nearest other item's label at each least similarity."""
    nearest = neighbours.filter("rank = 1").join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("p")), "neighbour")
    known = nearest.join(labels.select(F.col(key).alias("query"), F.col(label).alias("g")), "query")
    grid = known.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    sure = F.col("similarity") >= F.col("threshold")
    out = grid.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(sure).alias("c"), F.count_if(sure & (F.col("p") == F.col("g"))).alias("r"))
    return out.select("threshold", F.round(F.col("c") / F.col("n"), 6).alias("coverage"), F.round(F.try_divide("r", "c"), 6).alias("accuracy"))


def ensemble_vote(votes: DataFrame, item: str, label: str) -> DataFrame:
    """The label with most votes; null where two labels share the lead."""
    counts = votes.filter(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(item).agg(F.max("n").alias("m"))
    lead = counts.join(best, item).filter("n = m").groupBy(item, "m").agg(F.count("*").alias("k"), F.min(label).alias("l"))
    return lead.select(item, F.when(F.col("k") == 1, F.col("l")).alias("decided"), F.col("m").alias("votes"))


def tie_break(votes: DataFrame, item: str, code: str, confidence: str, anchors: DataFrame, anchor: str) -> DataFrame:
    """For items without one code: the most confident vote, else the anchor's if it was voted for."""
    split = votes.groupBy(item).agg(F.count_distinct(code).alias("k")).filter("k > 1").select(item)
    open_votes = votes.join(split, item, "left_semi")
    best = open_votes.groupBy(item).agg(F.max(confidence).alias("b"))
    top = open_votes.join(best, item).filter(F.col(confidence) == F.col("b")).groupBy(item).agg(F.count_distinct(code).alias("k"), F.min(code).alias("c"))
    voted = open_votes.join(anchors, item).filter(F.col(code) == F.col(anchor)).select(item, F.col(anchor).alias("a")).distinct()
    j = top.join(voted, item, "left")
    rule = F.when(F.col("k") == 1, "confidence").when(F.col("a").isNotNull(), "anchor").otherwise("open")
    return j.select(item, F.when(F.col("k") == 1, F.col("c")).otherwise(F.col("a")).alias("decided"), rule.alias("rule"))


def head_word_lexicon(df: DataFrame, text: str, label: str, share: float, support: int) -> DataFrame:
    """Last words that stand for one label in at least ``share`` of their rows."""
    heads = df.select(F.element_at(F.split(F.lower(F.col(text)), " "), -1).alias("head"), label)
    top = top_value(heads, ["head"], label)
    return top.filter((F.col("support") >= share * F.col("total")) & (F.col("total") >= support)).select("head", label, "support", "total")


def overrides(df: DataFrame, key: str, current: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Rows whose first fitting rule changes an empty or equal-major value: key, new value, reason."""
    value, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, fits, new in reversed(rules):
        value, reason = F.when(fits, new).otherwise(value), F.when(fits, name).otherwise(reason)
    out = df.select(key, current, value.alias("override"), reason.alias("reason")).filter("override IS NOT NULL")
    same_major = F.left(F.col(current), F.lit(1)) == F.left("override", F.lit(1))
    return out.filter(F.col(current).isNull() | (same_major & (F.col(current) != F.col("override")))).select(key, "override", "reason")


def vector_clusters(vectors: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """Each key's cluster: components of all pairs of at least that cosine; others are their own."""
    groups = connected_components(similar_vector_links(vectors, key, vector, least), "a", "b")
    return vectors.select(key).join(groups, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("cluster"))


def knn_graph(neighbours: DataFrame) -> DataFrame:
    """Symmetric weighted edges: similarities of both directions added, log-weighted."""
    both = neighbours.select(F.col("query").alias("src"), F.col("neighbour").alias("dst"), "similarity")
    both = both.union(both.select("dst", "src", "similarity"))
    return both.groupBy("src", "dst").agg(F.round(F.sum(F.log1p("similarity")), 6).alias("weight"))


WHOLE = 64  # nodes up to which the products of all profiles are that small matrix


def spectral_embedding(edges: DataFrame, dim: int, spare: int = 8, tolerance: float = 1e-7, rounds: int = 100) -> DataFrame:
    """``node``, ``vector`` of length 1: nodes by the truncated singular vectors of their row-normalised out and in profiles.

    Subspace iteration with ``spare`` further directions: a round is two joins of the edges with a few numbers per node, and
    only the small matrix of their products reaches the driver. It ends where no singular value moves by more than the
    tolerance of the greatest; an error if they still do. Values close to each other part slowly; where nodes are few, the
    products of all their profiles are taken instead, which is exact. Signs make each direction's sum positive; missing directions are 0.
    """
    total = lambda end: edges.join(edges.groupBy(end).agg(F.sum("weight").alias("t")), end)
    share = (F.col("weight") / F.col("t")).alias("v")
    cells = total("src").select(F.col("src").alias("node"), F.struct(F.lit("o").alias("side"), F.col("dst").alias("other")).alias("c"), share)
    cells = written(cells.union(total("dst").select("dst", F.struct(F.lit("i"), F.col("src")), share)), "cells")
    unit = lambda v: F.transform(v, lambda x: F.round(F.coalesce(F.try_divide(x, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))), F.lit(0.0)), 6)).alias("vector")
    every = cells.select("node").distinct()
    nodes = [r.node for r in every.limit(WHOLE + 1).collect()]
    if len(nodes) <= WHOLE:
        met = cells.join(cells.select(F.col("node").alias("b"), "c", F.col("v").alias("w")), "c")
        at, whole = {n: i for i, n in enumerate(nodes)}, np.zeros((len(nodes), len(nodes)))
        for r in met.groupBy("node", "b").agg(F.sum(F.col("v") * F.col("w")).alias("p")).collect():
            whole[at[r.node], at[r.b]] = r.p
        values, axes = np.linalg.eigh((whole + whole.T) / 2)
        good = [i for i in np.argsort(-values)[:dim] if values[i] > 1e-12 * values.max()]
        found = axes[:, good] * np.sqrt(values[good])
        found = np.hstack([np.where(found.sum(0) < 0, -found, found), np.zeros((len(nodes), dim - len(good)))])
        rows = [(n, [float(x) for x in v]) for n, v in zip(nodes, found, strict=True)]
        return edges.sparkSession.createDataFrame(rows, f"node {cells.schema['node'].dataType.simpleString()}, v array<double>").select("node", unit(F.col("v")))
    k = dim + spare
    start = every.select("node", *((F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2000003)) / 1000001.5 - 1).alias(f"y{i}") for i in range(k)))

    def times(state: DataFrame, here: str, there: str) -> DataFrame:
        names = state.columns[1:]
        return cells.join(state, here).groupBy(there).agg(*(F.sum(F.col("v") * F.col(y)).alias(y) for y in names))

    def products(state: DataFrame) -> np.ndarray:
        names = state.columns[1:]
        row = state.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:])).first()
        return np.array([[row[f"{min(a, b, key=names.index)}_{max(a, b, key=names.index)}"] or 0.0 for b in names] for a in names])

    def mixed(state: DataFrame, by: np.ndarray) -> DataFrame:
        names = state.columns[1:]
        return state.select("node", *(sum((F.lit(float(by[i, j])) * F.col(y) for i, y in enumerate(names)), F.lit(0.0)).alias(f"y{j}") for j in range(by.shape[1])))

    state, before = written(start, "state"), None
    for _ in range(rounds):
        size, turn = np.linalg.eigh(products(state))
        live = size > 1e-14 * max(size.max(initial=0.0), 1e-300)
        across = written(times(mixed(state, turn[:, live] / np.sqrt(size[live])), "node", "c"), "across")
        values, axes = np.linalg.eigh(products(across))
        order = np.argsort(-values)[:dim]
        now = np.zeros(dim)
        now[: len(order)] = np.sqrt(np.maximum(values[order], 0.0))
        following = written(times(across, "c", "node"), "state")
        if before is not None and np.abs(now - before).max() <= tolerance * now.max(initial=0.0):
            good = [i for i in order if values[i] > 1e-12 * values.max()]
            found = mixed(following, axes[:, good] / np.sqrt(values[good]))  # X X' y over the singular value: the direction times it
            signs = found.agg(*(F.when(F.sum(y) < 0, -1.0).otherwise(1.0).alias(y) for y in found.columns[1:])).first()
            v = F.array(*(F.col(y) * float(signs[y]) for y in found.columns[1:]), *([F.lit(0.0)] * (dim - len(good))))
            return found.select("node", unit(v))
        discard(across, state)
        state, before = following, now
    raise RuntimeError(f"singular values still move by {np.abs(now - before).max()} after {rounds} rounds")


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Element-wise mean per group, in order of the elements."""
    cells = df.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    return cells.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: F.round(c["m"], 6)).alias("mean"))


def offset_errors(df: DataFrame, truth: str, estimate: str, offsets: list[int], by: str) -> DataFrame:
    """Share of estimates within one and two of the truth at each offset, per slice, and whether two thirds are within one."""
    grid = df.withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    gap = F.abs(F.col(truth) - (F.col(estimate) + F.col("offset")))
    out = grid.groupBy(by, "offset").agg(F.count("*").alias("n"), F.avg((gap <= 1).cast("int")).alias("w1"), F.avg((gap <= 2).cast("int")).alias("w2"))
    return out.select(by, "offset", "n", F.round("w1", 6).alias("within1"), F.round("w2", 6).alias("within2"), (F.col("w1") >= 2 / 3).alias("passes"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labelings and its share of the mean entropy."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    j = cells.join(ra, a).join(rb, b).join(F.broadcast(total))
    mi = j.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda df, n, name: df.join(F.broadcast(total)).agg((-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t")))).alias(name))
    return mi.join(h(ra, "na", "ha")).join(h(rb, "nb", "hb")).select(F.round("mi", 6).alias("mi"), F.round(2 * F.col("mi") / (F.col("ha") + F.col("hb")), 6).alias("nmi"))


def top_by_count(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rn).filter(F.col("rank") <= k)
