"""Near-duplicates by Order MinHash and banded alignment.

A text is a sequence of words, and of shingles of SHINGLE consecutive words (fewer words are one shingle). A sketch takes
the TAKE occurrence-labelled shingles of least hash and keeps them in text order, so that texts agree where they have the
same shingles in the same order. Texts that agree in a sketch are candidates. Words changed here and there leave few long
shingles whole, so further sketches take shorter ones (FAMILIES), those of two words for short texts alone. Similar are
texts whose words align at an edit distance of at most 0.2 of the longer text; the alignment runs inside a band.

Equal texts are one node from the start. First, every node of a sketch's bucket is aligned with the bucket's least node;
each such pair once, in however many buckets it stands, and the groups that these links make are formed. By the triangle inequality only nodes near the edge of the band
can be similar to nodes beyond it: those beyond it, and the few near its edge, stay. What stays of a bucket is dealt into
blocks of bounded size, and every two blocks of a bucket meet in a task. There a product of word counts gives, for all
pairs at once, a distance that no alignment can undercut; the pairs that it does not tell apart, and that nothing links
yet, are aligned, in the least of the buckets they share. So every two nodes that share a bucket are aligned, told apart by a bound, or linked through others,
whatever the bucket's size; a task only returns a forest of links, never the pairs of a group. Classes are the connected
components.

Defined cases: a null text is the empty text; texts without words are only copies of equal texts; an id with several texts
is one node for those that no lesser id has, compared by the least of them; a null id has a null class; other columns are
not read; ids may have any type with an order; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.spans import mix, span_hashes
from wayline.llm.wu_manber import words
from wayline.operators.components import connected_components

SHINGLE = 5
#: Words of a shingle, sketches of them, and the longest texts that have these sketches. A text that is similar to one of 48 words has at most 60.
FAMILIES = ((SHINGLE, 32, None), (3, 20, None), (2, 36, 60))
SKETCHES = sum(f[1] for f in FAMILIES)
TAKE = 2
SIMILARITY = 0.8
BLOCK_NODES, BLOCK_WORDS = 2_048, 1 << 20  # of a bucket's rest; a task holds two blocks
BINS, LEVELS = 1_024, 2  # words fall into bins; counts up to LEVELS are compared bin by bin
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
_FACTORS = (_SEEDS[:SKETCHES, None] | np.uint64(1)).astype(np.uint32)
_SHIFTS = _SEEDS[SKETCHES:, None].astype(np.uint32)


def shingles(w: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of ``size`` words in order."""
    if not w:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    k = min(size, len(w))
    starts = (ends - sizes)[: len(w) - k + 1]
    return span_hashes(np.frombuffer(b" ".join(w), np.uint8), starts, ends[k - 1 :])


def sketches(w: list[bytes]) -> np.ndarray:
    """The values of a text's sketches of all families that its length has, none without words."""
    out, first = [], 0
    for size, many, longest in FAMILIES:
        if w and (longest is None or len(w) <= longest):
            out.append(_sketch(shingles(w, size), first, many))
        first += many
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sketch(hashes: np.ndarray, first: int, many: int) -> np.ndarray:
    """Sketches ``first`` to ``first + many``; equal values stand for equal choices of shingles."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    labelled = hashes.copy()
    if len(again):  # the occurrence number tells repeated shingles apart
        start = np.arange(len(ranked))
        start[again] = 0
        labelled[order] += (np.arange(len(ranked)) - np.maximum.accumulate(start)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    labelled = mix(labelled)
    low = labelled.astype(np.uint32)
    take = min(TAKE, len(hashes))
    out = np.zeros(many, np.uint64)
    step = max(1, 4_000_000 // len(hashes))  # bounds the memory for very long texts
    for lo in range(0, many, step):
        some = slice(first + lo, first + min(many, lo + step))
        keys = low * _FACTORS[some]
        keys += _SHIFTS[some]
        rows = np.arange(len(keys))
        places = np.empty((take, len(keys)), np.int64)
        for k in range(take):
            places[k] = keys.argmin(1)
            keys[rows, places[k]] = 0xFFFFFFFF
        places.sort(0)
        value = out[lo : lo + step]
        for at in places:
            value = mix(value * np.uint64(3) + labelled[at])
        out[lo : lo + step] = value
    return out


def compare(x: str, y: str, similarity: float) -> tuple[int, bool]:
    """Edit distance in words, exact where the texts are similar and else never above the true one, and whether they are."""
    return aligned(words(x), words(y), similarity)


def aligned(a: list, b: list, similarity: float) -> tuple[int, bool]:
    """``compare`` for lists of words."""
    longer = max(len(a), len(b))
    band = int((1 - similarity) * longer + 1e-9)
    apart = longer - min(len(a), len(b))
    if apart <= band:
        apart = longer - (Counter(a) & Counter(b)).total()  # no alignment is shorter
    if apart > band:
        return apart, False
    d = distance(a, b, band)
    return d, d <= band


def distance(a: list, b: list, band: int) -> int:
    """Edit distance of two sequences if it is at most ``band``, else ``band`` + 1.

    Bit-parallel alignment inside the band: bit i of a vector is the row i - band below the column at hand.
    """
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    slope = len(a) - len(b)
    if abs(slope) > band:
        return band + 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << (2 * band + 1)) - 1
    up, down = full & ~((1 << band) - 1), 0
    at, d = band + slope, abs(slope)
    for j, y in enumerate(b):
        found = places.get(y, 0)
        match = (found >> (j - band) if j >= band else found << (band - j)) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(same | up)) & full
        right_down = same & up
        if j >= -slope and not same >> at & 1:
            d += 1
            if d > band:
                return band + 1
        below = same >> 1
        up = (right_down | ~(below | right_up)) & full
        down = below & right_up
    return d


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` (the least id with this text), ``n`` words (SHINGLE at least) and ``sketches`` of every distinct text, with its ``key``."""
    rows = common.id_and_text(docs, id_col, text_col).filter(F.col(id_col).isNotNull())
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this task: equal texts are sketched once
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, values = [], []
                for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if key in seen:
                        n.append(None)
                        values.append(None)
                        continue
                    seen.add(key)
                    w = words(text)
                    n.append(max(len(w), SHINGLE) if w else SHINGLE - 1)
                    values.append(sketches(w).view(np.int64))
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["node", "key", "n", "sketches"])

    keyed = rows.select(F.col(id_col).alias("node"), F.unhex(F.md5(text_col)).alias("key"), text_col)
    sketched = keyed.mapInArrow(run, f"node {id_type}, key binary, n int, sketches array<long>")
    return sketched.groupBy("key").agg(F.min("node").alias("node"), F.first("n", True).alias("n"), F.first("sketches", True).alias("sketches"))


def _words(docs: DataFrame, met: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node`` and ``words``, joined by one space, of the nodes of ``met``."""
    rows = common.id_and_text(docs, id_col, text_col).select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    id_type = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = pa.array([b" ".join(words(t)) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.record_batch([batch.column(0), joined], ["node", "words"])

    return rows.join(met.hint("merge"), "node", "left_semi").mapInArrow(run, f"node {id_type}, words binary")


def _aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``hub``, ``node``, ``d`` (edit distance, exact for similar nodes and else a lower bound) and ``similar`` for pairs of nodes.

    Pairs and texts meet by sorted shuffles at every size, so that the plan of a small run is that of a large one.
    """
    least = texts.groupBy("node").agg(F.min("words").alias("words"))
    both = pairs.join(least.toDF("node", "words_b").hint("merge"), "node").join(least.toDF("hub", "words_a").hint("merge"), "hub")
    both = both.select("hub", "node", "words_a", "words_b")
    id_type = pairs.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                d, similar = [], []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    apart, alike = aligned(x.split(), y.split(), similarity)
                    d.append(apart)
                    similar.append(alike)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(d, pa.int32()), pa.array(similar)], ["hub", "node", "d", "similar"])

    return both.mapInArrow(run, f"hub {id_type}, node {id_type}, d int, similar boolean")


def similar_pairs(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``a``, ``b``: linked nodes. Pairs inside a bucket that others already link may be left out."""
    to_hubs, _, more = _found(docs, nodes, id_col, text_col, similarity)
    links = common.written(to_hubs.unionByName(more), "links")
    common.discard(to_hubs, more)
    return links


def _found(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (``a``, ``b``) to hubs, the groups (``node``, ``component``) that these make, and links beyond them."""
    members = nodes.select("node", F.posexplode("sketches").alias("j", "value")).select(F.xxhash64("j", "value").alias("bucket"), "node")
    firsts = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").drop("last")
    spokes = common.written(members.join(firsts, "bucket").filter("node <> hub"), "spokes")
    met = spokes.select("node").union(spokes.select("hub")).distinct()
    texts = common.written(_words(docs, met, id_col, text_col), "texts")  # only those that share a bucket
    sizes = nodes.groupBy("node").agg(F.min("n").alias("n"))
    pairs = spokes.select("hub", "node").distinct().join(sizes.toDF("hub", "hub_n"), "hub").join(sizes, "node")
    pairs = common.written(pairs, "pairs")
    close = F.abs(F.col("n") - F.col("hub_n")) <= F.floor((1 - similarity) * F.greatest("n", "hub_n") + 1e-9)
    near = _aligned(pairs.filter(close).select("hub", "node"), texts, similarity)
    far = pairs.filter(~close).select("hub", "node", F.abs(F.col("n") - F.col("hub_n")).alias("d"), F.lit(False).alias("similar"))
    known = common.written(near.unionByName(far).join(pairs.select("hub", "node", "n"), ["hub", "node"]), "known")
    to_hubs = common.written(known.filter("similar").select(F.col("hub").alias("a"), F.col("node").alias("b")), "hubs")
    # What the hubs of all buckets link needs no further test. A node hangs on its least hub, which takes its other hubs along.
    first = to_hubs.groupBy("b").agg(F.min("a").alias("first"))
    chief = to_hubs.join(first, "b").filter("a <> first").select(F.col("first").alias("b"), "a").distinct()
    groups = connected_components(first.select("b", F.col("first").alias("a")).unionByName(chief), "a", "b")
    left = common.written(_unsettled(spokes, known, groups, similarity), "left")
    more = common.written(_rest_links(left, texts, similarity), "links")
    common.discard(spokes, texts, pairs, known, left)
    return to_hubs, groups, more


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``component``: the groups, those that links meet made one."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    tops = connected_components(between.filter("a <> b").distinct(), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("top"))
    alone = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(groups, "node", "left_anti")
    every = groups.unionByName(alone.withColumn("component", F.col("node")))
    return every.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _unsettled(spokes: DataFrame, known: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Members of a bucket that may be similar to others than its hub: ``bucket``, ``node``, ``n`` and ``linked``, the group that hubs link them to and else themselves."""
    judged = spokes.join(known, ["hub", "node"])
    allowed = F.floor((1 - similarity) * F.col("n") + 1e-9)
    beyond = judged.filter("not similar").groupBy("bucket").agg(F.min("d").alias("nearest"), F.min(F.col("d") - allowed).alias("reach"))
    # What is similar to a member that this settles is similar to its hub too.
    settled = F.col("similar") & (F.col("d") < F.least("reach", F.col("nearest") - allowed))
    left = judged.join(beyond, "bucket").filter(~settled).select("bucket", "node", "n")
    return left.join(groups, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("linked"))


def _rest_links(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: links among what stays of each bucket, found in tasks that hold two blocks of it."""
    rest = left.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.min("linked").alias("lo"), F.max("linked").alias("hi")).filter("lo < hi")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_NODES), F.ceil(F.col("w") / BLOCK_WORDS))
    dealt = left.join(rest.select("bucket", blocks.alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # A pair that shares several buckets is tested in the least of them alone; a node is in as many as it has sketches at most.
    mine = dealt.groupBy("node").agg(F.collect_set("bucket").alias("mine"))
    least = texts.groupBy("node").agg(F.min("words").alias("words")).join(mine.hint("merge"), "node")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(least.hint("merge"), "node")
    met = met.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("second"), "node", "linked", "words", "mine")
    id_type = left.schema["node"].dataType.simpleString()
    arrow_type = left.limit(0).select("node").toArrow().schema.field("node").type

    def links(rows: list[tuple]) -> pa.RecordBatch:
        second = np.array([r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
        buckets = [frozenset(r[7]) for r in rows]
        here = lambda i, j: min(buckets[i] & buckets[j]) == rows[0][0]
        found = link_group([r[5] for r in rows], [r[6].split() for r in rows], second, similarity, here)
        return pa.record_batch([pa.array([rows[i][4] for i, _ in found], arrow_type), pa.array([rows[j][4] for _, j in found], arrow_type)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    yield links(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield links(rows)

    keys = ["bucket", "lo", "hi"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def link_group(linked: list, texts: list[list[bytes]], second: np.ndarray | None, similarity: float, here: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs of places that link all similar texts of a group, as far as ``linked`` does not: equal values are linked.

    With ``second``, only pairs of a text for which it holds and one for which it does not; of all, only those that ``here``
    says belong to this group.
    """
    names: dict = {}
    roots = np.array([names.setdefault(x, len(names)) for x in linked])
    n = np.array([len(t) for t in texts])
    common_words = _common_words(texts)
    out = []
    for lo in range(0, len(texts), 256):
        longer = np.maximum(n[lo : lo + 256, None], n[None, lo:])
        open_ = longer - common_words(lo, lo + 256) <= np.floor((1 - similarity) * longer + 1e-9)
        if second is not None:
            open_ &= second[lo : lo + 256, None] != second[None, lo:]
        for i in range(lo, min(lo + 256, len(texts))):
            others = np.flatnonzero(open_[i - lo, i - lo + 1 :]) + i + 1
            for j in others[roots[others] != roots[i]].tolist():
                if roots[i] != roots[j] and here(i, j) and aligned(texts[i], texts[j], similarity)[1]:
                    roots[roots == roots[j]] = roots[i]
                    out.append((i, j))
    return out


def _common_words(texts: list[list[bytes]]):
    """A function of (lo, hi): for texts lo to hi and all from lo on, a number that their common words do not exceed."""
    places: dict = {}
    counts = np.zeros((len(texts), BINS), np.int32)
    for k, text in enumerate(texts):
        bins = np.fromiter((places.setdefault(w, len(places)) for w in text), np.int64, len(text)) % BINS
        counts[k] = np.bincount(bins, minlength=BINS)
    used = counts.any(0)
    counts = counts[:, used]
    marks = np.concatenate([counts >= level for level in range(1, LEVELS + 1)], 1).astype(np.float32)
    over = np.maximum(counts - LEVELS, 0).sum(1)
    return lambda lo, hi: marks[lo:hi] @ marks[lo:].T + np.minimum(over[lo:hi, None], over[None, lo:])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Each row's id and ``class_id``, the least id of its group of near copies; a text without any is its own class."""
    nodes = common.written(_nodes(docs, id_col, text_col), "nodes")
    _, groups, more = _found(docs, nodes, id_col, text_col, similarity)
    linked = _joined(groups, more)
    label = nodes.select("key", "node").join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("class_id"))
    rows = common.id_and_text(docs, id_col, text_col).select(F.col(id_col), F.unhex(F.md5(text_col)).alias("key"))
    known = rows.filter(F.col(id_col).isNotNull()).join(label, "key").select(id_col, "class_id")
    nothing = F.lit(None).cast(docs.schema[id_col].dataType)
    return known.unionByName(rows.filter(F.col(id_col).isNull()).select(id_col, nothing.alias("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one of least id, with its columns as they are; rows without an id stay.

    Of rows that share the kept id, the one of the least text stays.
    """
    first = classes(docs, id_col, text_col, similarity).filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col)).distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("wl_row")
    kept = docs.join(first, id_col, "left_semi").groupBy(F.col(id_col).alias("wl_id")).agg(F.min_by(whole, F.coalesce(F.col(text_col), F.lit(""))).alias("wl_row"))
    return kept.select("wl_row.*").unionByName(docs.filter(F.col(id_col).isNull()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))
