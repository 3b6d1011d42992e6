"""Values that differ by typing errors in their words, whatever the words' order.

Words are compared once per vocabulary: words whose similarity can reach the bound share a key (the word with characters
left out, or, for long words, a piece at a place), so no block of words is compared with itself. Linked words have a group.
Similar values have the same number of words, the same phonetic codes and the same word groups, which is what they meet on;
each value is tested against the most frequent one of its meeting, and what that leaves is dealt into blocks, every two of
which meet in a task that returns a forest of links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.components import connected_components
from wayline.sources.scratch import discard, written

RATIO, LEAST_LETTERS = 0.85, 4  # of two words that count as the same, and the shortest that may differ at all
SHORT = 20  # letters up to which words meet by letters left out, beyond by pieces
TASK_KEYS = 1 << 20  # of words with letters left out that a task makes or holds at a time
TASK_WORDS = 1_024  # longer than that, which a task cuts into pieces
FILTER_BITS = 26  # of the filter of whole words, as a power of two at most
MEETINGS = 1 << 18  # pairs that are compared at a time
BLOCK_VALUES = 1_024  # of a meeting that a task holds twice


# The published rules of Metaphone: one pass over the letters, each coded by its neighbours.
_SILENT_START = re.compile("^(?:kn|gn|pn|ae|wr)")
_FRONT, _VOWELS = "eiy", "aeiou"


def metaphone(word: str) -> str:
    """The Metaphone code of a lower-case word; letters outside a to z count as none."""
    w = re.sub("[^a-z]", "", word)
    if _SILENT_START.match(w):
        w = w[1:]
    if w.startswith("x"):
        w = "s" + w[1:]
    if w.startswith("wh"):
        w = "w" + w[2:]
    out = []
    for i, c in enumerate(w):
        before, after, later = w[i - 1 : i], w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == before and c != "c":
            continue
        if c in _VOWELS:
            code = c if i == 0 else ""
        elif c == "b":
            code = "" if before == "m" and not after else "b"
        elif c == "c":
            if after and after in _FRONT:
                code = "x" if after == "i" and later == "a" else "" if before == "s" else "s"
            elif after == "h":
                code = "k" if before == "s" or (i == 0 and later not in _VOWELS) else "x"
            else:
                code = "k"
        elif c == "d":
            code = "j" if after == "g" and later and later in _FRONT else "t"
        elif c == "g":
            if after == "h":
                code = "" if later and later not in _VOWELS else "k" if not later or i == 0 else ""
            elif after == "n" and (not later or w[i + 1 :] == "ned"):
                code = ""
            elif after and after in _FRONT and before != "g":
                code = "" if before == "d" else "j"
            else:
                code = "k"
        elif c == "h":
            code = "h" if after and after in _VOWELS and before not in ("c", "s", "p", "t", "g") else ""
        elif c == "k":
            code = "" if before == "c" else "k"
        elif c == "p":
            code = "f" if after == "h" else "p"
        elif c == "q":
            code = "k"
        elif c == "s":
            code = "x" if after == "h" or (after == "i" and later in ("o", "a")) else "s"
        elif c == "t":
            if after == "i" and later in ("o", "a"):
                code = "x"
            elif after == "h":
                code = "0"
            else:
                code = "" if after == "c" and later == "h" else "t"
        elif c == "v":
            code = "f"
        elif c in ("w", "y"):
            code = c if after and after in _VOWELS else ""
        elif c == "x":
            code = "ks"
        elif c == "z":
            code = "s"
        else:
            code = c  # f, j, l, m, n, r
        out.append(code)
    return "".join(out)


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, bits of one word at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return (full & ~row).bit_count()


def alike(a: str, b: str, ratio: float = RATIO, least: int = LEAST_LETTERS) -> bool:
    """Whether two words count as the same: equal, or long enough and with a share of common letters of at least ``ratio``."""
    return a == b or (min(len(a), len(b)) >= least and 2 * common_letters(a, b) >= ratio * (len(a) + len(b)) - 1e-9)


def paired(a: list[str], b: list[str], ratio: float = RATIO, least: int = LEAST_LETTERS) -> bool:
    """Whether the words of two values can be paired off one to one so that each pair counts as the same."""
    if len(a) != len(b):
        return False
    partner: list[int | None] = [None] * len(b)
    links = [[j for j, y in enumerate(b) if alike(x, y, ratio, least)] for x in a]

    def place(i: int, tried: set[int]) -> bool:
        for j in links[i]:
            if j not in tried:
                tried.add(j)
                if partner[j] is None or place(partner[j], tried):
                    partner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))


def _edits(total: int, ratio: float) -> int:
    """Letters put in and left out between words of this total length at most."""
    return int((1 - ratio) * total + 1e-9)


def rest(n: int, m: int, ratio: float = RATIO) -> int:
    """Letters that words of ``n`` and ``m`` letters have in common at least if they count as the same."""
    return -(-(n + m - _edits(n + m, ratio)) // 2)


def partners(n: int, kept: int, ratio: float = RATIO, least: int = LEAST_LETTERS) -> list[int]:
    """Lengths up to SHORT of the words that a word of ``n`` letters meets by ``kept`` of its letters."""
    return [m for m in range(least, SHORT + 1) if rest(n, m, ratio) == kept <= min(n, m)]


def rests(n: int, ratio: float = RATIO, least: int = LEAST_LETTERS) -> list[int]:
    """Numbers of letters that a word of ``n`` letters, SHORT at most, keeps to meet others."""
    return [kept for kept in range(1, n + 1) if partners(n, kept, ratio, least)] if least <= n <= SHORT else []


def piece_keys(word: str, longer: bool, ratio: float = RATIO, least: int = LEAST_LETTERS) -> list[str]:
    """The keys of ``meeting_keys`` by pieces, as the shorter or the longer word of pairs in which that has more than SHORT letters."""
    n, out = len(word), set()
    others = range(least, n + 1) if longer else range(max(n, SHORT + 1), 2 * n + 2)
    for m in others if n >= least and (n > SHORT or not longer) else ():
        edits, short = _edits(n + m, ratio), min(n, m)
        if abs(n - m) > edits:
            continue
        bounds = [short * k // (edits + 1) for k in range(edits + 2)]
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if longer:
                out |= {f"p{m}:{n}:{lo}:{word[at : at + hi - lo]}" for at in range(max(0, lo - k, lo + n - m - edits + k), min(n - (hi - lo), lo + k, lo + n - m + edits - k) + 1)}
            else:
                out.add(f"p{n}:{m}:{lo}:{word[lo:hi]}")
    return sorted(out)


def meeting_keys(word: str, ratio: float = RATIO, least: int = LEAST_LETTERS) -> list[str]:
    """Keys of which two different words that count as the same share one.

    Both become their common letters by leaving out others. Where the longer word has at most SHORT letters, both emit what
    is left of just as many letters as each length of the other word asks for. Beyond, the shorter word emits its pieces, one more than there can be
    edits, so that one is whole in the longer word; for one of the whole ones at least, no more edits lie before it than pieces,
    and none more after it than pieces and edits left allow, which bounds its place from both ends.
    """
    out = {"d" + "".join(kept) for k in rests(len(word), ratio, least) for kept in combinations(word, k)}
    return sorted(out.union(*(piece_keys(word, longer, ratio, least) for longer in (False, True))))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _words(codes: np.ndarray) -> pa.Array:
    """Rows of code points as words."""
    n = codes.shape[1]
    if codes.max(initial=0) < 128:
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, codes.size + 1, n, dtype=np.int32)), pa.py_buffer(codes.astype(np.uint8).tobytes()))
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string())


def _choices(n: int, kept: int) -> np.ndarray:
    """The places of the letters that stay, a row per choice of ``kept`` of ``n``."""
    return np.array(list(combinations(range(n), kept)))


def _hashes(letters: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of the words whose first, second and further letters these arrays hold."""
    out = np.uint64(0)
    for codes in letters:
        out = out * np.uint64(0xD6E8FEB86659FD93) + (codes.astype(np.uint64) + np.uint64(1))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def _kept_hashes(codes: np.ndarray, kept: int) -> np.ndarray:
    """A row per word of the hashes of what is left where ``kept`` letters stay, for every choice of them."""
    return _hashes(codes[:, places] for places in _choices(codes.shape[1], kept).T)


def _packed(which: np.ndarray, codes: np.ndarray, choices: int) -> bytes:
    """Choices and words, column by column and compressed."""
    return pa.Codec("zstd", 1).compress(which.astype(_size(choices)).tobytes() + codes.T.tobytes(), asbytes=True)


def _unpacked(data: bytes, rows: int, n: int, choices: int, letter: str) -> tuple[np.ndarray, np.ndarray]:
    kind = np.dtype(_size(choices))
    whole = pa.Codec("zstd", 1).decompress(data, rows * (kind.itemsize + n * np.dtype(letter).itemsize), asbytes=True)
    return np.frombuffer(whole, kind, rows), np.frombuffer(whole, letter, offset=rows * kind.itemsize).reshape(n, rows).T


def _size(choices: int) -> str:
    return "u1" if choices <= 1 << 8 else "<u2" if choices <= 1 << 16 else "<u4"


def _marks(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of ``size`` bits, a power of two."""
    return hashes & np.uint64(size - 1), hashes >> np.uint64(32) & np.uint64(size - 1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``common_letters`` of each row of ``a`` with that of ``b``, of at most SHORT letters."""
    n = a.shape[1]
    full, powers = np.int64((1 << n) - 1), (1 << np.arange(n)).astype(np.float32)  # sums below 2^24, which are exact
    row = np.full(len(a), full)
    for j in range(b.shape[1]):
        met = row & ((a == b[:, j : j + 1]).astype(np.float32) @ powers).astype(np.int64)
        row = (row + met | row - met) & full
    return n - np.bitwise_count(row).astype(np.int64)


def _meetings(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two sorted lists of hashes, or in one list, which are equal, MEETINGS at a time."""
    lo = np.arange(1, len(a) + 1) if same else np.searchsorted(b, a, "left")
    n = np.searchsorted(b, a, "right") - lo
    at = np.flatnonzero(n)
    lo, n = lo[at], n[at]
    ends = np.cumsum(n)
    for start in range(0, int(ends[-1]) if len(ends) else 0, MEETINGS):
        number = np.arange(start, min(start + MEETINGS, ends[-1]))
        i = np.searchsorted(ends, number, "right")
        yield at[i], lo[i] + number - (ends[i] - n[i])


def _short_pairs(words: DataFrame, ratio: float, least: int) -> DataFrame:
    """``word_pairs`` of the words with at most SHORT letters: what is left of them meets by hash, in buckets of TASK_KEYS.

    Two words meet by as many letters as their lengths ask for, so all that meet count as the same, but for equal hashes of
    different letters, which are told apart. Where all partners of a length are whole words, only what the filter of whole words
    lets through goes out. A bucket's words of one length and one number of letters kept are a few rows: which letters stay, and the
    letters, from which the task of the bucket makes the hashes anew.
    """
    spark = words.sparkSession
    short = words.filter(F.length("word").between(least, SHORT))
    lengths = dict(short.groupBy(F.length("word")).count().collect())  # a row per length
    size = 1 << min(max(16 * sum(lengths.values()), 1 << 16).bit_length(), FILTER_BITS)

    def by_length(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, list[str]] = {}
        for batch in batches:
            for word in batch.column("word").to_pylist():
                found.setdefault(len(word), []).append(word)
        return {n: _codes(sorted(some)) for n, some in found.items()}

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for n, codes in by_length(batches).items():
            for places in _marks(_kept_hashes(codes, n), size):
                bits[places] = True
        cells = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(cells[at])], ["at", "cell"])

    cells = short.coalesce(8).mapInArrow(marked, "at int, cell long").groupBy("at").agg(F.bit_or("cell").alias("cell")).toArrow()  # a few MB at most
    whole = np.zeros(size // 64, np.int64)
    whole[cells.column("at").to_numpy()] = cells.column("cell").to_numpy()
    sent = spark.sparkContext.broadcast(whole)
    kinds = {n: [(k, all(m == k for m in partners(n, k, ratio, least))) for k in rests(n, ratio, least)] for n in lengths}
    made = sum(count * comb(n, k) for n, count in lengths.items() for k, _ in kinds[n])
    going = sum(count * comb(n, k) for n, count in lengths.items() for k, few in kinds[n] if not few or k == n)
    tasks, buckets = -(-made // (4 * TASK_KEYS)) or 1, -(-going // TASK_KEYS) or 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value.view(np.uint8), bitorder="little").view(bool)
        for n, every in by_length(batches).items():
            for k, few in kinds[n]:
                step = max(1, TASK_KEYS // comb(n, k))
                for codes in (every[i : i + step] for i in range(0, len(every), step)):
                    hashes = _kept_hashes(codes, k)
                    if few and k < n:
                        first, second = _marks(hashes, size)
                        at = np.flatnonzero(bits[first] & bits[second])
                    else:
                        at = np.arange(hashes.size)
                    bucket = (hashes.ravel()[at] >> np.uint64(40)) % np.uint64(buckets)
                    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
                    at, ends = at[order], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
                    who, which = codes[at // hashes.shape[1]], at % hashes.shape[1]
                    letter = "u1" if who.max(initial=0) < 256 else "<u4"
                    who = who.astype(letter)
                    rows = [(b, n, k, hi - lo, letter, _packed(which[lo:hi], who[lo:hi], hashes.shape[1])) for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)) if hi > lo]
                    if rows:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (*[pa.int32()] * 4, pa.string(), pa.binary()))], ["bucket", "n", "kept", "rows", "letter", "words"])

    def meet(table: pa.Table) -> pa.Table:
        parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, k, rows, letter, packs in zip(*(table.column(c).to_pylist() for c in ("n", "kept", "rows", "letter", "words"))):
            parts.setdefault((n, k), []).append(_unpacked(packs, rows, n, comb(n, k), letter))
        lists = {}
        for (n, k), some in parts.items():
            who, choices = np.concatenate([x for _, x in some]), _choices(n, k)[np.concatenate([x for x, _ in some])]
            keys = _hashes(who[np.arange(len(who)), places] for places in choices.T)
            order = np.argsort(keys)
            lists[n, k] = keys[order], who[order]
        out = [pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})]
        for (n, k), (keys, who) in lists.items():
            for m in partners(n, k, ratio, least):
                if m >= n and (m, k) in lists:
                    others, them = lists[m, k]
                    swap = len(keys) > len(others)
                    for i, j in _meetings(others, keys, False) if swap else _meetings(keys, others, m == n):
                        a, b = who[j if swap else i], them[i if swap else j]
                        good = _common(a, b) >= k
                        if m == n:
                            good &= (a != b).any(1)
                        out.append(pa.table({"a": _words(a[good]), "b": _words(b[good])}))
        return pa.concat_tables(out)

    sides = short.repartition(tasks).mapInArrow(packed, "bucket int, n int, kept int, rows int, letter string, words binary")
    met = sides.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "a string, b string")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def word_pairs(words: DataFrame, word: str, ratio: float = RATIO, least: int = LEAST_LETTERS) -> DataFrame:
    """``a`` < ``b``: different words of a vocabulary that count as the same."""
    vocabulary = written(words.select(F.col(word).alias("word")).filter(F.length("word") >= least), "vocabulary")

    def keys(longer: bool) -> Callable[..., Column]:
        return F.pandas_udf(lambda values: values.map(lambda w: piece_keys(w, longer, ratio, least)), T.ArrayType(T.StringType()))

    @F.pandas_udf(T.BooleanType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, ratio, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    shortest = min(n for n in range(1, SHORT + 2) if SHORT + 1 - n <= _edits(SHORT + 1 + n, ratio))
    long = vocabulary.filter(F.length("word") >= shortest)
    tasks = -(-long.count() // TASK_WORDS) or 1
    shorter, longer = (long.repartition(tasks).select(F.col("word").alias(c), F.explode(keys(c == "b")("word")).alias("k")).select(c, F.xxhash64("k").alias("k")) for c in "ab")
    met = shorter.join(longer, "k").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = met.repartition(tasks, "a", "b").distinct().filter(same("a", "b"))
    # Each pair of lengths meets either by pieces or by letters left out.
    out = written(pairs.filter(F.greatest(F.length("a"), F.length("b")) > SHORT).unionByName(_short_pairs(vocabulary, ratio, least)), "word_pairs")
    discard(vocabulary)
    return out


def token_typo_clusters(
    vocab: DataFrame, key: str, n: str, words: str | None = None, ratio: float = RATIO, least: int = LEAST_LETTERS, stop: tuple[str, ...] = ()
) -> DataFrame:
    """``key`` and ``representative``: values whose words are the same up to order and typing errors, linked transitively.

    The words stand in the column ``words``, else in the value itself, with spaces between. Values meet if they have as many words with the same phonetic codes in any
    order, and are linked if their words can be paired off one to one, each pair equal or, from ``least`` letters on, with
    ``ratio`` of their letters in common. Words in ``stop`` do not count unless there are no others. The most frequent value
    of a cluster stands for it, the least on a tie. Values without words, or null, stand for themselves.
    """
    every = F.filter(F.split(F.col(words or key), " "), lambda t: t != "")
    kept = F.filter(every, lambda t: ~t.isin(list(stop))) if stop else every
    text = F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(every))
    rows = vocab.groupBy(key).agg(F.sum(n).alias("wl_n"), F.min(text).alias("wl_w"))
    rows = rows.filter(F.size("wl_w") > 0).select(F.col(key).alias("v"), F.col("wl_n").alias("n"), F.col("wl_w").alias("w"))
    # Values with the same words are one node, which its most frequent value stands for.
    nodes = written(rows.groupBy("w").agg(F.min(F.struct((-F.col("n")).alias("f"), F.col("v").alias("v"))).alias("t")).select("w", F.col("t.v").alias("v"), F.col("t.f").alias("f")), "nodes")

    @F.pandas_udf(T.StringType())
    def code(values: pd.Series) -> pd.Series:
        return values.map(lambda w: metaphone(w) or w)

    words = written(nodes.select(F.explode("w").alias("word")).distinct().withColumn("code", code("word")), "words")
    pairs = word_pairs(words, "word", ratio, least)
    groups = connected_components(pairs, "a", "b")
    named = words.join(groups, F.col("word") == F.col("node"), "left").select("word", "code", F.coalesce("component", "word").alias("grp"))
    spread = nodes.select("v", F.explode("w").alias("word")).join(named, "word").groupBy("v").agg(
        F.xxhash64(F.array_sort(F.collect_list("code")), F.array_sort(F.collect_list("grp"))).alias("meeting")
    )
    met = written(nodes.join(spread, "v"), "met")
    links = _links(met, ratio, least)
    linked = connected_components(links, "a", "b")
    per_node = met.select("v", "w", "f").join(linked, F.col("v") == F.col("node"), "left").withColumn("component", F.coalesce("component", "v"))
    best = per_node.groupBy("component").agg(F.min(F.struct("f", "v")).alias("t")).select("component", F.col("t.v").alias("representative"))
    of_words = per_node.join(best, "component").select(F.col("w"), "representative")
    found = rows.join(of_words, "w").select(F.col("v").alias("wl_v"), "representative")
    out = vocab.select(key).distinct().join(found, F.col(key) == F.col("wl_v"), "left").select(key, F.coalesce("representative", key).alias("representative"))
    return out


def _links(met: DataFrame, ratio: float, least: int) -> DataFrame:
    """``a``, ``b``: links between the nodes of each meeting, a forest beyond the most frequent node's."""
    hubs = met.groupBy("meeting").agg(F.min(F.struct("f", "v", "w")).alias("hub"), F.count("*").alias("k")).filter("k > 1")

    @F.pandas_udf(T.BooleanType())
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([paired(list(x), list(y), ratio, least) for x, y in zip(a, b, strict=True)], dtype=bool)

    judged = met.join(hubs, "meeting").select("meeting", "v", "w", "k", F.col("hub.v").alias("hub"), same("w", "hub.w").alias("near"))
    judged = written(judged, "judged")
    # Where all are linked to the hub, nothing is left to test.
    left = judged.filter("not near").groupBy("meeting").agg(F.count("*").alias("apart")).filter("apart > 0")
    rest = judged.join(left, "meeting").withColumn("linked", F.when(F.col("near"), F.col("hub")).otherwise(F.col("v")))
    blocks = F.ceil(F.col("k") / BLOCK_VALUES)
    dealt = rest.select("meeting", "v", "w", "linked", blocks.alias("blocks"), F.pmod(F.xxhash64("v"), blocks).alias("block"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.select("meeting", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "v", "w", "linked")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("v")
        values, words, blocks_ = rows["v"].tolist(), [list(w) for w in rows["w"]], rows["block"].tolist()
        names: dict[str, int] = {}
        roots = [names.setdefault(x, len(names)) for x in rows["linked"]]
        across = rows["lo"].iloc[0] != rows["hi"].iloc[0]
        out = []
        for i in range(len(values)):
            for j in range(i + 1, len(values)):
                if roots[i] != roots[j] and not (across and blocks_[i] == blocks_[j]) and paired(words[i], words[j], ratio, least):
                    was, now = roots[j], roots[i]
                    roots = [now if r == was else r for r in roots]
                    out.append((values[i], values[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    more = both.groupBy("meeting", "lo", "hi").applyInPandas(forest, "a string, b string")
    return judged.filter("near and v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).unionByName(more)
