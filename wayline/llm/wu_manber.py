"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of every benchmark item (an item of fewer words is one window). For
each window length a shift table says, for a block of two words, how far the search may jump because no window can end
sooner; where the shift is zero, the bucket of that suffix block, split by first word, selects windows, and direct
comparison confirms them. Items are handed to the tasks in blocks of bounded size, one pass over the words per block, so
that a large benchmark neither grows the broadcast nor is cut.

Defined cases: a null or wordless text has no words and no hits; an item without words, or with a null id, is not
searched for; equal windows count for each of their items; rows with equal ids each give their own row; empty tables give
no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common

WINDOW = 10
BLOCK_CHARS = 1_000_000  # of item texts handed to the tasks at once

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lowered, then the runs of digits, letters a-z and characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


class WuManber:
    """Search tables for word windows that all have ``m`` words. ``found[i]`` are the items of pattern ``i``."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            self.buckets.setdefault(pattern[m - self.block :], {}).setdefault(pattern[0], []).append((list(pattern), items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence, in order."""
        m, size, jump, shift, n = self.m, self.block, self.jump, self.shift.get, len(text)
        end = m
        while end <= n:
            key = tuple(text[end - size : end])
            step = shift(key, jump)
            if step:
                end += step
                continue
            for pattern, items in self.buckets[key].get(text[end - m], ()):
                if text[end - m : end] == pattern:
                    yield end - m, items
            end += 1


def tables(items: list[tuple], window: int = WINDOW) -> list[WuManber]:
    """One search table per window length of (item id, text) rows."""
    by_length: dict[int, dict] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(w[at : at + m]), set()).add(item)
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def scan(text: list[bytes], searches: list[WuManber]) -> tuple[list[int], set]:
    """Hit ranges, flat as [first, behind the last, ...], disjoint and ascending, and the items that occur."""
    spans, items = [], set()
    for search in searches:
        for first, found in search.search(text):
            spans.append((first, first + search.m))
            items |= found
    return _merge(sorted(spans)), items


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in spans:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_BUILT: dict[str, list[WuManber]] = {}  # in a worker, the tables of the block at hand


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, keep: bool = False
) -> DataFrame:
    """Each document's ``n_words``, ``hits`` (flat word ranges) and ``items`` (ids as strings, sorted).

    With ``keep`` the rows keep all their columns, and the three come behind them under names that ``added_names`` gives.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").alias("text")).dropna()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    out = docs if keep else common.id_and_text(docs, id_col, text_col)
    kept = out.columns
    words_as, hits_as, items_as = added_names(kept)
    added = {words_as: pa.int64(), hits_as: pa.list_(pa.int32()), items_as: pa.list_(pa.string())}
    for block in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else bench
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # bounded by BLOCK_CHARS and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex, first=block == 0) -> Iterator[pa.RecordBatch]:
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = tables(shared.value, window)
            searches = _BUILT[name]
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    n, hits, items = [], [], []
                    before = [None] * batch.num_rows if first else list(zip(batch.column(hits_as).to_pylist(), batch.column(items_as).to_pylist(), strict=True))
                    for text, was in zip(batch.column(text_col).to_pylist(), before, strict=True):
                        w = words(text or "")
                        spans, found = scan(w, searches)
                        if was:
                            spans = _merge(sorted([*zip(spans[::2], spans[1::2], strict=True), *zip(was[0][::2], was[0][1::2], strict=True)]))
                            found = {*found, *was[1]}
                        n.append(len(w))
                        hits.append(spans)
                        items.append(sorted(found))
                    values = [pa.array(x, t) for x, t in zip((n, hits, items), added.values(), strict=True)]
                    yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *values], [*kept, *added])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select(kept).schema), f"`{words_as}` long, `{hits_as}` array<int>, `{items_as}` array<string>"])
        out = out.mapInArrow(run, schema)
    if keep:
        return out
    return out.select(id_col, F.col(words_as).alias("n_words"), F.col(hits_as).alias("hits"), F.col(items_as).alias("items"))


def added_names(columns: list[str]) -> tuple[str, str, str]:
    """Names for the words, hits and items of ``find`` that none of the columns has."""
    words_as, hits_as, items_as = (common.unused(columns, f"wl_{x}") for x in ("n_words", "hits", "items"))
    return words_as, hits_as, items_as


def n_hit(hits: str) -> F.Column:
    """Words covered by flat ranges."""
    return F.expr(f"aggregate(sequence(0, size({hits}) div 2), 0L, (n, i) -> if(i * 2 < size({hits}), n + {hits}[i * 2 + 1] - {hits}[i * 2], n))")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with their columns as they are."""
    return find(docs, benchmark, text_col=text_col, keep=True).filter(F.size(added_names(docs.columns)[1]) == 0).select(docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = n_hit("hits")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), item AS (
  SELECT id, w, least(len(w), 10) AS m FROM split WHERE kind = 'b' AND len(w) > 0 AND id IS NOT NULL
), item_window AS (
  SELECT DISTINCT id, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM item)
), doc_window AS (
  SELECT id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT s.id, s.w, l.m, unnest(generate_series(1, len(s.w) - l.m + 1)) AS i
        FROM split s JOIN (SELECT DISTINCT m FROM item) l ON s.kind = 'd' AND len(s.w) >= l.m)
), hit AS (
  SELECT d.id AS doc_id, d.i, d.m, b.id AS item_id FROM doc_window d JOIN item_window b ON d.m = b.m AND d.win = b.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM hit) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT s.id AS doc_id, len(s.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN words_hit h ON s.id = h.doc_id LEFT JOIN items_hit t ON s.id = t.doc_id
WHERE s.kind = 'd'
"""
