"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.sources.scratch import discard, scratch, written

__all__ = ["by_size", "discard", "id_and_text", "scratch", "table", "unused", "written"]


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_size(texts: list[str], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts and, beyond one text, ``chars`` characters."""
    lo = held = 0
    for i, text in enumerate(texts):
        if i > lo and (i - lo == rows or held + len(text) > chars):
            yield lo, i
            lo, held = i, 0
        held += len(text)
    if lo < len(texts):
        yield lo, len(texts)


BATCH_ROWS = 1_000  # rows that one Arrow batch hands to Python: bounds the memory beside the heap where texts are long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, in a session whose Arrow batches are small enough for whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, a null text as the empty one; other columns cannot clash with its own."""
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
