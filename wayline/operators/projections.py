"""Column builders: tiered values with provenance, gates, buckets, code prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiered(df: DataFrame, name: str, tiers: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """Add ``name``, the first non-null value of the tiers whose gate holds, and ``name``_source, that tier's label."""
    usable = [(label, value if gate is None else F.when(gate, value)) for label, value, gate in tiers]
    source = F.lit(None).cast("string")
    for label, value in reversed(usable):
        source = F.when(value.isNotNull(), F.lit(label)).otherwise(source)
    return df.withColumns({name: F.coalesce(*(v for _, v in usable)), f"{name}_source": source})


def bucket_label(value: Column, buckets: list[tuple[str, float | None, float | None]]) -> Column:
    """The label of the first bucket [low, high) that holds the value; open ends are None."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(buckets):
        inside = value.isNotNull()
        inside = inside if low is None else inside & (value >= low)
        inside = inside if high is None else inside & (value < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def floor_bin(value: Column, width: int) -> Column:
    return (F.floor(value / width) * width).cast("int")


def nearest_target(value: Column, targets: list[int], tolerance: int) -> Column:
    """The closest target within the tolerance, the lower one on a tie, else null."""
    ranked = F.array_min(F.array(*[F.struct(F.abs(value - t).alias("gap"), F.lit(t).alias("target")) for t in targets]))
    return F.when(ranked["gap"] <= tolerance, ranked["target"])


def longest_prefix(df: DataFrame, code: str, prefixes: DataFrame, prefix: str, value: str, most: int) -> DataFrame:
    """Add ``value`` of the longest of ``prefixes`` (unique) that starts the code: one equi-join per row's own prefixes."""
    own = df.select(code).distinct().withColumn("wl_p", F.explode(F.expr(f"transform(sequence(1, least(length({code}), {most})), i -> left({code}, i))")))
    best = (
        own.join(prefixes.select(F.col(prefix).alias("wl_p"), F.col(value)), "wl_p")
        .groupBy(code)
        .agg(F.max_by(value, F.length("wl_p")).alias(value))
    )
    return df.join(best, code, "left")


def trusted(code: Column, support: Column, total: Column, least: int, share: float) -> Column:
    """The code where its support and its share are high enough."""
    return F.when((support >= least) & (support >= share * total), code)


def reapply(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Drop what an earlier run added, then add it again: applying twice is applying once."""
    return df.drop(*added).withColumns(added)


def backfill(df: DataFrame, target: str, sibling: str, usable: Column) -> DataFrame:
    """Move a sibling's value into an empty target where it is usable, emptying the sibling."""
    move = F.col(target).isNull() & F.col(sibling).isNotNull() & usable
    return df.withColumns({target: F.when(move, F.col(sibling)).otherwise(F.col(target)), sibling: F.when(~move, F.col(sibling))})


def valid_interval(start: Column, end: Column, horizon: Column) -> Column:
    """Dated, not ending before it starts, not starting after the horizon."""
    return F.coalesce(start.isNotNull() & (end.isNull() | (end >= start)) & (start <= horizon), F.lit(False))


def bounded_entities(df: DataFrame, entity: str, most: int) -> DataFrame:
    """Rows of entities with at most ``most`` rows; counted first, so that a giant is one aggregate, not one window."""
    small = df.groupBy(entity).agg(F.count("*").alias("wl_n")).filter(F.col("wl_n") <= most).select(entity)
    return df.join(small, entity, "left_semi")


def word_flag(text: Column, any_of: list[str], none_of: list[str]) -> Column:
    """Whole words or phrases of one list present, of the other absent."""
    found = text.rlike(r"(?i)\b(" + "|".join(any_of) + r")\b")
    return F.coalesce(found & ~text.rlike(r"(?i)\b(" + "|".join(none_of) + r")\b") if none_of else found, F.lit(False))


def all_of(*conditions: Column) -> Column:
    """A strict gate: unknown conditions count as not met."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def partition_share(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))


def slim(df: DataFrame, keep: Column, columns: dict[str, Column]) -> DataFrame:
    """A narrow extract for later steps: the rows that ``keep`` holds for, and the named columns alone."""
    return df.filter(keep).select(*(c.alias(name) for name, c in columns.items()))
