"""Window operators: flags, picks, samples, ranks, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.sources.scratch import written


def duplicate_flag(df: DataFrame, keys: list[str], order: list[Column], name: str = "is_duplicate") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def pick_one(df: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """One row per key, the first in order. Orders say where nulls go; they must be total."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("wl_rn", rn).filter("wl_rn = 1").select(*keys, *take)


def triples(df: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """Successive states a, b, c of an entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    out = df.select(entity, *order, F.col(state).alias("a"), F.lead(state, 1).over(w).alias("b"), F.lead(state, 2).over(w).alias("c"))
    return out.dropna(subset=["a", "b", "c"])


def salted_sample(df: DataFrame, strata: list[str], key: str, salt: str, n: int) -> DataFrame:
    """``n`` rows per stratum by the MD5 of key and salt: the same rows on every run and engine."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), key)
    return df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows up to this one, without one task for all rows.

    Rows are dealt out by ranges of the order, which must be total, and written; each range adds up its own rows, and one
    small row per range adds up the ranges before it.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("wl_part", F.spark_partition_id()), "ranges")
    upto = Window.unboundedPreceding
    sums = ranges.groupBy("wl_part").agg(F.sum(value).alias("wl_s"))
    before = sums.select("wl_part", F.coalesce(F.sum("wl_s").over(Window.orderBy("wl_part").rowsBetween(upto, -1)), F.lit(0)).alias("wl_b"))
    inside = ranges.withColumn("wl_i", F.sum(value).over(Window.partitionBy("wl_part").orderBy(*order).rowsBetween(upto, 0)))
    return inside.join(F.broadcast(before), "wl_part").withColumn(name, F.col("wl_i") + F.col("wl_b")).drop("wl_part", "wl_i", "wl_b")


def terciles(counts: DataFrame, n: str, key: str) -> DataFrame:
    """Add ``tercile`` of a vocabulary ordered by count, the first ones larger by one where three do not divide it."""
    placed = running_total(counts.withColumn("wl_one", F.lit(1)), [F.desc(n), F.col(key)], "wl_one", "wl_at").drop("wl_one")
    size, rest = F.floor(F.col("wl_t") / 3), F.col("wl_t") % 3
    large = rest * (size + 1)
    place = F.when(F.col("wl_at") <= large, F.ceil(F.col("wl_at") / (size + 1))).otherwise(rest + F.ceil((F.col("wl_at") - large) / size))
    total = counts.agg(F.count("*").alias("wl_t"))
    return placed.join(F.broadcast(total)).withColumn("tercile", place.cast("int")).drop("wl_at", "wl_t")


def average_percent_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank in the partition over its size, ties sharing the mean of their ranks.

    Ranks are those of the distinct values' running counts, so a partition of many rows is one row per value. Without
    ``keys`` the whole table is the partition, and its values are added up by ranges.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("wl_n"))
    if not keys:
        total = counts.agg(F.sum("wl_n").alias("wl_t"))
        upto = running_total(counts, [F.col(value)], "wl_n", "wl_u").join(F.broadcast(total))
        return df.join(upto.select(value, ((F.col("wl_u") - (F.col("wl_n") - 1) / 2) / F.col("wl_t")).alias(name)), value)
    w = Window.partitionBy(*keys)
    below = F.sum("wl_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn(name, (below - (F.col("wl_n") - 1) / 2) / F.sum("wl_n").over(w)).drop("wl_n")
    return df.join(ranks, [*keys, value])


def running_share(counts: DataFrame, n: str, key: str, name: str) -> DataFrame:
    """Cumulative share of the total, largest first; the input is one row per distinct value."""
    total = counts.agg(F.sum(n).alias("wl_t"))
    added = running_total(counts, [F.desc(n), F.col(key)], n, "wl_c")
    return added.join(F.broadcast(total)).withColumn(name, F.round(F.col("wl_c") / F.col("wl_t"), 6)).drop("wl_c", "wl_t")


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def z_scores(df: DataFrame, value: str, name: str) -> DataFrame:
    moments = df.agg(F.avg(value).alias("wl_m"), F.stddev_pop(value).alias("wl_s"))
    return df.join(F.broadcast(moments)).withColumn(name, F.try_divide(F.col(value) - F.col("wl_m"), F.col("wl_s"))).drop("wl_m", "wl_s")


def clip_confidence(df: DataFrame, support: str, quantile: float, name: str) -> DataFrame:
    """Support over its quantile, at most 1."""
    top = df.agg(F.percentile(support, quantile).alias("wl_q"))
    return df.join(F.broadcast(top)).withColumn(name, F.least(F.lit(1.0), F.col(support) / F.col("wl_q"))).drop("wl_q")


def collapse_runs(df: DataFrame, entity: str, order: list[str], state: str, unknown: str | None = None) -> DataFrame:
    """One row per run of equal states: ``segment`` (cut at the unknown state), ``run`` number, state, rows."""
    w = Window.partitionBy(entity).orderBy(*order)
    here = df.select(entity, *order, state, (F.col(state) == unknown if unknown is not None else F.lit(False)).alias("wl_u"), F.lag(state).over(w).alias("wl_p"))
    new = F.coalesce((F.col(state) != F.col("wl_p")).cast("int"), F.lit(1))
    marked = here.withColumns({"run": F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)), "segment": F.sum(F.col("wl_u").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return marked.filter(~F.col("wl_u")).groupBy(entity, "segment", "run", state).agg(F.count("*").alias("n"))
