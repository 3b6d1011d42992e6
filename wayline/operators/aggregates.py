"""Aggregates: deterministic modes, diversity, fans, suppression, cubes over overlapping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.windows import running_total


def top_value(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Per key the most frequent value (the least on a tie), its ``support`` and the key's ``total``; nulls don't count.

    Counts go before the choice, so a frequent key is one row per value when it is chosen.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("wl_n"))
    least = F.min(F.struct((-F.col("wl_n")).alias("n"), F.col(value).alias("v")))
    top = counts.groupBy(*keys).agg(least.alias("wl_t"), F.sum("wl_n").alias("total"))
    return top.select(*keys, F.col("wl_t.v").alias(value), (-F.col("wl_t.n")).alias("support"), "total")


def dominant(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The most frequent value where it holds at least ``share`` of the key's rows, else null."""
    top = top_value(df, keys, value)
    return top.select(*keys, F.when(F.col("support") >= share * F.col("total"), F.col(value)).alias(name), "support", "total")


def capped_list(df: DataFrame, keys: list[str], value: str, order: list[Column], most: int, name: str) -> DataFrame:
    """The first ``most`` values per key in order, as a list."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.select(*keys, F.col(value).alias("wl_v"), F.row_number().over(w).alias("wl_rn")).filter(F.col("wl_rn") <= most)
    listed = F.array_sort(F.collect_list(F.struct("wl_rn", "wl_v")))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["wl_v"]).alias(name))


def overlapping_cube(df: DataFrame, groups: dict[str, Column], keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates per named group and keys; a row counts in every group whose condition holds."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in groups.items()]))
    return df.withColumn("grp", F.explode(tags)).groupBy("grp", *keys).agg(*aggregates)


def single_group(df: DataFrame, entity: str, group: str) -> DataFrame:
    """Entities whose rows all lie in one group, with that group."""
    per = df.groupBy(entity).agg(F.count_distinct(group).alias("wl_n"), F.min(group).alias(group))
    return per.filter("wl_n = 1").drop("wl_n")


def diversity(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: categories, Shannon entropy, effective number (inverse Simpson), share of the top three, categories for 80 %."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(F.desc("n"), value)
    shares = counts.withColumns({"p": F.col("n") / F.sum("n").over(w), "rn": F.row_number().over(ordered)})
    shares = shares.withColumn("before", F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(w))
    return shares.groupBy(*keys).agg(
        F.count("*").alias("categories"),
        F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"),
        F.round(1 / F.sum(F.col("p") * F.col("p")), 6).alias("effective"),
        F.round(F.sum(F.when(F.col("rn") <= 3, F.col("p"))), 6).alias("top3"),
        F.count(F.when(F.col("before") < 0.8 - 1e-12, 1)).alias("cover80"),
    )


def cluster_balance(df: DataFrame, cluster: str, weight: str) -> DataFrame:
    """How evenly weight lies over clusters: ``clusters``, ``effective`` (exponential of the entropy), ``largest_share``; no weight, no share."""
    per = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(weight).alias("w")).filter("w > 0")
    share = per.join(F.broadcast(per.agg(F.sum("w").alias("t")))).select((F.col("w") / F.col("t")).alias("p"))
    return share.agg(F.count("*").alias("clusters"), F.round(F.exp(-F.sum(F.col("p") * F.ln("p"))), 6).alias("effective"), F.round(F.max("p"), 6).alias("largest_share"))


def destination_fan(df: DataFrame, group: str, value: str, baseline: str) -> DataFrame:
    """Per group and destination: count, share of the group, and share relative to the baseline group's."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    shares = counts.join(totals, group).withColumn("share", F.col("n") / F.col("total"))
    base = shares.filter(F.col(group) == baseline).select(value, F.col("share").alias("base"))
    return shares.join(base, value, "left").select(group, value, "n", F.round("share", 6).alias("share"), F.round(F.try_divide("share", "base"), 6).alias("rr"))


def fold_tail(df: DataFrame, keys: list[str], value: str, n: str, most: int, other: str = "Other") -> DataFrame:
    """Counts of the ``most`` largest values per key, the rest added up as ``other``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), value)
    ranked = df.withColumn("wl_rn", F.row_number().over(w))
    label = F.when(F.col("wl_rn") > most, F.lit(other)).otherwise(F.col(value))
    return ranked.groupBy(*keys, label.alias(value)).agg(F.sum(n).alias(n))


def suppress(df: DataFrame, panel: list[str], n: str, floor: int, tie: str) -> DataFrame:
    """Add ``suppressed``: cells below the floor, and if a panel has exactly one such cell, its next smallest too."""
    w = Window.partitionBy(*panel)
    small = F.col(n) < floor
    out = df.withColumn("wl_small", small).withColumn("wl_count", F.sum(F.col("wl_small").cast("int")).over(w))
    rank = F.row_number().over(w.orderBy(F.col("wl_small"), n, tie))
    out = out.withColumn("wl_rank", rank)
    second = (F.col("wl_count") == 1) & ~F.col("wl_small") & (F.col("wl_rank") == 1)
    return out.withColumn("suppressed", F.col("wl_small") | second).drop("wl_small", "wl_count", "wl_rank")


def concentration(df: DataFrame, key: str, buckets: list[tuple[str, int, int | None]]) -> DataFrame:
    """Keys and rows per size bucket of key counts."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    label = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        label = F.when((F.col("n") >= low) & (F.lit(True) if high is None else F.col("n") < high), F.lit(name)).otherwise(label)
    return sizes.groupBy(label.alias("bucket")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def midpoint_percentile(groups: DataFrame, baseline: DataFrame, group: str, x: str, v: str) -> DataFrame:
    """Where each group's ``x`` stands in the baseline's values: 100 (below + half of equal) / all.

    Values' counts and groups are added up in one order, each group before the values equal to its own; no group meets the
    values one by one.
    """
    nobody = F.lit(None).cast(groups.schema[group].dataType)
    counts = baseline.groupBy(F.col(v).cast("double").alias("wl_v")).agg(F.count("*").alias("wl_n"))
    rows = counts.select("wl_v", "wl_n", nobody.alias(group), F.lit(1).alias("wl_k"))
    rows = rows.unionByName(groups.select(F.col(x).cast("double").alias("wl_v"), F.lit(0).cast("long").alias("wl_n"), group, F.lit(0).alias("wl_k")))
    below = running_total(rows, [F.col("wl_v"), F.col("wl_k"), F.col(group)], "wl_n", "wl_below").filter("wl_k = 0").select(group, "wl_v", "wl_below")
    placed = below.join(counts.withColumnRenamed("wl_n", "wl_e"), "wl_v", "left").join(F.broadcast(counts.agg(F.sum("wl_n").alias("wl_t"))))
    at = F.round(100 * (F.col("wl_below") + F.coalesce("wl_e", F.lit(0)) / 2) / F.col("wl_t"), 6)
    return placed.select(group, F.col("wl_v").cast(groups.schema[x].dataType).alias(x), at.alias("percentile"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    top = top_value(df, [cluster], label)
    return top.select(cluster, label, F.round(F.col("support") / F.col("total"), 6).alias("purity"), "total")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-free checksums of all columns: rows that stand twice cancel in the first, not in the second."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(row).alias("checksum"), F.sum(row.cast("decimal(20,0)")).alias("total"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """The same of rows as text, by MD5, which any engine can repeat: ``rows``, ``checksum`` (exclusive or) and ``total`` (a decimal as text).

    A row is its columns in order with | between: numbers with a fraction to six places, times to the second, null as \\N.
    """
    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.format_string("%.6f", c.cast("double"))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.col(f"`{name}`").isNull(), "\\N").otherwise(c.cast("string"))

    digits = F.left(F.md5(F.concat_ws("|", *(text(n, k) for n, k in df.dtypes))), F.lit(15))
    mark = F.conv(digits, 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(mark).alias("checksum"), F.coalesce(F.sum(mark.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"))
