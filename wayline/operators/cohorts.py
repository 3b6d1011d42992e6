"""What members of overlapping groups do after an anchor year: outcomes, choices, later moves, first entries, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.aggregates import single_group


def _relative(members: DataFrame, rows: DataFrame, entity: str, year: str) -> DataFrame:
    """Rows of members, with ``wl_k``: years since the member's ``anchor``. A member of several groups has its rows in each."""
    return members.select(entity, "grp", "anchor").join(rows, entity).withColumn("wl_k", F.col(year) - F.col("anchor"))


def facet_shares(members: DataFrame, rows: DataFrame, entity: str, year: str, facets: Column, horizon: int, last_year: int, baseline: str, floor: int) -> DataFrame:
    """Per group and facet: entities with such a row within ``horizon`` years of the anchor, share of the group, and that relative to the baseline's.

    Only anchors whose whole horizon is known count; ``facets`` is the array of a row's facets. Facets of fewer than
    ``floor`` entities are left out, after the baseline's shares are taken.
    """
    cohort = members.filter(F.col("anchor") <= last_year - horizon)
    size = cohort.groupBy("grp").agg(F.count("*").alias("cohort"))
    inside = _relative(cohort, rows, entity, year).filter(F.col("wl_k").between(0, horizon))
    counts = inside.select("grp", entity, F.explode(F.array_distinct(facets)).alias("facet")).groupBy("grp", "facet").agg(F.count_distinct(entity).alias("n"))
    shares = counts.join(size, "grp").withColumn("share", F.col("n") / F.col("cohort"))
    base = shares.filter(F.col("grp") == baseline).select("facet", F.col("share").alias("wl_b"))
    out = shares.join(base, "facet", "left").filter(F.col("n") >= floor)
    return out.select("grp", "facet", "cohort", "n", F.round("share", 6).alias("share"), F.round(F.try_divide("share", "wl_b"), 6).alias("rr"))


def choice_flags(members: DataFrame, rows: DataFrame, entity: str, year: str, choices: dict[str, tuple[Column, int, int | None]]) -> DataFrame:
    """One row per group and member: for each choice whether a row of it lies in its window of years after the anchor, and years to the first.

    ``choices`` maps a name to (condition, first year, last year or None). Members without rows have chosen nothing.
    """
    aggs = []
    for name, (holds, lo, hi) in choices.items():
        inside = F.coalesce(holds, F.lit(False)) & (F.col("wl_k") >= lo) & (F.col("wl_k") <= hi if hi is not None else F.lit(True))
        aggs.append(F.min(F.when(inside, F.col("wl_k"))).alias(f"{name}_years"))
    found = _relative(members, rows, entity, year).groupBy("grp", entity).agg(*aggs)
    j = members.select("grp", entity).join(found, ["grp", entity], "left")
    return j.select("grp", entity, *(F.col(f"{n}_years").isNotNull().alias(n) for n in choices), *(f"{n}_years" for n in choices))


def subset_fans(flags: DataFrame, choices: list[str], panel: DataFrame, members: DataFrame, entity: str, year: str, state: str, at: int, floor: int) -> DataFrame:
    """Per group and choice: states ``at`` years after the anchor of those who chose it, their share, and that over the whole group's.

    States of fewer than ``floor`` choosers are left out.
    """
    then = _relative(members, panel, entity, year).filter((F.col("wl_k") == at) & F.col(state).isNotNull()).select("grp", entity, state)
    names = F.array_compact(F.array(F.lit("all"), *(F.when(F.col(c), F.lit(c)) for c in choices)))
    counts = then.join(flags, ["grp", entity]).withColumn("choice", F.explode(names)).groupBy("grp", "choice", state).agg(F.count("*").alias("n"))
    totals = counts.groupBy("grp", "choice").agg(F.sum("n").alias("t"))
    shares = counts.join(totals, ["grp", "choice"]).withColumn("share", F.col("n") / F.col("t"))
    base = shares.filter("choice = 'all'").select("grp", state, F.col("share").alias("b"))
    out = shares.join(base, ["grp", state]).filter((F.col("choice") != "all") & (F.col("n") >= floor))
    return out.select("grp", "choice", state, "n", F.round("share", 6).alias("share"), F.round(F.col("share") / F.col("b"), 6).alias("rr"))


def mover_outcomes(members: DataFrame, moves: DataFrame, panel: DataFrame, entity: str, year: str, value: str, state: str, early: tuple[int, int], late: tuple[int, int], outcome: int, last_year: int) -> DataFrame:
    """Per group and class of early moves (0, 1, 2+): later value and gain, pace and gaps of later moves, breadth of states.

    ``moves`` has entity, year, ``dwell_months`` and ``has_gap``. Values need an anchor whose ``outcome`` year is known, later
    moves and breadth one whose ``late`` window is.
    """
    cohort = members.filter(F.col("anchor") <= last_year - outcome)
    after = _relative(cohort, moves, entity, year)
    n = after.filter(F.col("wl_k").between(*early)).groupBy("grp", entity).agg(F.count("*").alias("wl_n"))
    label = F.when(F.coalesce("wl_n", F.lit(0)) == 0, "0").when(F.col("wl_n") == 1, "1").otherwise("2+")
    classes = cohort.join(n, ["grp", entity], "left").select("grp", entity, "anchor", label.alias("mover"))
    at = _relative(cohort, panel, entity, year)
    ends = at.filter(F.col("wl_k").isin(0, outcome)).groupBy("grp", entity).agg(*(F.max(F.when(F.col("wl_k") == k, F.col(value))).alias(c) for k, c in ((0, "v0"), (outcome, "v1"))))
    by = ["grp", "mover"]
    first = classes.join(ends, ["grp", entity], "left").groupBy(by).agg(F.count("v1").alias("n"), F.round(F.median("v1"), 4).alias("median_value"), F.round(F.median("v1") - F.median("v0"), 4).alias("median_gain"))
    whole = classes.filter(F.col("anchor") <= last_year - late[1]).drop("anchor")
    pace = after.filter(F.col("wl_k").between(*late)).join(whole, ["grp", entity]).groupBy(by)
    pace = pace.agg(F.count("*").alias("late_moves"), F.round(F.median("dwell_months"), 1).alias("late_dwell"), F.round(F.avg(F.col("has_gap").cast("int")), 4).alias("late_gap_share"))
    seen = at.filter(F.col("wl_k").between(0, outcome)).join(whole, ["grp", entity]).groupBy(*by, entity).agg(F.count_distinct(state).alias("s"))
    breadth = seen.groupBy(by).agg(F.count("*").alias("explorers"), F.round(F.avg("s"), 4).alias("states"))
    return first.join(pace, by, "left").join(breadth, by, "left")


def first_entry_years(members: DataFrame, panel: DataFrame, entity: str, year: str, state: str, at: int, floor: int) -> DataFrame:
    """Per group and state held ``at`` years after the anchor: entities, and the median year in which they first held it."""
    rows = _relative(members, panel, entity, year)
    first = rows.filter(F.col("wl_k") >= 0).groupBy("grp", entity, state).agg(F.min("wl_k").alias("f"))
    held = rows.filter(F.col("wl_k") == at).select("grp", entity, state).join(first, ["grp", entity, state])
    return held.groupBy("grp", state).agg(F.count("*").alias("n"), F.median("f").alias("median_first_year")).filter(F.col("n") >= floor)


def named_paths(members: DataFrame, panel: DataFrame, entity: str, year: str, state: str, horizon: int, low: int, high: int, fans: DataFrame, floor: int, suppress_floor: int, most: int) -> DataFrame:
    """Per group the ``most`` usual paths of ``low`` to ``high`` states: ``path``, ``persons``, ``unexpected``, ``suppressed``.

    Equal states in a row are one; a year without a state breaks a path. Paths of ``floor`` entities are shown; ``suppressed``
    counts the group's others from ``suppress_floor`` on. ``fans`` has the group's usual last states (``grp``, ``state``).
    """
    w = Window.partitionBy("grp", entity).orderBy("wl_k")
    rows = _relative(members, panel, entity, year).filter(F.col("wl_k").between(0, horizon) & F.col(state).isNotNull()).select("grp", entity, "wl_k", F.col(state).alias("s"))
    broken = F.coalesce(F.col("wl_k") - F.lag("wl_k").over(w) > 1, F.lit(True))
    runs = rows.withColumn("cut", F.sum(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy("grp", entity, "cut").orderBy("wl_k")
    kept = runs.withColumn("p", F.lag("s").over(v)).filter(F.col("p").isNull() | (F.col("p") != F.col("s")))
    wide = kept.select("grp", entity, F.array(*(F.lead("s", k).over(v) for k in range(high))).alias("a"))
    grams = F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.slice("a", 1, k)), lambda g: ~F.exists(g, lambda x: x.isNull()))
    paths = wide.select("grp", entity, F.explode(grams).alias("g")).distinct().groupBy("grp", "g").agg(F.count("*").alias("persons"))
    hidden = paths.filter((F.col("persons") < floor) & (F.col("persons") >= suppress_floor)).groupBy("grp").agg(F.count("*").alias("suppressed"))
    order = Window.partitionBy("grp").orderBy(F.desc("persons"), "path")
    shown = paths.filter(F.col("persons") >= floor).select("grp", F.array_join("g", ">").alias("path"), F.element_at("g", -1).alias("state"), "persons")
    shown = shown.withColumn("wl_r", F.row_number().over(order)).filter(F.col("wl_r") <= most).drop("wl_r")
    known = fans.select("grp", "state", F.lit(True).alias("known")).distinct()
    j = shown.join(known, ["grp", "state"], "left").join(hidden, "grp", "left")
    return j.select("grp", "path", "persons", F.col("known").isNull().alias("unexpected"), F.coalesce("suppressed", F.lit(0)).alias("suppressed"))


def single_group_rows(entities: DataFrame, group: str, rows: DataFrame, entity: str, anchor: str, year: Column, window: int, text: str, least: int, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of entities of one group only, within ``window`` years of the anchor and with ``least`` characters of text, one per key."""
    one = single_group(entities, entity, group).join(entities.groupBy(entity).agg(F.min(anchor).alias("wl_a")), entity)
    inside = rows.join(one, entity).filter(year.between(F.col("wl_a"), F.col("wl_a") + window) & (F.length(F.trim(text)) >= least)).drop("wl_a")
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return inside.withColumn("wl_rn", rn).filter("wl_rn = 1").drop("wl_rn")
