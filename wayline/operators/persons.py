"""One row per person on two time axes, and tables of counts over groups of persons that give no small cell away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.aggregates import suppress


def stage(years: Column, stages: list[tuple[str, int]]) -> Column:
    """The last stage whose first year is reached; none before the first or without years."""
    return reduce(lambda rest, s: F.when(years >= s[1], s[0]).otherwise(rest), sorted(stages, key=lambda s: s[1]), F.lit(None).cast("string"))


def person_summary(
    people: DataFrame, steps: DataFrame, person: str, grad: str, start: str, end: str, row: str, ongoing: Column, rank: str, employer: str, take: list[str],
    ever: dict[str, int], stages: list[tuple[str, int]], last_year: int, first_valid: int = 1950,
) -> DataFrame:
    """The people with what their steps tell, in one aggregation over them; people without steps stay.

    ``n_steps``, ``n_employers``, ``entry_year``, ``last_year``, ``has_current``; ``ever_<name>`` for each rank of ``ever`` that
    was reached; ``first_<c>`` of the earliest step (then end, row) and ``current_<c>`` of the ongoing one of highest rank
    (then longest, then row) for the columns in ``take``; years since entry and since ``grad``, up to ``last_year`` and for
    anchors from ``first_valid`` on, each with its stage.
    """
    held = F.datediff(end, start)
    early = F.struct(F.col(start), F.col(end), F.col(row))
    best = F.struct((-F.coalesce(F.col(rank).cast("double"), F.lit(float("-inf")))).alias("r"), (-held).alias("t"), F.col(row).alias("i"))
    values = F.struct(*take)
    per = steps.groupBy(person).agg(
        F.count("*").alias("n_steps"), F.count_distinct(employer).alias("n_employers"), F.year(F.min(start)).alias("entry_year"), F.year(F.max(end)).alias("last_year"),
        F.coalesce(F.bool_or(ongoing), F.lit(False)).alias("has_current"), *(F.coalesce(F.max(rank) >= r, F.lit(False)).alias(f"ever_{n}") for n, r in ever.items()),
        F.min_by(values, early).alias("wl_f"), F.min_by(values, F.when(ongoing, best)).alias("wl_c"), F.coalesce(F.bool_or(ongoing), F.lit(False)).alias("wl_any"),
    )
    j = people.join(per, person, "left")
    since = lambda c: F.when(F.col(c).between(first_valid, last_year), last_year - F.col(c))
    axes = {"entry": since("entry_year"), "grad": since(grad)}
    return j.select(
        *(F.col(f"`{c}`") for c in people.columns), F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_employers", F.lit(0)).alias("n_employers"), "entry_year", "last_year",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_current", *(f"ever_{n}" for n in ever))),
        *(F.col(f"wl_f.{c}").alias(f"first_{c}") for c in take), *(F.when(F.col("wl_any"), F.col(f"wl_c.{c}")).alias(f"current_{c}") for c in take),
        *(c.alias(f"career_years_{a}") for a, c in axes.items()), *(stage(c, stages).alias(f"career_stage_{a}") for a, c in axes.items()),
    )


def states_at(people: DataFrame, steps: DataFrame, person: str, anchors: dict[str, str], horizons: list[int], start: str, end: str, state: str, order: list[Column], last_year: int, first_valid: int = 1950) -> DataFrame:
    """``axis``, ``k``, person and the ``state`` of the step active k years after the anchor, for anchors old enough; null without such a step.

    All axes and horizons are asked in one join with the steps; of several steps the first by ``order`` counts.
    """
    asked = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(k).alias("k"), F.col(c).alias("anchor")) for a, c in anchors.items() for k in horizons)))
    asks = people.select(person, asked.alias("q")).select(person, "q.*").filter(F.col("anchor").between(first_valid, F.lit(last_year) - F.col("k")))
    at = F.col("anchor") + F.col("k")
    spans = steps.select(person, F.year(start).alias("wl_y0"), F.coalesce(F.year(end), F.lit(last_year + 1)).alias("wl_y1"), F.col(state).alias("wl_state"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("wl_o"))
    held = asks.join(spans, person).filter((F.col("wl_y0") <= at) & (F.col("wl_y1") >= at)).groupBy(person, "axis", "k").agg(F.min_by("wl_state", "wl_o").alias(state), F.lit(True).alias("wl_has"))
    return asks.drop("anchor").join(held, [person, "axis", "k"], "left").select("axis", "k", person, state, F.coalesce("wl_has", F.lit(False)).alias("has_step"))


def years_between(people: DataFrame, person: str, anchor: str, first: str, low: int = -3, high: int = 6) -> DataFrame:
    """Years from an anchor to the first step, those beyond the ends in the end classes; people without either are left out."""
    kept = people.filter(F.col(anchor).isNotNull() & F.col(first).isNotNull())
    return kept.select(person, F.least(F.lit(high), F.greatest(F.lit(low), F.col(first) - F.col(anchor))).alias("years_to_first"))


def group_panels(people: DataFrame, groups: dict[str, Column], panels: dict[str, Column], floor: int, nested: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``grp``, ``panel``, ``cell``, ``n``, ``share`` and ``suppressed`` (then without numbers): every panel of every group in one pass.

    A person counts in each group whose condition holds, and in each panel that has a value. Cells under the ``floor`` are
    hidden, and the next smallest of a panel that has just one such cell. ``nested`` are (inner, outer) groups: where both
    show a cell and the difference is under the floor, the outer's total gives those few away, so the inner cell is hidden
    too, and then again another where it is the only one of its panel.
    """
    tags = F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in groups.items())))
    cells = F.filter(F.array(*(F.struct(F.lit(p).alias("panel"), c.cast("string").alias("cell")) for p, c in panels.items())), lambda x: x["cell"].isNotNull())
    laid = people.select(F.explode(tags).alias("grp"), cells.alias("wl_c")).select("grp", F.explode("wl_c").alias("x"))
    counts = laid.groupBy("grp", "x.panel", "x.cell").agg(F.count("*").alias("n"))
    shown = suppress(counts, ["grp", "panel"], "n", floor, "cell")
    if nested:
        pairs = F.create_map(*(F.lit(x) for pair in nested for x in pair))
        inner = shown.withColumn("outer", F.try_element_at(pairs, F.col("grp")))
        outer = shown.select(F.col("grp").alias("outer"), "panel", "cell", F.col("n").alias("wl_n"), F.col("suppressed").alias("wl_hidden"))
        j = inner.join(outer, ["outer", "panel", "cell"], "left")
        gives = ~F.col("suppressed") & ~F.col("wl_hidden") & (F.col("wl_n") > F.col("n")) & (F.col("wl_n") - F.col("n") < floor)
        marked = j.withColumn("wl_gives", F.coalesce(gives, F.lit(False))).select("grp", "panel", "cell", "n", "suppressed", "wl_gives")
        # A hidden cell counts as none for the second rule, so that it is the smallest of its panel.
        again = suppress(marked.withColumn("wl_k", F.when(F.col("wl_gives") | F.col("suppressed"), F.lit(0)).otherwise(F.greatest(F.col("n"), F.lit(floor)))), ["grp", "panel"], "wl_k", max(1, floor), "cell")
        shown = again.select("grp", "panel", "cell", "n", "suppressed")
    totals = counts.groupBy("grp", "panel").agg(F.sum("n").alias("wl_t"))
    out = shown.join(totals, ["grp", "panel"])
    see = lambda c: F.when(~F.col("suppressed"), c)
    return out.select("grp", "panel", "cell", see(F.col("n")).alias("n"), see(F.round(F.col("n") / F.col("wl_t"), 6)).alias("share"), "suppressed")
