"""Entity histories: typed intervals, transitions, anchors, panels, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def months_between(a: Column, b: Column) -> Column:
    """Month boundaries from a to b."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def parse_month(text: Column) -> Column:
    """A date from 'Jan 2018' (the first of the month) or '2018' (1 January), else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("MMM yyyy")), F.try_to_timestamp(text, F.lit("yyyy"))).cast("date")


def interval_steps(df: DataFrame, start: str, end: str, open_value: str, today: str) -> DataFrame:
    """Typed steps from text dates: start_dt, end_dt (open ends at ``today``, year ends in December), granularity, flags, tenure."""
    year_end = F.col(end).rlike("^[0-9]{4}$")
    ongoing = F.coalesce(F.col(end) == open_value, F.lit(False))
    e = parse_month(F.col(end))
    out = df.withColumns({
        "start_dt": parse_month(F.col(start)),
        "end_dt": F.when(ongoing, F.lit(today).cast("date")).when(year_end, F.make_date(F.year(e), F.lit(12), F.lit(31))).otherwise(F.last_day(e)),
        "granularity": F.when(F.col(start).rlike("^[0-9]{4}$"), "year").when(parse_month(F.col(start)).isNotNull(), "month"),
        "is_ongoing": ongoing,
    })
    datable = F.col("start_dt").isNotNull() & F.col("end_dt").isNotNull()
    return out.withColumns({
        "datable": datable,
        "bad_negative_duration": F.coalesce(datable & (F.col("end_dt") < F.col("start_dt")), F.lit(False)),
        "bad_future_start": F.coalesce(F.col("start_dt") > F.lit(today).cast("date"), F.lit(False)),
        "tenure_months": F.when(datable & (F.col("end_dt") >= F.col("start_dt")), months_between(F.col("start_dt"), F.col("end_dt")) + 1),
    })


def fused_score(layers: list[tuple[Column, float]], agreement: float = 0.1) -> tuple[Column, Column]:
    """Weighted mean of the layers that are there, and a confidence with a bonus where they agree."""
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in layers), F.lit(0.0))
    value = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in layers), F.lit(0.0))
    known = F.array_compact(F.array(*(v for v, _ in layers)))
    spread = F.array_max(known) - F.array_min(known)
    bonus = F.when((F.size(known) > 1) & (spread < 0.2), agreement).otherwise(0.0)
    score = F.try_divide(value, weight)
    return score, F.when(score.isNotNull(), F.least(F.lit(1.0), weight / sum(w for _, w in layers) * 0.9 + bonus))


def transitions(steps: DataFrame, entity: str, row: str, start: str, end: str, attributes: list[str]) -> DataFrame:
    """Edges between successive steps: from_ and to_ attributes, dwell, gap and overlap. One sort per entity.

    Months count from the floors of both boundaries, so that a step that begins in the month its predecessor ends in, or in
    the next, has no gap; from two common months on there is an overlap.
    """
    w = Window.partitionBy(entity).orderBy(start, end, row)
    taken = [row, start, end, *attributes]
    nexts = {f"to_{c}": F.lead(c).over(w) for c in taken}
    out = steps.select(entity, *(F.col(c).alias(f"from_{c}") for c in taken), *(v.alias(k) for k, v in nexts.items()))
    out = out.filter(F.col(f"to_{row}").isNotNull())
    apart = months_between(F.col(f"from_{end}"), F.col(f"to_{start}"))
    return out.withColumns({
        "gap_months": F.greatest(apart - 1, F.lit(0)),
        "overlap_months": F.greatest(1 - apart, F.lit(0)),
        "has_gap": apart - 1 >= 1,
        "has_overlap": 1 - apart >= 2,
        "dwell_months": months_between(F.col(f"from_{start}"), F.col(f"from_{end}")) + 1,
    })


# The kinds of employment that end or leave a career, and those of one's own business.
EXITS = ("retired", "unemployed", "homemaker", "career_break")
SELF_EMPLOYED = ("self_employed", "business_owner")


def transition_types(edges: DataFrame, employment: str, company: str, major: str, ordinal: str, score: str, confidence: str, up: float = 0.08, down: float = 0.12, least: float = 0.3) -> DataFrame:
    """Add what kind of move each edge is, from its from_ and to_ columns of these names.

    ``kind``: exit, entry to education, into or out of self-employment, then promotion, demotion or lateral inside a company,
    else move. ``transition_type`` tells changes of occupation apart and gives a direction only where the fused scores differ
    by more than ``up`` or ``down`` at a confidence of ``least``. ``direction_from_lexical`` marks edges with both ordinals.
    """
    a, b = (lambda c: F.col(f"from_{c}")), (lambda c: F.col(f"to_{c}"))
    leaves, studies = b(employment).isin(*EXITS), b(employment) == "student"
    own_from, own_to = a(employment).isin(*SELF_EMPLOYED), b(employment).isin(*SELF_EMPLOYED)
    same_company = (a(company) == b(company)) & ~a(company).startswith("nonorg:")
    delta, sure = b(score) - a(score), F.least(F.coalesce(a(confidence), F.lit(0.0)), F.coalesce(b(confidence), F.lit(0.0)))
    rises, falls = (sure >= least) & (delta > up), (sure >= least) & (delta < -down)
    by_axis = F.when(leaves, "exit").when(studies, "education_entry").when(~own_from & own_to, "into_self_employment").when(own_from & ~own_to, "out_of_self_employment")
    inside = F.when(b(ordinal) > a(ordinal), "promotion").when(b(ordinal) < a(ordinal), "demotion").otherwise("lateral")
    fused = (
        by_axis.when(a(major) != b(major), F.when(rises, "occupation_change_up").when(falls, "occupation_change_down").otherwise("occupation_change"))
        .when(same_company, F.when(rises, "promotion").when(falls, "demotion").otherwise("lateral"))
        .otherwise(F.when(rises, "employer_move_up").when(falls, "employer_move_down").when(sure >= least, "employer_move_lateral").otherwise("employer_move"))
    )
    ruled = F.coalesce(leaves | studies | (own_from != own_to), F.lit(False))
    directed = F.coalesce((sure >= least) & (F.abs(delta) > up), F.lit(False))
    return edges.withColumns({
        "direction": direction(a(ordinal), b(ordinal)),
        "kind": by_axis.when(same_company, inside).otherwise("move"),
        "delta_score": F.round(delta, 4),
        "score_confidence": F.round(sure, 3),
        "transition_type": fused,
        "direction_from_lexical": a(ordinal).isNotNull() & b(ordinal).isNotNull(),
        "transition_confidence": F.when(ruled, 0.95).when(directed, F.round(0.5 + 0.5 * sure, 3)).otherwise(F.round(0.4 * sure, 3)),
    })


def direction(a: Column, b: Column, dead_band: float = 0) -> Column:
    return F.when(a.isNull() | b.isNull(), "unknown").when(b - a > dead_band, "up").when(a - b > dead_band, "down").otherwise("flat")


def anchor_tiers(df: DataFrame, entity: str, tiers: list[tuple[str, Column]]) -> DataFrame:
    """Per entity the earliest value of the first tier that has one, and that tier's label."""
    mins = df.groupBy(entity).agg(*(F.min(v).alias(label) for label, v in tiers))
    source = F.lit(None).cast("string")
    for label, _ in reversed(tiers):
        source = F.when(F.col(label).isNotNull(), label).otherwise(source)
    return mins.select(entity, F.coalesce(*(F.col(label) for label, _ in tiers)).alias("anchor"), source.alias("tier")).filter("anchor IS NOT NULL")


def membership(df: DataFrame, entity: str, groups: dict[str, Column]) -> DataFrame:
    """One row per entity and group it belongs to."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()]))
    return df.select(entity, F.explode(tags).alias("grp")).distinct()


def year_panel(steps: DataFrame, entity: str, start: str, end: str, order: list[Column], take: list[str]) -> DataFrame:
    """One row per entity and calendar year that a step covers, the first step by order."""
    valid = steps.filter(F.col(start).isNotNull() & (F.year(start) <= F.year(end)))
    years = valid.withColumn("cal_year", F.explode(F.sequence(F.year(start), F.year(end))))
    rn = F.row_number().over(Window.partitionBy(entity, "cal_year").orderBy(*order))
    return years.withColumn("wl_rn", rn).filter("wl_rn = 1").select(entity, "cal_year", *take)


def occupancy(panel: DataFrame, cohort: str, year: str, state: str) -> DataFrame:
    counts = panel.groupBy(cohort, year, state).agg(F.count("*").alias("n"))
    totals = counts.groupBy(cohort, year).agg(F.sum("n").alias("total"))
    return counts.join(totals, [cohort, year]).select(cohort, year, state, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def median_curve(panel: DataFrame, members: DataFrame, entity: str, year: str, value: str, offsets: list[int], floor: int) -> DataFrame:
    """Median of a value at years after the anchor, per group; cells of fewer than ``floor`` entities are emptied."""
    grid = members.withColumn("k", F.explode(F.array(*map(F.lit, offsets)))).withColumn(year, F.col("anchor") + F.col("k"))
    cells = grid.join(panel.select(entity, year, value), [entity, year]).groupBy("grp", "k").agg(F.count("*").alias("n"), F.median(value).alias("m"))
    return cells.select("grp", "k", "n", F.when(F.col("n") >= floor, F.round("m", 6)).alias("median"))


def path_ngrams(df: DataFrame, entity: str, order: list[str], state: str, low: int, high: int) -> DataFrame:
    """Contiguous paths of collapsed states, their rows and distinct entities."""
    w = Window.partitionBy(entity).orderBy(*order)
    moved = df.withColumn("wl_p", F.lag(state).over(w)).filter(F.col("wl_p").isNull() | (F.col("wl_p") != F.col(state)))
    cells = [F.lead(state, k).over(w) for k in range(high)]
    wide = moved.select(entity, F.array(*cells).alias("wl_s"))
    grams = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.slice("wl_s", 1, k))
    whole = F.filter(grams, lambda g: ~F.exists(g, lambda x: x.isNull()))
    paths = wide.select(entity, F.explode(whole).alias("g")).select(entity, F.array_join("g", ">").alias("path"), F.size("g").alias("length"))
    per = paths.groupBy("path", "length", entity).agg(F.count("*").alias("n"))
    return per.groupBy("path", "length").agg(F.sum("n").alias("n"), F.count("*").alias("persons"))


def motif_lift(tri: DataFrame, least: int) -> DataFrame:
    """Triples against the first-order expectation n(a,b) n(b,c) / n(b)."""
    abc = tri.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    ab = abc.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    bc = abc.groupBy("b", "c").agg(F.sum("n").alias("n_bc"))
    b = abc.groupBy("b").agg(F.sum("n").alias("n_b"))
    out = abc.join(ab, ["a", "b"]).join(bc, ["b", "c"]).join(b, "b").filter(F.col("n") >= least)
    return out.select("a", "b", "c", "n", F.round(F.col("n") * F.col("n_b") / (F.col("n_ab") * F.col("n_bc")), 6).alias("lift"))


def perplexities(tri: DataFrame, test: Column) -> DataFrame:
    """Held-out perplexity of c given b, and given a and b, with add-one smoothing over the states seen in training."""
    t = tri.withColumn("wl_test", test)
    train = t.filter(~F.col("wl_test")).groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    held = t.filter("wl_test").groupBy("a", "b", "c").agg(F.count("*").alias("m"))
    n_bc = train.groupBy("b", "c").agg(F.sum("n").alias("n_bc"))
    n_b = train.groupBy("b").agg(F.sum("n").alias("n_b"))
    n_ab = train.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    states = train.agg(F.count_distinct("c").alias("v"))
    j = held.join(n_bc, ["b", "c"], "left").join(n_b, "b", "left").join(train, ["a", "b", "c"], "left").join(n_ab, ["a", "b"], "left").join(F.broadcast(states)).na.fill(0)
    first = F.ln((F.col("n_bc") + 1) / (F.col("n_b") + F.col("v")))
    second = F.ln((F.col("n") + 1) / (F.col("n_ab") + F.col("v")))
    per = lambda x: F.round(F.exp(-F.sum(F.col("m") * x) / F.sum("m")), 6)
    return j.agg(F.sum("m").alias("tested"), per(first).alias("order1"), per(second).alias("order2"))
