"""Queries of the summary per person and its panels: customers with their orders as steps."""

from pyspark.sql import functions as F

from wayline.operators import persons as R
from wayline.plans.joins import _STEP, steps
from wayline.plans.registry import query, table

_STAGES = [("early", 0), ("mid", 3), ("late", 6)]
_STAGE = "CASE WHEN {0} >= 6 THEN 'late' WHEN {0} >= 3 THEN 'mid' WHEN {0} >= 0 THEN 'early' END"
_PEOPLE = f"""p AS (SELECT c_custkey AS person, c_mktsegment AS segment, CASE WHEN c_custkey % 5 > 0 THEN 1990 + c_custkey % 14 END AS grad_year FROM customer), t AS (SELECT o_custkey AS person, o_orderkey AS id, s, e, CAST(left(o_orderpriority, 1) AS INT) AS rank, o_orderpriority AS kind, year(e) >= 2001 AS ongoing FROM {_STEP}),
    a AS (SELECT person, count(*) AS n_steps, count(DISTINCT kind) AS n_employers, year(min(s)) AS entry_year, year(max(e)) AS last_year, bool_or(ongoing) AS has_current, max(rank) >= 4 AS ever_manager, max(rank) >= 5 AS ever_director FROM t GROUP BY 1), f AS (SELECT person, kind AS first_kind, rank AS first_rank FROM t QUALIFY row_number() OVER (PARTITION BY person ORDER BY s, e, id) = 1), c AS (SELECT person, kind AS current_kind, rank AS current_rank FROM t WHERE ongoing QUALIFY row_number() OVER (PARTITION BY person ORDER BY rank DESC, e - s DESC, id) = 1),
    y AS (SELECT p.*, coalesce(n_steps, 0) AS n_steps, coalesce(n_employers, 0) AS n_employers, entry_year, last_year, coalesce(has_current, FALSE) AS has_current, coalesce(ever_manager, FALSE) AS ever_manager, coalesce(ever_director, FALSE) AS ever_director, first_kind, first_rank, current_kind, current_rank, CASE WHEN entry_year BETWEEN 1950 AND 2000 THEN 2000 - entry_year END AS career_years_entry, CASE WHEN grad_year BETWEEN 1950 AND 2000 THEN 2000 - grad_year END AS career_years_grad FROM p LEFT JOIN a USING (person) LEFT JOIN f USING (person) LEFT JOIN c USING (person)),
    z AS (SELECT *, {_STAGE.format("career_years_entry")} AS career_stage_entry, {_STAGE.format("career_years_grad")} AS career_stage_grad FROM y)"""


def people(spark, d):
    key = F.col("c_custkey")
    p = table(spark, d, "customer").select(key.alias("person"), F.col("c_mktsegment").alias("segment"), F.when(key % 5 > 0, (1990 + key % 14).cast("int")).alias("grad_year"))
    return p, steps(spark, d).select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), "s", "e", F.left("o_orderpriority", F.lit(1)).cast("int").alias("rank"), F.col("o_orderpriority").alias("kind"))


def summary(spark, d):
    p, t = people(spark, d)
    return R.person_summary(p, t, "person", "grad_year", "s", "e", "id", F.year("e") >= 2001, "rank", "kind", ["kind", "rank"], {"manager": 4, "director": 5}, _STAGES, 2000)


@query("person_summary", f"WITH {_PEOPLE} SELECT * FROM z")
def person_summary(spark, d):
    return summary(spark, d)


@query(
    "states_at",
    f"""WITH {_PEOPLE}, q AS (SELECT person, axis, k, CASE axis WHEN 'entry' THEN entry_year ELSE grad_year END AS anchor FROM z CROSS JOIN (VALUES ('entry'), ('grad')) x(axis) CROSS JOIN (VALUES (0), (2), (4)) h(k)), v AS (SELECT * FROM q WHERE anchor BETWEEN 1950 AND 2000 - k),
    w AS (SELECT axis, k, v.person, kind FROM v JOIN t ON t.person = v.person AND year(s) <= anchor + k AND year(e) >= anchor + k QUALIFY row_number() OVER (PARTITION BY axis, k, v.person ORDER BY rank DESC, id) = 1)
    SELECT v.axis, v.k, v.person, kind, w.person IS NOT NULL AS has_step FROM v LEFT JOIN w ON v.axis = w.axis AND v.k = w.k AND v.person = w.person""",
)
def states_at(spark, d):
    return R.states_at(summary(spark, d), people(spark, d)[1], "person", {"entry": "entry_year", "grad": "grad_year"}, [0, 2, 4], "s", "e", "kind", [-F.col("rank"), F.col("id")], 2000)


@query("years_between", f"WITH {_PEOPLE} SELECT person, least(6, greatest(-3, entry_year - grad_year)) AS years_to_first FROM z WHERE entry_year IS NOT NULL AND grad_year IS NOT NULL")
def years_between(spark, d):
    return R.years_between(summary(spark, d), "person", "grad_year", "entry_year")


_FLOOR = 12


@query(
    "group_panels",
    f"""WITH {_PEOPLE}, g AS (SELECT z.*, grp FROM z CROSS JOIN (VALUES ('all'), ('tier1'), ('tier2')) x(grp) WHERE grp = 'all' OR (grp = 'tier1' AND segment = 'BUILDING' AND person % 3 > 0) OR (grp = 'tier2' AND segment = 'BUILDING')), l AS (SELECT grp, 'current' AS panel, current_kind AS cell FROM g UNION ALL SELECT grp, 'stage_entry', career_stage_entry FROM g UNION ALL SELECT grp, 'stage_grad', career_stage_grad FROM g UNION ALL SELECT grp, 'moves', first_kind || '>' || current_kind FROM g UNION ALL SELECT grp, 'grad', CAST(grad_year AS VARCHAR) FROM g),
    n AS (SELECT grp, panel, cell, count(*) AS n FROM l WHERE cell IS NOT NULL GROUP BY ALL), r AS (SELECT *, n < {_FLOOR} AS small, sum((n < {_FLOOR})::INT) OVER (PARTITION BY grp, panel) AS k, row_number() OVER (PARTITION BY grp, panel ORDER BY n < {_FLOOR}, n, cell) AS rk FROM n), h AS (SELECT *, small OR (k = 1 AND NOT small AND rk = 1) AS hidden FROM r),
    u AS (SELECT a.grp, a.panel, a.cell, a.n, a.hidden OR coalesce(NOT b.hidden AND b.n > a.n AND b.n - a.n < {_FLOOR}, FALSE) AS gone FROM h a LEFT JOIN h b ON b.grp = CASE a.grp WHEN 'tier1' THEN 'tier2' WHEN 'tier2' THEN 'all' END AND a.panel = b.panel AND a.cell = b.cell),
    w AS (SELECT *, sum(gone::INT) OVER (PARTITION BY grp, panel) AS k, row_number() OVER (PARTITION BY grp, panel ORDER BY gone, CASE WHEN gone THEN 0 ELSE greatest(n, {_FLOOR}) END, cell) AS rk, sum(n) OVER (PARTITION BY grp, panel) AS t FROM u), s AS (SELECT *, gone OR (k = 1 AND NOT gone AND rk = 1) AS suppressed FROM w)
    SELECT grp, panel, cell, CASE WHEN NOT suppressed THEN n END AS n, CASE WHEN NOT suppressed THEN round(n / t, 6) END AS share, suppressed FROM s""",
)
def group_panels(spark, d):
    building = F.col("segment") == "BUILDING"
    groups = {"all": F.lit(True), "tier1": building & (F.col("person") % 3 > 0), "tier2": building}
    panels = {"current": F.col("current_kind"), "stage_entry": F.col("career_stage_entry"), "stage_grad": F.col("career_stage_grad"), "moves": F.concat("first_kind", F.lit(">"), "current_kind"), "grad": F.col("grad_year")}
    return R.group_panels(summary(spark, d), groups, panels, _FLOOR, (("tier1", "tier2"), ("tier2", "all")))
