"""Queries of cohorts: customers from their first year on, in overlapping groups."""

from pyspark.sql import functions as F

from wayline.operators import cohorts as H
from wayline.operators import trajectories as D
from wayline.operators.classifiers import mean_vectors
from wayline.operators.windows import salted_sample
from wayline.plans.joins import _STEP
from wayline.plans.registry import query, table
from wayline.plans.trajectories import _EDGE, _GROUPS_SQL, _PANEL, edges, groups, panel

_MEMBERS = f"g AS ({_GROUPS_SQL}), f AS (SELECT o_custkey, year(min(o_orderdate)) AS anchor FROM orders GROUP BY 1), mb AS (SELECT grp, o_custkey, anchor FROM g JOIN f ON o_custkey = c_custkey)"


def members(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("anchor"))
    return D.membership(table(spark, d, "customer"), "c_custkey", groups()).withColumnRenamed("c_custkey", "o_custkey").join(first, "o_custkey")


def yearly(spark, d):
    return table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))


@query(
    "facet_shares",
    f"""WITH {_MEMBERS}, c AS (SELECT * FROM mb WHERE anchor <= 1998), z AS (SELECT grp, count(*) AS cohort FROM c GROUP BY 1), i AS (SELECT grp, c.o_custkey, o_orderstatus, o_totalprice FROM c JOIN orders o ON o.o_custkey = c.o_custkey WHERE year(o_orderdate) - anchor BETWEEN 0 AND 3),
    l AS (SELECT grp, o_custkey, 'any' AS facet FROM i UNION ALL SELECT grp, o_custkey, 'status:' || o_orderstatus FROM i UNION ALL SELECT grp, o_custkey, 'large' FROM i WHERE o_totalprice > 300000), n AS (SELECT grp, facet, count(DISTINCT o_custkey) AS n FROM l GROUP BY 1, 2), s AS (SELECT grp, facet, cohort, n, n / cohort AS share FROM n JOIN z USING (grp))
    SELECT s.grp, s.facet, s.cohort, s.n, round(s.share, 6) AS share, round(s.share / b.share, 6) AS rr FROM s LEFT JOIN s b ON b.grp = 'all' AND b.facet = s.facet WHERE s.n >= 5""",
)
def facet_shares(spark, d):
    facets = F.array_compact(F.array(F.lit("any"), F.concat(F.lit("status:"), "o_orderstatus"), F.when(F.col("o_totalprice") > 300000, "large")))
    return H.facet_shares(members(spark, d), yearly(spark, d), "o_custkey", "y", facets, 3, 2001, "all", 5)


_FLAGS = f"""{_MEMBERS}, fl AS (SELECT mb.grp, mb.o_custkey, min(year(o_orderdate) - anchor) FILTER (o_orderpriority = '1-URGENT' AND year(o_orderdate) - anchor BETWEEN 1 AND 3) AS urgent_years, min(year(o_orderdate) - anchor) FILTER (o_totalprice > 300000 AND year(o_orderdate) >= anchor) AS large_years FROM mb JOIN orders o ON o.o_custkey = mb.o_custkey GROUP BY 1, 2)"""


def flags(spark, d):
    choices = {"urgent": (F.col("o_orderpriority") == "1-URGENT", 1, 3), "large": (F.col("o_totalprice") > 300000, 0, None)}
    return H.choice_flags(members(spark, d), yearly(spark, d), "o_custkey", "y", choices)


@query("choice_flags", f"WITH {_FLAGS} SELECT grp, o_custkey, urgent_years IS NOT NULL AS urgent, large_years IS NOT NULL AS large, urgent_years, large_years FROM fl")
def choice_flags(spark, d):
    return flags(spark, d)


@query(
    "subset_fans",
    _PANEL + f""", {_FLAGS}, h AS (SELECT fl.*, o_orderpriority AS st FROM fl JOIN mb USING (grp, o_custkey) JOIN p ON p.o_custkey = fl.o_custkey AND cal_year = anchor + 2), l AS (SELECT grp, 'all' AS choice, st FROM h UNION ALL SELECT grp, 'urgent', st FROM h WHERE urgent_years IS NOT NULL UNION ALL SELECT grp, 'large', st FROM h WHERE large_years IS NOT NULL),
    n AS (SELECT grp, choice, st, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY grp, choice) AS share FROM l GROUP BY 1, 2, 3) SELECT n.grp, n.choice, n.st AS o_orderpriority, n.n, round(n.share, 6) AS share, round(n.share / b.share, 6) AS rr FROM n JOIN n b ON b.choice = 'all' AND b.grp = n.grp AND b.st = n.st WHERE n.choice <> 'all' AND n.n >= 3""",
)
def subset_fans(spark, d):
    return H.subset_fans(flags(spark, d), ["urgent", "large"], panel(spark, d), members(spark, d), "o_custkey", "cal_year", "o_orderpriority", 2, 3)


@query(
    "mover_outcomes",
    _EDGE + f""", yy AS (SELECT *, unnest(range(year(s), year(e) + 1)) AS cal_year FROM t), p AS (SELECT o_custkey, CAST(cal_year AS INT) AS cal_year, o_orderpriority, o_totalprice FROM yy QUALIFY row_number() OVER (PARTITION BY o_custkey, cal_year ORDER BY o_totalprice DESC, o_orderkey) = 1),
    {_MEMBERS}, co AS (SELECT * FROM mb WHERE anchor <= 1999), mv AS (SELECT o_custkey, year(to_s) AS y, date_diff('month', s, e) + 1 AS dwell, apart >= 2 AS gap FROM m),
    cl AS (SELECT co.grp, co.o_custkey, anchor, CASE count(*) FILTER (y - anchor BETWEEN 0 AND 2) WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2+' END AS mover FROM co LEFT JOIN mv ON mv.o_custkey = co.o_custkey GROUP BY 1, 2, 3),
    oc AS (SELECT grp, mover, count(p2.o_totalprice) AS n, round(median(p2.o_totalprice), 4) AS median_value, round(median(p2.o_totalprice) - median(p0.o_totalprice), 4) AS median_gain FROM cl LEFT JOIN p p0 ON p0.o_custkey = cl.o_custkey AND p0.cal_year = anchor LEFT JOIN p p2 ON p2.o_custkey = cl.o_custkey AND p2.cal_year = anchor + 2 GROUP BY 1, 2),
    lm AS (SELECT grp, mover, count(*) AS late_moves, round(median(dwell), 1) AS late_dwell, round(avg(CAST(gap AS INT)), 4) AS late_gap_share FROM cl JOIN mv ON mv.o_custkey = cl.o_custkey WHERE anchor <= 1997 AND y - anchor BETWEEN 3 AND 4 GROUP BY 1, 2),
    q AS (SELECT grp, mover, cl.o_custkey, count(DISTINCT o_orderpriority) AS k FROM cl JOIN p ON p.o_custkey = cl.o_custkey WHERE anchor <= 1997 AND cal_year - anchor BETWEEN 0 AND 2 GROUP BY 1, 2, 3), r AS (SELECT grp, mover, count(*) AS explorers, round(avg(k), 4) AS states FROM q GROUP BY 1, 2)
    SELECT * FROM oc LEFT JOIN lm USING (grp, mover) LEFT JOIN r USING (grp, mover)""",
)
def mover_outcomes(spark, d):
    moves = edges(spark, d).select("o_custkey", F.year("to_s").alias("y"), "dwell_months", "has_gap")
    p = panel(spark, d).withColumnRenamed("cal_year", "y")
    return H.mover_outcomes(members(spark, d), moves, p, "o_custkey", "y", "o_totalprice", "o_orderpriority", (0, 2), (3, 4), 2, 2001)


@query(
    "first_entry_years",
    _PANEL + f", {_MEMBERS}, r AS (SELECT grp, p.o_custkey, o_orderpriority, cal_year - anchor AS k FROM mb JOIN p ON p.o_custkey = mb.o_custkey), fe AS (SELECT grp, o_custkey, o_orderpriority, min(k) AS y FROM r WHERE k >= 0 GROUP BY 1, 2, 3) SELECT fe.grp, fe.o_orderpriority, count(*) AS n, median(y) AS median_first_year FROM r JOIN fe ON fe.grp = r.grp AND fe.o_custkey = r.o_custkey AND fe.o_orderpriority = r.o_orderpriority WHERE k = 4 GROUP BY 1, 2 HAVING count(*) >= 3",
)
def first_entry_years(spark, d):
    return H.first_entry_years(members(spark, d), panel(spark, d), "o_custkey", "cal_year", "o_orderpriority", 4, 3)


@query(
    "named_paths",
    _PANEL + f""", {_MEMBERS}, r AS (SELECT grp, p.o_custkey, cal_year - anchor AS k, o_orderpriority AS s FROM mb JOIN p ON p.o_custkey = mb.o_custkey WHERE cal_year - anchor BETWEEN 0 AND 6 AND o_orderpriority <> '4-NOT SPECIFIED'),
    u AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY grp, o_custkey ORDER BY k) > 1, TRUE) AS br FROM r), v AS (SELECT *, sum(br::INT) OVER (PARTITION BY grp, o_custkey ORDER BY k) AS cut FROM u), w AS (SELECT * FROM v QUALIFY coalesce(lag(s) OVER (PARTITION BY grp, o_custkey, cut ORDER BY k) <> s, TRUE)),
    x AS (SELECT grp, o_custkey, s AS a, lead(s) OVER z AS b, lead(s, 2) OVER z AS c FROM w WINDOW z AS (PARTITION BY grp, o_custkey, cut ORDER BY k)), l AS (SELECT grp, o_custkey, a || '>' || b AS path, b AS last FROM x WHERE b IS NOT NULL UNION SELECT grp, o_custkey, a || '>' || b || '>' || c, c FROM x WHERE c IS NOT NULL),
    n AS (SELECT grp, path, last, count(DISTINCT o_custkey) AS persons FROM l GROUP BY 1, 2, 3), h AS (SELECT grp, count(*) AS k FROM n WHERE persons BETWEEN 2 AND 3 GROUP BY 1), e AS (SELECT * FROM n WHERE persons >= 4 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY persons DESC, path) <= 12),
    fan AS (SELECT grp, s FROM r WHERE k = 4 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, s) <= 2) SELECT e.grp, path, persons, fan.s IS NULL AS unexpected, coalesce(h.k, 0) AS suppressed FROM e LEFT JOIN fan ON fan.grp = e.grp AND fan.s = last LEFT JOIN h ON h.grp = e.grp""",
)
def named_paths(spark, d):
    from wayline.operators.classifiers import top_by_count

    state = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    p, who = panel(spark, d).withColumn("state", state), members(spark, d)
    fans = top_by_count(who.join(p, "o_custkey").filter((F.col("cal_year") - F.col("anchor") == 4) & F.col("state").isNotNull()), "grp", "state", 2)
    return H.named_paths(who, p, "o_custkey", "cal_year", "state", 6, 2, 3, fans, 4, 2, 12)


@query(
    "single_group_rows",
    f"""WITH t AS {_STEP}, c AS (SELECT c_custkey, c_nationkey % 5 AS grp, 1996 AS a FROM customer UNION ALL SELECT c_custkey, c_nationkey % 3, 1995 FROM customer WHERE c_acctbal > 5000), one AS (SELECT c_custkey, min(grp) AS grp, min(a) AS a FROM c GROUP BY 1 HAVING count(DISTINCT grp) = 1)
    SELECT o_custkey, o_orderpriority, o_orderkey, grp FROM t JOIN one ON c_custkey = o_custkey WHERE year(s) BETWEEN a AND a + 2 AND length(trim(o_orderpriority)) >= 6 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY s, o_orderkey) = 1""",
)
def single_group_rows(spark, d):
    from wayline.plans.joins import steps

    c = table(spark, d, "customer")
    entities = c.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("grp"), F.lit(1996).alias("a")).union(c.filter("c_acctbal > 5000").select("c_custkey", F.col("c_nationkey") % 3, F.lit(1995)))
    found = H.single_group_rows(entities, "grp", steps(spark, d), "o_custkey", "a", F.year("s"), 2, "o_orderpriority", 6, ["o_custkey", "o_orderpriority"], [F.asc("s"), F.asc("o_orderkey")])
    return found.select("o_custkey", "o_orderpriority", "o_orderkey", "grp")


@query(
    "role_vectors",
    "WITH k AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || 'doc'), vec_id) <= 20), x AS (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM k), m AS (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL) SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM m GROUP BY 1",
)
def role_vectors(spark, d):
    """Mean vector of up to 20 documents of a role, picked by a salted hash."""
    return mean_vectors(salted_sample(table(spark, d, "embeddings"), ["label"], "vec_id", "doc", 20), "label", "embedding")
