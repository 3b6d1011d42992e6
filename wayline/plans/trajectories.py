"""Queries of entity histories: orders as steps, years as panels, events as paths."""

from pyspark.sql import functions as F

from wayline.operators import trajectories as D
from wayline.operators.aggregates import overlapping_cube, suppress
from wayline.operators.windows import pick_one, triples
from wayline.plans.aggregates import order_customer
from wayline.plans.joins import _PRIMARY, _STEP, flagged_steps, steps
from wayline.plans.registry import query, table


def text_steps(spark, d):
    """Order intervals with text dates: some years only, the last of each status O open, some unreadable."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
    o = table(spark, d, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    start = F.when(k % 13 == 0, "n/a").when(k % 5 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    end = F.when(F.col("o_orderstatus") == "O", "Present").when(k % 7 == 0, F.date_format("e", "yyyy")).otherwise(F.date_format("e", "MMM yyyy"))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", start.alias("start_text"), end.alias("end_text"))


@query(
    "interval_steps",
    """WITH e AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN make_date(year(o_orderdate), 1, 1) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS start_dt,
    CASE WHEN o_orderstatus = 'O' THEN DATE '2002-01-31' WHEN o_orderkey % 7 = 0 THEN make_date(year(e), 12, 31) ELSE last_day(e) END AS end_dt, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'year' ELSE 'month' END AS granularity, o_orderstatus = 'O' AS is_ongoing FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)
    SELECT o_orderkey, start_dt, end_dt, granularity, is_ongoing, start_dt IS NOT NULL AND end_dt IS NOT NULL AS datable, coalesce(end_dt < start_dt, FALSE) AS bad_negative_duration, coalesce(start_dt > DATE '2002-01-31', FALSE) AS bad_future_start, CASE WHEN end_dt >= start_dt THEN date_diff('month', start_dt, end_dt) + 1 END AS tenure_months FROM t""",
)
def interval_steps(spark, d):
    out = D.interval_steps(text_steps(spark, d), "start_text", "end_text", "Present", "2002-01-31")
    return out.select("o_orderkey", "start_dt", "end_dt", "granularity", "is_ongoing", "datable", "bad_negative_duration", "bad_future_start", "tenure_months")


_EDGE = f"""WITH t AS {_STEP}, {_PRIMARY}, n AS (SELECT *, lead(o_orderkey) OVER w AS to_key, lead(s) OVER w AS to_s, lead(o_orderpriority) OVER w AS to_p FROM pr WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e, o_orderkey)),
m AS (SELECT *, date_diff('month', e, to_s) AS apart, CAST(left(o_orderpriority, 1) AS INT) AS a, CAST(left(to_p, 1) AS INT) AS b FROM n WHERE to_key IS NOT NULL)"""


def edges(spark, d):
    out = D.transitions(flagged_steps(spark, d).filter("not dominated"), "o_custkey", "o_orderkey", "s", "e", ["o_orderpriority"])
    rank = lambda c: F.left(c, F.lit(1)).cast("int")
    out = out.withColumn("direction", D.direction(rank("to_o_orderpriority"), rank("from_o_orderpriority")))
    kind = F.when(F.col("gap_months") > 12, "return").when(F.col("direction") == "up", "promotion").when(F.col("direction") == "down", "demotion").otherwise("lateral")
    return out.withColumn("kind", kind)


@query(
    "transitions_typed",
    _EDGE + """ SELECT o_custkey, o_orderkey AS from_o_orderkey, to_key AS to_o_orderkey, greatest(apart - 1, 0) AS gap_months, greatest(1 - apart, 0) AS overlap_months, apart >= 2 AS has_gap, apart <= -1 AS has_overlap, date_diff('month', s, e) + 1 AS dwell_months,
    CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS direction, CASE WHEN apart > 13 THEN 'return' WHEN a > b THEN 'promotion' WHEN a < b THEN 'demotion' ELSE 'lateral' END AS kind FROM m""",
)
def transitions_typed(spark, d):
    return edges(spark, d).select("o_custkey", "from_o_orderkey", "to_o_orderkey", "gap_months", "overlap_months", "has_gap", "has_overlap", "dwell_months", "direction", "kind")


_FACTS_SQL = """f AS (SELECT *, CASE o_orderkey % 13 WHEN 0 THEN 'retired' WHEN 1 THEN 'student' WHEN 2 THEN 'self_employed' WHEN 3 THEN 'business_owner' WHEN 4 THEN 'career_break' ELSE 'employee' END AS employment,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'nonorg:home' ELSE 'id:' || CAST(o_orderkey % 3 AS VARCHAR) END AS company, CASE WHEN o_orderkey % 7 > 0 THEN CAST(11 + o_orderkey % 2 AS VARCHAR) END AS major,
    CASE WHEN o_orderkey % 4 > 0 THEN 6 - CAST(left(o_orderpriority, 1) AS INT) END AS ordinal, o_totalprice / 500000 AS score, CASE WHEN o_orderkey % 9 > 0 THEN (o_orderkey % 10) / 10 END AS confidence FROM pr)"""
_FACTS = ["employment", "company", "major", "ordinal", "score", "confidence"]


def facts(df):
    """Employment, company, occupation and seniority of a step, made from its key, priority and price."""
    k = F.col("o_orderkey")
    kinds = {0: "retired", 1: "student", 2: "self_employed", 3: "business_owner", 4: "career_break"}
    employment = F.lit("employee")
    for rest, name in kinds.items():
        employment = F.when(k % 13 == rest, name).otherwise(employment)
    return df.withColumns({
        "employment": employment, "company": F.when(k % 17 == 0, None).when(k % 5 == 0, "nonorg:home").otherwise(F.concat(F.lit("id:"), (k % 3).cast("string"))),
        "major": F.when(k % 7 > 0, (11 + k % 2).cast("string")), "ordinal": F.when(k % 4 > 0, 6 - F.left("o_orderpriority", F.lit(1)).cast("int")),
        "score": F.col("o_totalprice") / 500000, "confidence": F.when(k % 9 > 0, (k % 10) / 10),
    })


@query(
    "transition_types",
    f"""WITH t AS {_STEP}, {_PRIMARY}, {_FACTS_SQL}, n AS (SELECT o_orderkey AS from_o_orderkey, lead(o_orderkey) OVER w AS to_o_orderkey, employment AS fe, lead(employment) OVER w AS te, company AS fc, lead(company) OVER w AS tc, major AS fm, lead(major) OVER w AS tm, ordinal AS fo, lead(ordinal) OVER w AS tord,
    lead(score) OVER w - score AS delta, least(coalesce(confidence, 0), coalesce(lead(confidence) OVER w, 0)) AS conf FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e, o_orderkey)),
    m AS (SELECT *, fe IN ('self_employed', 'business_owner') AS sf, te IN ('self_employed', 'business_owner') AS st, te IN ('retired', 'unemployed', 'homemaker', 'career_break') AS leaves, coalesce(fc = tc AND fc NOT LIKE 'nonorg:%', FALSE) AS same, conf >= 0.3 AND delta > 0.08 AS up, conf >= 0.3 AND delta < -0.12 AS dn FROM n WHERE to_o_orderkey IS NOT NULL),
    a AS (SELECT *, CASE WHEN leaves THEN 'exit' WHEN te = 'student' THEN 'education_entry' WHEN NOT sf AND st THEN 'into_self_employment' WHEN sf AND NOT st THEN 'out_of_self_employment' END AS axis FROM m)
    SELECT from_o_orderkey, to_o_orderkey, CASE WHEN fo IS NULL OR tord IS NULL THEN 'unknown' WHEN tord > fo THEN 'up' WHEN tord < fo THEN 'down' ELSE 'flat' END AS direction,
    coalesce(axis, CASE WHEN same THEN CASE WHEN tord > fo THEN 'promotion' WHEN tord < fo THEN 'demotion' ELSE 'lateral' END ELSE 'move' END) AS kind,
    coalesce(axis, CASE WHEN fm <> tm THEN CASE WHEN up THEN 'occupation_change_up' WHEN dn THEN 'occupation_change_down' ELSE 'occupation_change' END WHEN same THEN CASE WHEN up THEN 'promotion' WHEN dn THEN 'demotion' ELSE 'lateral' END
      ELSE CASE WHEN up THEN 'employer_move_up' WHEN dn THEN 'employer_move_down' WHEN conf >= 0.3 THEN 'employer_move_lateral' ELSE 'employer_move' END END) AS transition_type,
    fo IS NOT NULL AND tord IS NOT NULL AS direction_from_lexical, CAST(round(100 * CASE WHEN leaves OR te = 'student' OR sf <> st THEN 0.95 WHEN conf >= 0.3 AND abs(delta) > 0.08 THEN 0.5 + 0.5 * conf ELSE 0.4 * conf END) AS BIGINT) AS percent FROM a""",
)
def transition_types(spark, d):
    primary = facts(flagged_steps(spark, d).filter("not dominated"))
    out = D.transition_types(D.transitions(primary, "o_custkey", "o_orderkey", "s", "e", _FACTS), *_FACTS)
    percent = F.round(100 * F.col("transition_confidence")).cast("long")
    return out.select("from_o_orderkey", "to_o_orderkey", "direction", "kind", "transition_type", "direction_from_lexical", percent.alias("percent"))


@query(
    "upward_share",
    _EDGE + " SELECT c_mktsegment, count(*) AS moves, round(count(*) FILTER (a > b) / count(*), 6) AS upward, median(date_diff('month', s, e) + 1) AS median_dwell FROM m JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)
def upward_share(spark, d):
    e = edges(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return e.groupBy("c_mktsegment").agg(F.count("*").alias("moves"), F.round(F.count_if(F.col("direction") == "up") / F.count("*"), 6).alias("upward"), F.median("dwell_months").alias("median_dwell"))


@query(
    "anchor_tiers",
    "WITH t AS (SELECT o_custkey, min(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS a1, min(year(o_orderdate)) FILTER (o_orderstatus = 'F') + 1 AS a2, min(year(o_orderdate)) AS a3 FROM orders GROUP BY 1) SELECT o_custkey, coalesce(a1, a2, a3) AS anchor, CASE WHEN a1 IS NOT NULL THEN 'A1' WHEN a2 IS NOT NULL THEN 'A2' ELSE 'A3' END AS tier FROM t",
)
def anchor_tiers(spark, d):
    y = F.year("o_orderdate")
    tiers = [("A1", F.when(F.col("o_orderpriority") == "1-URGENT", y)), ("A2", F.when(F.col("o_orderstatus") == "F", y + 1)), ("A3", y)]
    return D.anchor_tiers(table(spark, d, "orders"), "o_custkey", tiers)


_GROUPS_SQL = "SELECT 'all' AS grp, c_custkey FROM customer UNION ALL SELECT 'building', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'rich', c_custkey FROM customer WHERE c_acctbal > 5000"


def groups():
    return {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING", "rich": F.col("c_acctbal") > 5000}


@query("membership", _GROUPS_SQL)
def membership(spark, d):
    return D.membership(table(spark, d, "customer"), "c_custkey", groups())


_PANEL = f"""WITH t AS {_STEP}, y AS (SELECT *, unnest(range(year(s), year(e) + 1)) AS cal_year FROM t), p AS (SELECT o_custkey, CAST(cal_year AS INT) AS cal_year, o_orderkey, o_orderpriority, o_totalprice FROM y QUALIFY row_number() OVER (PARTITION BY o_custkey, cal_year ORDER BY o_totalprice DESC, o_orderkey) = 1)"""


def panel(spark, d):
    return D.year_panel(steps(spark, d), "o_custkey", "s", "e", [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "o_orderpriority", "o_totalprice"])


@query("year_panel", _PANEL + " SELECT * FROM p")
def year_panel(spark, d):
    return panel(spark, d)


@query(
    "entity_summary",
    """WITH o AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, min(year(o_orderdate)) AS first_year FROM orders GROUP BY 1), c AS (SELECT o_custkey, o_orderpriority AS current FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c_custkey, coalesce(n, 0) AS n, coalesce(any_urgent, FALSE) AS any_urgent, first_year, current FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN c ON c_custkey = c.o_custkey""",
)
def entity_summary(spark, d):
    o = table(spark, d, "orders")
    roll = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.min(F.year("o_orderdate")).alias("first_year"))
    last = pick_one(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderpriority"]).withColumnRenamed("o_orderpriority", "current")
    both = roll.join(last, "o_custkey")
    out = table(spark, d, "customer").join(both, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("any_urgent", F.lit(False)).alias("any_urgent"), "first_year", "current")


@query(
    "metrics_cube",
    f"""WITH g AS ({_GROUPS_SQL}), c AS (SELECT grp, year(o_orderdate) AS y, o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders JOIN g ON o_custkey = c_custkey GROUP BY ALL), m AS (SELECT *, n < 20 AS small FROM c), r AS (SELECT *, sum(small::INT) OVER (PARTITION BY grp, y) AS k, row_number() OVER (PARTITION BY grp, y ORDER BY small, n, o_orderpriority) AS rk FROM m)
    SELECT grp, y, o_orderpriority, CASE WHEN NOT (small OR (k = 1 AND NOT small AND rk = 1)) THEN n END AS n FROM r""",
)
def metrics_cube(spark, d):
    cells = overlapping_cube(order_customer(spark, d).withColumn("y", F.year("o_orderdate")), groups(), ["y", "o_orderpriority"], [F.count_distinct("o_custkey").alias("n")])
    return suppress(cells, ["grp", "y"], "n", 20, "o_orderpriority").select("grp", "y", "o_orderpriority", F.when(~F.col("suppressed"), F.col("n")).alias("n"))


@query(
    "age_profile_gap",
    _PANEL + """, a AS (SELECT o_custkey, min(cal_year) AS first FROM p GROUP BY 1), c AS (SELECT c_mktsegment, cal_year - first AS age, avg(o_totalprice) AS v, count(*) AS n FROM p JOIN a USING (o_custkey) JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT x.c_mktsegment, x.age, x.n, round(x.v, 6) AS mean, round(x.v - b.v, 6) AS gap FROM c x LEFT JOIN c b ON b.c_mktsegment = 'BUILDING' AND b.age = x.age""",
)
def age_profile_gap(spark, d):
    p = panel(spark, d)
    first = p.groupBy("o_custkey").agg(F.min("cal_year").alias("first"))
    cells = p.join(first, "o_custkey").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    cells = cells.groupBy("c_mktsegment", (F.col("cal_year") - F.col("first")).alias("age")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    base = cells.filter("c_mktsegment = 'BUILDING'").select("age", F.col("v").alias("b"))
    return cells.join(base, "age", "left").select("c_mktsegment", "age", "n", F.round("v", 6).alias("mean"), F.round(F.col("v") - F.col("b"), 6).alias("gap"))


@query(
    "mover_classes",
    _EDGE + ", k AS (SELECT o_custkey, count(*) FILTER (a <> b) AS moved, count(DISTINCT to_p) AS breadth, median(date_diff('month', s, e) + 1) AS dwell FROM m GROUP BY 1) SELECT CASE WHEN moved = 0 THEN 'stayer' WHEN moved <= 3 THEN 'some' ELSE 'mover' END AS mover, count(*) AS entities, median(dwell) AS dwell, round(avg(breadth), 6) AS breadth FROM k GROUP BY 1",
)
def mover_classes(spark, d):
    per = edges(spark, d).groupBy("o_custkey").agg(F.count_if(F.col("direction").isin("up", "down")).alias("moved"), F.count_distinct("to_o_orderpriority").alias("breadth"), F.median("dwell_months").alias("dwell"))
    label = F.when(F.col("moved") == 0, "stayer").when(F.col("moved") <= 3, "some").otherwise("mover")
    return per.groupBy(label.alias("mover")).agg(F.count("*").alias("entities"), F.median("dwell").alias("dwell"), F.round(F.avg("breadth"), 6).alias("breadth"))


@query(
    "median_curve",
    _PANEL + f""", g AS ({_GROUPS_SQL}), a AS (SELECT o_custkey, min(cal_year) AS anchor FROM p GROUP BY 1), k AS (SELECT grp, a.o_custkey, k, anchor + k AS cal_year FROM g JOIN a ON c_custkey = a.o_custkey CROSS JOIN (VALUES (0), (1), (2), (3), (6)) v(k))
    SELECT grp, k, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(median(o_totalprice), 6) END AS median FROM k JOIN p USING (o_custkey, cal_year) GROUP BY ALL""",
)
def median_curve(spark, d):
    p = panel(spark, d)
    anchors = p.groupBy("o_custkey").agg(F.min("cal_year").alias("anchor"))
    members = D.membership(table(spark, d, "customer"), "c_custkey", groups()).withColumnRenamed("c_custkey", "o_custkey").join(anchors, "o_custkey")
    return D.median_curve(p, members, "o_custkey", "cal_year", "o_totalprice", [0, 1, 2, 3, 6], 30)


@query(
    "occupancy_share",
    _PANEL + ", c AS (SELECT c_mktsegment, cal_year, o_orderpriority, count(*) AS n FROM p JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT c_mktsegment, cal_year, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY c_mktsegment, cal_year), 6) AS share FROM c",
)
def occupancy_share(spark, d):
    p = panel(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return D.occupancy(p, "c_mktsegment", "cal_year", "o_orderpriority")


@query("state_flows", _PANEL + " SELECT x.cal_year, x.o_orderpriority AS from_state, y.o_orderpriority AS to_state, count(*) AS n FROM p x JOIN p y ON x.o_custkey = y.o_custkey AND y.cal_year = x.cal_year + 1 GROUP BY ALL")
def state_flows(spark, d):
    from wayline.operators.joins import lagged_states

    return lagged_states(panel(spark, d), "o_custkey", "cal_year", "o_orderpriority")


_MOVED = "m AS (SELECT user_id, ts, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type)"


@query(
    "path_ngrams",
    f"WITH {_MOVED}, g AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), p AS (SELECT user_id, a || '>' || b AS path, 2 AS length FROM g WHERE b IS NOT NULL UNION ALL SELECT user_id, a || '>' || b || '>' || c, 3 FROM g WHERE c IS NOT NULL) SELECT path, length, count(*) AS n, count(DISTINCT user_id) AS persons FROM p GROUP BY ALL",
)
def path_ngrams(spark, d):
    return D.path_ngrams(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 2, 3)


_TRI = "t AS (SELECT user_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(
    "motif_lift",
    f"WITH {_TRI}, n AS (SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL) SELECT a, b, c, n, round(n * sum(n) OVER (PARTITION BY b) / (sum(n) OVER (PARTITION BY a, b) * sum(n) OVER (PARTITION BY b, c)), 6) AS lift FROM n QUALIFY n >= 20",
)
def motif_lift(spark, d):
    return D.motif_lift(triples(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type"), 20)


@query(
    "markov_perplexity",
    f"""WITH {_TRI}, h AS (SELECT *, md5(CAST(user_id AS VARCHAR)) < '33' AS test FROM t WHERE c IS NOT NULL), n AS (SELECT a, b, c, count(*) AS n FROM h WHERE NOT test GROUP BY ALL), m AS (SELECT a, b, c, count(*) AS m FROM h WHERE test GROUP BY ALL),
    j AS (SELECT m, ln((coalesce((SELECT sum(n) FROM n WHERE n.b = m.b AND n.c = m.c), 0) + 1) / (coalesce((SELECT sum(n) FROM n WHERE n.b = m.b), 0) + (SELECT count(DISTINCT c) FROM n))) AS p1, ln((coalesce((SELECT sum(n) FROM n WHERE n.a = m.a AND n.b = m.b AND n.c = m.c), 0) + 1) / (coalesce((SELECT sum(n) FROM n WHERE n.a = m.a AND n.b = m.b), 0) + (SELECT count(DISTINCT c) FROM n))) AS p2 FROM m)
    SELECT CAST(sum(m) AS BIGINT) AS tested, round(exp(-sum(m * p1) / sum(m)), 6) AS order1, round(exp(-sum(m * p2) / sum(m)), 6) AS order2 FROM j""",
)
def markov_perplexity(spark, d):
    tri = triples(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return D.perplexities(tri, F.md5(F.col("user_id").cast("string")) < "33")


@query(
    "first_window_mix",
    _EDGE + """, a AS (SELECT o_custkey, min(year(s)) AS anchor FROM t GROUP BY 1), w AS (SELECT c_mktsegment, CASE WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'flat' END AS direction, m.o_custkey FROM m JOIN a ON a.o_custkey = m.o_custkey JOIN customer ON c_custkey = m.o_custkey WHERE year(to_s) - anchor BETWEEN 0 AND 3)
    SELECT c_mktsegment, direction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM w GROUP BY c_mktsegment, direction""",
)
def first_window_mix(spark, d):
    anchors = steps(spark, d).groupBy("o_custkey").agg(F.min(F.year("s")).alias("anchor"))
    w = edges(spark, d).join(anchors, "o_custkey").filter((F.year("to_s") - F.col("anchor")).between(0, 3)).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    counts = w.groupBy("c_mktsegment", "direction").agg(F.count("*").alias("n"))
    totals = counts.groupBy("c_mktsegment").agg(F.sum("n").alias("t"))
    return counts.join(totals, "c_mktsegment").select("c_mktsegment", "direction", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(
    "waypoint_flows",
    _PANEL + ", a AS (SELECT o_custkey, min(cal_year) AS y FROM p GROUP BY 1) SELECT x.o_orderpriority AS first_state, v.o_orderpriority AS via, z.o_orderpriority AS last_state, count(*) AS n FROM a JOIN p x ON x.o_custkey = a.o_custkey AND x.cal_year = y JOIN p v ON v.o_custkey = a.o_custkey AND v.cal_year = y + 2 JOIN p z ON z.o_custkey = a.o_custkey AND z.cal_year = y + 4 GROUP BY ALL",
)
def waypoint_flows(spark, d):
    p = panel(spark, d)
    a = p.groupBy("o_custkey").agg(F.min("cal_year").alias("y"))
    at = p.join(a, "o_custkey").withColumn("k", F.col("cal_year") - F.col("y")).filter(F.col("k").isin(0, 2, 4))
    wide = at.groupBy("o_custkey").agg(*(F.max(F.when(F.col("k") == k, F.col("o_orderpriority"))).alias(n) for k, n in ((0, "first_state"), (2, "via"), (4, "last_state"))))
    return wide.dropna().groupBy("first_state", "via", "last_state").agg(F.count("*").alias("n"))


@query(
    "trajectory_features",
    _EDGE + " SELECT o_custkey, count(*) AS moves, round(avg(CAST(a > b AS INT)), 6) AS up_share, round(avg(date_diff('month', s, e) + 1), 6) AS mean_dwell, max(greatest(apart - 1, 0)) AS longest_gap, count(DISTINCT to_p) AS states FROM m GROUP BY 1",
)
def trajectory_features(spark, d):
    return edges(spark, d).groupBy("o_custkey").agg(
        F.count("*").alias("moves"), F.round(F.avg((F.col("direction") == "up").cast("int")), 6).alias("up_share"), F.round(F.avg("dwell_months"), 6).alias("mean_dwell"), F.max("gap_months").alias("longest_gap"), F.count_distinct("to_o_orderpriority").alias("states")
    )


@query(
    "fused_score",
    "WITH l AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size / 50.0 END AS a, CASE WHEN p_type <> 'SMALL' THEN p_retailprice / 2500 END AS b FROM part), s AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END AS w FROM l) SELECT p_partkey, round(CAST((coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4) / nullif(w, 0) AS DOUBLE), 6) AS score, CASE WHEN w > 0 THEN round(CAST(least(1.0, w * 0.9 + CASE WHEN abs(a - b) < 0.2 THEN 0.1 ELSE 0 END) AS DOUBLE), 6) END AS confidence FROM s",
)
def fused_score(spark, d):
    p = table(spark, d, "part")
    score, confidence = D.fused_score([(F.when(F.col("p_size") > 5, F.col("p_size") / 50.0), 0.6), (F.when(F.col("p_type") != "SMALL", F.col("p_retailprice") / 2500), 0.4)])
    return p.select("p_partkey", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))
