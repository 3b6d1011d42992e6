"""Queries of the graphs: events per user, and trade between nations by line."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import graphs as G
from wayline.operators.aggregates import suppress
from wayline.operators.components import connected_components
from wayline.plans.registry import query, table

_EV = "t AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst, count(*) AS weight, count(DISTINCT user_id) AS persons FROM t WHERE dst IS NOT NULL GROUP BY ALL)"


def event_edges(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    return G.edge_table(moves, F.col("event_type"), F.col("next"), F.col("user_id"))


def trade_edges(spark, d, era=None):
    """Customers' nations to suppliers' nations by line."""
    rows = (
        table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return G.edge_table(rows, F.col("c_nationkey"), F.col("s_nationkey"), F.col("o_custkey"), era)


_TRADE = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query(
    "transition_network_rr",
    f"""WITH {_EV}, n AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS o, sum(weight) OVER (PARTITION BY dst) AS i, sum(weight) OVER () AS t FROM e WHERE src <> dst),
    m AS (SELECT *, persons < 100 AS small FROM n), r AS (SELECT *, sum(small::INT) OVER (PARTITION BY src) AS k, row_number() OVER (PARTITION BY src ORDER BY small, persons, dst) AS rk FROM m)
    SELECT src, dst, CASE WHEN NOT (small OR (k = 1 AND rk = 1)) THEN weight END AS weight, CASE WHEN NOT (small OR (k = 1 AND rk = 1)) THEN round(weight * t / (o * i), 6) END AS rr, small OR (k = 1 AND rk = 1) AS suppressed FROM r""",
)
def transition_network_rr(spark, d):
    e = suppress(G.gravity_null(event_edges(spark, d)), ["src"], "persons", 100, "dst")
    shown = ~F.col("suppressed")
    return e.select("src", "dst", F.when(shown, F.col("weight")).alias("weight"), F.when(shown, F.round("rr", 6)).alias("rr"), "suppressed")


_MOVES = """m AS (SELECT o_custkey AS person, s_nationkey AS n1, c_nationkey AS n2, a.n_regionkey AS r1, b.n_regionkey AS r2, CASE WHEN p_size > 10 THEN p_brand END AS k1, p_type AS k2, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey JOIN part ON l_partkey = p_partkey)"""
_AXES = {"nation": ("n1", "n2"), "region": ("r1", "r2"), "kind": ("k1", "k2")}


def moves(spark, d):
    """Order lines as moves from a supplier to a customer, told by nation, region and kind of part."""
    of = lambda k: table(spark, d, "nation").select(F.col("n_nationkey").alias(f"n{k}"), F.col("n_regionkey").alias(f"r{k}"))
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(of(1), F.col("s_nationkey") == F.col("n1")).join(of(2), F.col("c_nationkey") == F.col("n2"))
    return j.select(F.col("o_custkey").alias("person"), "n1", "n2", "r1", "r2", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("k1"), F.col("p_type").alias("k2"), "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@query(
    "axis_networks",
    f"""WITH {_MOVES}, x AS (SELECT 'nation' AS axis, CAST(n1 AS VARCHAR) AS src, CAST(n2 AS VARCHAR) AS dst, * FROM m UNION ALL SELECT 'region', CAST(r1 AS VARCHAR), CAST(r2 AS VARCHAR), * FROM m UNION ALL SELECT 'kind', k1, k2, * FROM m), y AS (SELECT * FROM x WHERE src IS NOT NULL AND dst IS NOT NULL),
    f AS (SELECT axis, src, dst, l_returnflag AS modal_kind FROM y GROUP BY axis, src, dst, l_returnflag QUALIFY row_number() OVER (PARTITION BY axis, src, dst ORDER BY count(*) DESC, l_returnflag) = 1), t AS (SELECT axis, src, dst, l_linestatus AS modal_type FROM y GROUP BY axis, src, dst, l_linestatus QUALIFY row_number() OVER (PARTITION BY axis, src, dst ORDER BY count(*) DESC, l_linestatus) = 1)
    SELECT axis, src, dst, count(*) AS weight, count(DISTINCT person) AS persons, round(avg(l_quantity), 6) AS mean_quantity, round(avg(CAST(l_discount > 0.05 AS INT)), 6) AS frac_reduced, any_value(modal_kind) AS modal_kind, any_value(modal_type) AS modal_type, src = dst AS is_self_loop FROM y JOIN f USING (axis, src, dst) JOIN t USING (axis, src, dst) GROUP BY axis, src, dst""",
)
def axis_networks(spark, d):
    means = {"mean_quantity": F.col("l_quantity"), "frac_reduced": (F.col("l_discount") > 0.05).cast("int")}
    out = G.axis_networks(moves(spark, d), _AXES, "person", means, {"modal_kind": "l_returnflag", "modal_type": "l_linestatus"})
    return out.withColumns({c: F.round(c, 6) for c in means})


@query("axis_coverage", f"WITH {_MOVES} SELECT a.axis, count(*) AS moves, count(*) FILTER (WHERE axis <> 'kind' OR k1 IS NOT NULL) AS kept, round(count(*) FILTER (WHERE axis <> 'kind' OR k1 IS NOT NULL) / count(*), 4) AS coverage FROM m CROSS JOIN (VALUES ('nation'), ('region'), ('kind')) a(axis) GROUP BY 1")
def axis_coverage(spark, d):
    return G.axis_coverage(moves(spark, d), _AXES)


@query(
    "node_strengths",
    f"""WITH {_TRADE}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, CAST(coalesce((SELECT sum(weight) FROM e WHERE src = node AND src <> dst), 0) AS BIGINT) AS out_strength, CAST(coalesce((SELECT sum(weight) FROM e WHERE dst = node AND src <> dst), 0) AS BIGINT) AS in_strength,
    (SELECT count(*) FROM e WHERE src = node AND src <> dst) AS out_degree, (SELECT count(*) FROM e WHERE dst = node AND src <> dst) AS in_degree, CAST(coalesce((SELECT sum(weight) FROM e WHERE src = node AND src = dst), 0) AS BIGINT) AS self_loops,
    CAST(coalesce((SELECT sum(weight) FROM e WHERE dst = node AND src <> dst), 0) - coalesce((SELECT sum(weight) FROM e WHERE src = node AND src <> dst), 0) AS BIGINT) AS net_flow FROM n""",
)
def node_strengths(spark, d):
    return G.node_strengths(trade_edges(spark, d))


@query("gravity_null", f"WITH {_TRADE}, n AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS o, sum(weight) OVER (PARTITION BY dst) AS i, sum(weight) OVER () AS t FROM e WHERE src <> dst) SELECT src, dst, weight, round(o * i / t, 6) AS expected, round(weight * t / (o * i), 6) AS rr, round((weight - o * i / t) / sqrt(o * i / t), 6) AS z, round(weight / o, 6) AS p FROM n")
def gravity_null(spark, d):
    return G.gravity_null(trade_edges(spark, d)).select("src", "dst", "weight", *(F.round(c, 6).alias(c) for c in ("expected", "rr", "z", "p")))


@query(
    "disparity_backbone",
    f"WITH {_TRADE}, n AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS so, count(*) OVER (PARTITION BY src) AS ko, sum(weight) OVER (PARTITION BY dst) AS si, count(*) OVER (PARTITION BY dst) AS ki FROM e WHERE src <> dst), a AS (SELECT src, dst, weight, least(CASE WHEN ko > 1 THEN pow(1 - weight / so, ko - 1) ELSE 1 END, CASE WHEN ki > 1 THEN pow(1 - weight / si, ki - 1) ELSE 1 END) AS alpha FROM n) SELECT src, dst, weight, round(alpha, 6) AS alpha FROM a WHERE alpha < 0.3",
)
def disparity_backbone(spark, d):
    return G.disparity_backbone(trade_edges(spark, d), 0.3).withColumn("alpha", F.round("alpha", 6))


@query(
    "davids_score",
    f"WITH {_TRADE}, p AS (SELECT a, b, won / (won + lost) AS p FROM (SELECT a, b, sum(won) AS won, sum(lost) AS lost FROM (SELECT dst AS a, src AS b, weight AS won, 0 AS lost FROM e WHERE src <> dst UNION ALL SELECT src, dst, 0, weight FROM e WHERE src <> dst) GROUP BY ALL)), f AS (SELECT a, sum(p) AS w, sum(1 - p) AS l FROM p GROUP BY 1) SELECT p.a AS node, round(any_value(f.w) + sum(p.p * g.w) - any_value(f.l) - sum((1 - p.p) * g.l), 6) AS score FROM p JOIN f ON f.a = p.a JOIN f g ON g.a = p.b GROUP BY 1",
)
def davids_score(spark, d):
    return G.davids_score(trade_edges(spark, d)).withColumn("score", F.round("score", 6))


@query("pagerank")
def pagerank(spark, d):
    return G.pagerank(trade_edges(spark, d))


@query("hits")
def hits(spark, d):
    return G.hits(trade_edges(spark, d))


@query("springrank")
def springrank(spark, d):
    return G.springrank(trade_edges(spark, d))


@query("agony_rank")
def agony_rank(spark, d):
    return G.agony_rank(trade_edges(spark, d))


@query("label_propagation")
def label_propagation(spark, d):
    return G.label_propagation(trade_edges(spark, d))


@query("label_spread")
def label_spread(spark, d):
    e = trade_edges(spark, d)
    seeds = table(spark, d, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("class"))
    return G.label_spread(e, seeds)


@query(
    "components",
    # The least order that reaches a node: every order steps over the parts it shares with others until nothing changes.
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey + 1000000000 AS p FROM lineitem), reach(node, least) USING KEY (node) AS (
      SELECT o, o FROM e UNION SELECT p, min(o) FROM e GROUP BY 1
      UNION (SELECT x.node, min(x.least) FROM (SELECT e.o AS node, r.least FROM reach r JOIN e ON e.p = r.node UNION ALL SELECT e.p, r.least FROM reach r JOIN e ON e.o = r.node) x JOIN recurring.reach c ON c.node = x.node WHERE x.least < c.least GROUP BY 1))
    SELECT node, least AS component FROM reach""",
)
def components(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") + 1000000000).alias("p"))
    return connected_components(e.distinct(), "l_orderkey", "p")


@query("trophic_levels")
def trophic_levels(spark, d):
    e = trade_edges(spark, d)
    return G.trophic_levels(e, connected_components(e, "src", "dst")).withColumn("level", F.round("level", 6))


@query("modularity")
def modularity(spark, d):
    e = event_edges(spark, d)
    return G.modularity(e, G.label_propagation(e)).withColumn("modularity", F.round("modularity", 6))


@query("oriented_scores")
def oriented_scores(spark, d):
    e = trade_edges(spark, d)
    nodes = G.node_strengths(e).select("node", (F.col("in_strength") + F.col("out_strength")).alias("support"))
    anchor = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("ordinal"))
    return G.oriented_scores(G.springrank(e).join(nodes, "node"), anchor, "node", "score", "ordinal", "support")


@query(
    "era_networks",
    "WITH e AS (SELECT CAST(floor(year(o_orderdate) / 2) AS INT) AS era, c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT era, src, dst, weight, round(weight * sum(weight) OVER (PARTITION BY era) / (sum(weight) OVER (PARTITION BY era, src) * sum(weight) OVER (PARTITION BY era, dst)), 6) AS rr FROM e WHERE src <> dst",
)
def era_networks(spark, d):
    e = trade_edges(spark, d, F.floor(F.year("o_orderdate") / 2).cast("int"))
    return G.gravity_null(e, ["era"]).select("era", "src", "dst", "weight", F.round("rr", 6).alias("rr"))
