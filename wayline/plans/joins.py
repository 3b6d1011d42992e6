"""Queries of the joins."""

from pyspark.sql import functions as F

from wayline.operators import joins as J
from wayline.operators.aggregates import top_value
from wayline.operators.projections import bounded_entities
from wayline.plans.registry import query, table

_MAP = "(SELECT nullif(p_type, 'SMALL') AS value, 'cat:' || max(p_brand) AS canonical_id, count(*) AS freq FROM part GROUP BY 1)"


def _mapping(spark, d):
    return table(spark, d, "part").groupBy(F.nullif("p_type", F.lit("SMALL")).alias("value")).agg(F.concat(F.lit("cat:"), F.max("p_brand")).alias("canonical_id"), F.count("*").alias("freq"))


@query("nullsafe_mapping_join", f"SELECT p_partkey, canonical_id, freq FROM part LEFT JOIN {_MAP} m ON nullif(p_type, 'SMALL') IS NOT DISTINCT FROM m.value")
def nullsafe_mapping_join(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.nullif("p_type", F.lit("SMALL")))
    return J.map_values(p, _mapping(spark, d), {"kind": "value"}, ["canonical_id", "freq"]).select("p_partkey", "canonical_id", "freq")


@query(
    "composite_nullsafe_join",
    """WITH r AS (SELECT l_orderkey AS k, nullif(l_linenumber, 1) AS pos, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, price FROM lineitem LEFT JOIN r ON l_orderkey = k AND nullif(l_linenumber, 1) IS NOT DISTINCT FROM pos""",
)
def composite_nullsafe_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(1)).alias("pos"), "l_extendedprice")
    right = li.groupBy(F.col("l_orderkey").alias("k"), F.col("pos").alias("p")).agg(F.max("l_extendedprice").alias("price"))
    return J.map_values(li, right, {"l_orderkey": "k", "pos": "p"}, ["price"]).select("l_orderkey", "l_linenumber", "price")


@query(
    "fallback_ladder",
    """WITH s AS (SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS v FROM part WHERE p_size < 10 GROUP BY ALL HAVING count(*) > 3), m AS (SELECT p_brand, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1)
    SELECT p_partkey, coalesce(s.v, m.v) AS prior, CASE WHEN s.v IS NOT NULL THEN 'specific' WHEN m.v IS NOT NULL THEN 'major' END AS prior_source FROM part
    LEFT JOIN s ON part.p_brand = s.p_brand AND part.p_type = s.p_type LEFT JOIN m ON part.p_brand = m.p_brand""",
)
def fallback_ladder(spark, d):
    p = table(spark, d, "part").withColumn("code", F.concat_ws("|", "p_brand", "p_type"))
    fine = p.filter("p_size < 10").groupBy("code").agg(F.round(F.avg("p_retailprice"), 6).alias("prior"), F.count("*").alias("n")).filter("n > 3")
    major = p.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("prior"))
    return J.fallback_ladder(p, [("code", fine, "specific"), ("p_brand", major, "major")], "prior").select("p_partkey", "prior", "prior_source")


@query(
    "split_route_union",
    """SELECT o_orderkey, 'org' AS route, c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'nonorg', o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""",
)
def split_route_union(spark, d):
    o = table(spark, d, "orders")
    org = o.filter("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    org = org.select("o_orderkey", F.lit("org").alias("route"), F.col("c_mktsegment").alias("label"))
    return org.unionByName(o.filter("o_orderstatus <> 'F'").select("o_orderkey", F.lit("nonorg").alias("route"), F.col("o_orderpriority").alias("label")))


_STEP = """(SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS s, e, o_orderpriority, o_totalprice FROM orders JOIN
 (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE e >= CAST(o_orderdate AS DATE))"""


def steps(spark, d):
    """Valid order intervals: entity, row, start and end, category."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("e"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("s"), "o_orderpriority", "o_totalprice")
    return o.join(ends, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").filter("e >= s")


# The steps of entities with at most 100 of them that no other step dominates; ``t`` are all steps.
_PRIMARY = """b AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY o_custkey) <= 100), x AS (SELECT a.o_orderkey, EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey
    AND date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) + 1 >= 0.5 * least(a.e - a.s + 1, b.e - b.s + 1)
    AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND (b.o_totalprice > a.o_totalprice OR (b.o_totalprice = a.o_totalprice AND (b.s < a.s OR (b.s = a.s AND b.o_orderkey < a.o_orderkey))))))) AS dominated FROM b a),
    pr AS (SELECT b.* FROM b JOIN x USING (o_orderkey) WHERE NOT dominated)"""


def flagged_steps(spark, d):
    """Steps with ``dominated``: ranked by length, price and earlier start."""
    bounded = bounded_entities(steps(spark, d), "o_custkey", 100)
    rank = [F.datediff("e", "s"), F.col("o_totalprice"), -F.unix_date("s")]
    return J.dominated_intervals(bounded, "o_custkey", "o_orderkey", "s", "e", rank)


@query("interval_dominance", f"WITH t AS {_STEP}, {_PRIMARY} SELECT * FROM x")
def interval_dominance(spark, d):
    return flagged_steps(spark, d).select("o_orderkey", "dominated")


@query(
    "active_at_k",
    f"""WITH t AS {_STEP}, a AS (SELECT o_custkey, min(s) AS anchor FROM t GROUP BY 1), h AS (SELECT t.*, k, row_number() OVER (PARTITION BY t.o_custkey, k ORDER BY e - s DESC, o_orderkey) AS rn
    FROM t JOIN a USING (o_custkey) CROSS JOIN (VALUES (0), (365), (730)) v(k) WHERE s <= anchor + k AND e >= anchor + k) SELECT o_custkey, k, o_orderkey, o_orderpriority FROM h WHERE rn = 1""",
)
def active_at_k(spark, d):
    t = steps(spark, d)
    anchors = t.groupBy("o_custkey").agg(F.min("s").alias("anchor")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(365), F.lit(730))))
    anchors = anchors.withColumn("who", F.struct("o_custkey", "k"))
    rows = t.join(anchors, "o_custkey").withColumn("at", F.date_add("anchor", F.col("k")))
    found = J.active_at(rows.drop("k", "anchor"), anchors.select("who"), "who", "s", "e", F.col("at"), [F.datediff("e", "s").desc(), F.asc("o_orderkey")])
    return found.select("o_custkey", F.col("who.k").alias("k"), "o_orderkey", "o_orderpriority")


_PANEL = "(SELECT user_id, date_part('day', ts)::INT AS day, min(event_type) AS state FROM events GROUP BY ALL)"


@query("lagged_state_flow", f"WITH p AS {_PANEL} SELECT a.day, a.state AS from_state, b.state AS to_state, count(*) AS n FROM p a JOIN p b ON a.user_id = b.user_id AND b.day = a.day + 1 GROUP BY ALL")
def lagged_state_flow(spark, d):
    p = table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.min("event_type").alias("state"))
    return J.lagged_states(p, "user_id", "day", "state")


@query(
    "window_range_join",
    """WITH a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_type, count(*) AS n, count(DISTINCT e.user_id) AS users FROM events e JOIN a USING (user_id) WHERE CAST(ts AS DATE) - CAST(anchor AS DATE) BETWEEN 0 AND 7 GROUP BY 1""",
)
def window_range_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    a = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("day").alias("anchor"))
    hit = e.join(a, "user_id").filter(F.datediff("day", "anchor").between(0, 7))
    return hit.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("semi_valid", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_valid(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("anti_missing", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("mixed_population", "SELECT p_type FROM part GROUP BY 1 HAVING count(*) FILTER (p_size < 5) > 0 EXCEPT SELECT p_type FROM part WHERE p_size = 50 AND p_retailprice > 1990")
def mixed_population(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size < 5").select("p_type").distinct().join(p.filter("p_size = 50 AND p_retailprice > 1990"), "p_type", "left_anti")


@query("fanout_guard", "SELECT o_orderkey, b AS brand FROM orders LEFT JOIN (SELECT l_orderkey, min(p_brand) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey")
def fanout_guard(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = J.one_per_key(lines, ["l_orderkey"], ["p_brand"]).select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("brand"))
    return table(spark, d, "orders").select("o_orderkey").join(one, "o_orderkey", "left")


@query(
    "sibling_guard",
    """SELECT o_orderkey, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.o_orderpriority = '1-URGENT') AS guarded FROM orders a""",
)
def sibling_guard(spark, d):
    o = table(spark, d, "orders").withColumn("hit", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    per = o.groupBy("o_custkey").agg(F.sum("hit").alias("hits"))
    return o.join(per, "o_custkey").select("o_orderkey", (F.col("hits") - F.col("hit") > 0).alias("guarded"))


@query(
    "crosswalk_exact_core",
    r"""WITH l AS (SELECT p_partkey, lower(p_name) AS norm, split_part(lower(p_name), ' ', 1) AS core FROM part), ex AS (SELECT lower(p_name) AS k, min(p_brand) AS v FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1),
    co AS (SELECT split_part(lower(p_name), ' ', 1) AS k, min(p_type) AS v FROM part WHERE p_size > 48 GROUP BY 1 HAVING count(DISTINCT p_type) = 1)
    SELECT p_partkey, coalesce(ex.v, co.v) AS code, CASE WHEN ex.v IS NOT NULL THEN 'exact' WHEN co.v IS NOT NULL THEN 'core' END AS code_source FROM l LEFT JOIN ex ON norm = ex.k LEFT JOIN co ON core = co.k""",
)
def crosswalk_exact_core(spark, d):
    p = table(spark, d, "part").withColumns({"norm": F.lower("p_name"), "core": F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))})
    exact = J.unique_core(p, "norm", "p_brand").withColumnRenamed("p_brand", "code")
    core = J.unique_core(p.filter("p_size > 48"), "core", "p_type").withColumnRenamed("p_type", "code")
    return J.fallback_ladder(p, [("norm", exact, "exact"), ("core", core, "core")], "code").select("p_partkey", "code", "code_source")


@query(
    "alias_merge",
    "SELECT CASE c_nationkey WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE c_nationkey END AS nation, count(*) AS n FROM customer GROUP BY 1",
)
def alias_merge(spark, d):
    aliases = spark.createDataFrame([(1, 2), (3, 4)], "c_nationkey int, merged int")
    c = table(spark, d, "customer").join(F.broadcast(aliases), "c_nationkey", "left")
    return c.groupBy(F.coalesce("merged", "c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query(
    "token_jaccard_topk",
    """WITH v AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part), t AS (SELECT p_partkey, name, list_distinct(string_split(lower(name), ' ')) AS t FROM v),
    p AS (SELECT l.p_partkey AS a, r.p_partkey AS b, len(list_intersect(l.t, r.t)) AS i, len(l.t) AS x, len(r.t) AS y FROM t l JOIN t r ON l.name <> r.name),
    s AS (SELECT a, b, i / (x + y - i) AS j, row_number() OVER (PARTITION BY a ORDER BY i / (x + y - i) DESC, b) AS rn FROM p WHERE i / (x + y - i) >= 0.5)
    SELECT a AS p_partkey_a, b AS p_partkey_b, round(j, 6) AS jaccard, rn AS rank FROM s WHERE rn <= 3""",
)
def token_jaccard_topk(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    found = J.token_neighbours(v, v, "p_partkey", "name", 0.5, 3)
    return found.withColumns({"jaccard": F.round("jaccard", 6), "rank": F.col("rank").cast("long")})


@query(
    "vector_knn",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT * FROM s WHERE rank <= 5""",
)
def vector_knn(spark, d):
    e = table(spark, d, "embeddings")
    found = J.nearest_vectors(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return found.select("query", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(
    "top1_per_group",
    "SELECT c_custkey, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey GROUP BY 1 ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS usual FROM customer",
)
def top1_per_group(spark, d):
    top = top_value(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")
    return table(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderpriority").alias("usual"))


@query(
    "two_endpoint_join",
    """SELECT a.n_name AS from_nation, b.n_name AS to_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY ALL""",
)
def two_endpoint_join(spark, d):
    n = table(spark, d, "nation")
    rows = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count("*").alias("n"))
    )
    a, b = (n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(v)) for k, v in (("c_nationkey", "from_nation"), ("s_nationkey", "to_nation")))
    return rows.join(a, "c_nationkey").join(b, "s_nationkey").select("from_nation", "to_nation", "n")


@query("text_key_join", "SELECT a.doc_id, count(*) AS copies FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang GROUP BY 1")
def text_key_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    copies = docs.groupBy("key", "lang").agg(F.count("*").alias("copies"))
    return docs.join(copies, ["key", "lang"]).select("doc_id", "copies")
