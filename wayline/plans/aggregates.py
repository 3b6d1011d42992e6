"""Queries of the aggregates, top-k and set operations."""

from pyspark.sql import functions as F

from wayline.operators import aggregates as A
from wayline.plans.registry import query, table

_OC = "orders JOIN customer ON o_custkey = c_custkey"


def order_customer(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(
    "grouped_stats",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 6) AS avg_price, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_partkey) AS parts,
    count(*) FILTER (l_discount > 0.05) AS discounted, bool_or(l_quantity = 50) AS any_full FROM lineitem GROUP BY ALL""",
)
def grouped_stats(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("avg_price"),
        F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"),
        F.count_distinct("l_partkey").alias("parts"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.bool_or(F.col("l_quantity") == 50).alias("any_full"),
    )


@query(
    "arg_extremes",
    "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS last_filled FROM orders GROUP BY 1",
)
def arg_extremes(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min_by("o_orderpriority", at).alias("first_priority"), F.max_by("o_totalprice", F.when(F.col("o_orderstatus") == "F", at)).alias("last_filled")
    )


@query(
    "det_mode",
    """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, arg_max(o_orderpriority, (n, -CAST(left(o_orderpriority, 1) AS INT))) AS o_orderpriority, max(n) AS support, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1""",
)
def det_mode(spark, d):
    return A.top_value(order_customer(spark, d), ["c_mktsegment"], "o_orderpriority")


@query(
    "dominance_label",
    """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS rn FROM c)
    SELECT l_orderkey, CASE WHEN n >= 0.9 * total THEN l_returnflag END AS dominant, n AS support, CAST(total AS BIGINT) AS total FROM t WHERE rn = 1""",
)
def dominance_label(spark, d):
    return A.dominant(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", 0.9, "dominant")


@query(
    "support_gated_modal_id",
    """WITH c AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY p_name) AS freq, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) AS rn FROM c)
    SELECT p_name AS value, CAST(freq AS BIGINT) AS freq, CASE WHEN freq >= 3 AND n >= 0.5 * freq THEN p_brand END AS modal_id FROM t WHERE rn = 1""",
)
def support_gated_modal_id(spark, d):
    top = A.top_value(table(spark, d, "part"), ["p_name"], "p_brand")
    gate = (F.col("total") >= 3) & (F.col("support") >= 0.5 * F.col("total"))
    return top.select(F.col("p_name").alias("value"), F.col("total").alias("freq"), F.when(gate, F.col("p_brand")).alias("modal_id"))


@query(
    "ordered_capped_list",
    "SELECT o_custkey, list(o_orderkey ORDER BY rn) AS largest FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1",
)
def ordered_capped_list(spark, d):
    return A.capped_list(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "largest")


@query(
    "topk_string_agg",
    "SELECT p_brand, string_agg(left(p_name, 8), ' | ' ORDER BY rn) AS names FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 4 GROUP BY 1",
)
def topk_string_agg(spark, d):
    listed = A.capped_list(table(spark, d, "part"), ["p_brand"], "p_name", [F.desc("p_retailprice"), F.asc("p_partkey")], 4, "v")
    return listed.select("p_brand", F.array_join(F.transform("v", lambda x: F.left(x, F.lit(8))), " | ").alias("names"))


@query("distinct_list", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1")
def distinct_list(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))


@query("vocabulary_profile", "SELECT p_name AS value, count(*) AS freq FROM part GROUP BY 1")
def vocabulary_profile(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("freq"))


@query(
    "overlap_cube",
    f"""WITH r AS (SELECT *, o_totalprice AS p FROM {_OC}), g AS (SELECT 'all' AS grp, * FROM r UNION ALL SELECT 'building', * FROM r WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'rich', * FROM r WHERE c_acctbal > 5000 UNION ALL SELECT 'urgent', * FROM r WHERE o_orderpriority = '1-URGENT')
    SELECT grp, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS persons, round(avg(p), 6) AS avg_price FROM g GROUP BY ALL""",
)
def overlap_cube(spark, d):
    groups = {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING", "rich": F.col("c_acctbal") > 5000, "urgent": F.col("o_orderpriority") == "1-URGENT"}
    measures = [F.count("*").alias("n"), F.count_distinct("o_custkey").alias("persons"), F.round(F.avg("o_totalprice"), 6).alias("avg_price")]
    return A.overlapping_cube(order_customer(spark, d), groups, ["o_orderstatus"], measures)


@query("single_group_entities", "SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1")
def single_group_entities(spark, d):
    return A.single_group(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


_DIV = """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER w AS p, row_number() OVER (w ORDER BY n DESC, o_orderpriority) AS rn,
 coalesce(sum(n) OVER (w ORDER BY n DESC, o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER w AS before FROM c WINDOW w AS (PARTITION BY c_mktsegment))
SELECT c_mktsegment, count(*) AS categories, round(-sum(p * ln(p)), 6) AS entropy, round(1 / sum(p * p), 6) AS effective, round(sum(p) FILTER (rn <= 3), 6) AS top3, count(*) FILTER (before < 0.8 - 1e-12) AS cover80 FROM s GROUP BY 1"""


@query("diversity_panel", _DIV)
def diversity_panel(spark, d):
    return A.diversity(order_customer(spark, d), ["c_mktsegment"], "o_orderpriority")


@query(
    "destination_fan",
    """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY c_mktsegment) AS share FROM c)
    SELECT s.c_mktsegment, s.o_orderpriority, s.n, round(s.share, 6) AS share, round(s.share / b.share, 6) AS rr FROM s LEFT JOIN s b ON b.c_mktsegment = 'BUILDING' AND b.o_orderpriority = s.o_orderpriority""",
)
def destination_fan(spark, d):
    return A.destination_fan(order_customer(spark, d), "c_mktsegment", "o_orderpriority", "BUILDING")


@query(
    "fan_detail",
    """WITH r AS (SELECT p_brand, CASE WHEN p_size <= 40 THEN p_type END AS major, CASE WHEN p_size <= 20 THEN p_name END AS detail FROM part)
    SELECT p_brand, CASE WHEN major IS NULL THEN 'no detail' WHEN detail IS NULL THEN 'other coded' ELSE 'named' END AS coverage, count(*) AS n, count(DISTINCT detail) AS details FROM r GROUP BY ALL""",
)
def fan_detail(spark, d):
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") <= 40, F.col("p_type")).alias("major"), F.when(F.col("p_size") <= 20, F.col("p_name")).alias("detail"))
    coverage = F.when(F.col("major").isNull(), "no detail").when(F.col("detail").isNull(), "other coded").otherwise("named")
    return p.groupBy("p_brand", coverage.alias("coverage")).agg(F.count("*").alias("n"), F.count_distinct("detail").alias("details"))


@query(
    "fold_other",
    """WITH c AS (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, n_name) AS rn FROM c)
    SELECT c_mktsegment, CASE WHEN rn > 5 THEN 'Other' ELSE n_name END AS n_name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""",
)
def fold_other(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    return A.fold_tail(c, ["c_mktsegment"], "n_name", "n", 5)


_SUPP = """WITH c AS (SELECT s_nationkey, CAST(s_acctbal / 1000 AS INT) AS band, count(*) AS n FROM supplier GROUP BY ALL), m AS (SELECT *, n < 2 AS small FROM c), r AS (SELECT *, sum(small::INT) OVER (PARTITION BY s_nationkey) AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY small, n, band) AS rk FROM m)
SELECT s_nationkey, band, CASE WHEN NOT (small OR (k = 1 AND NOT small AND rk = 1)) THEN n END AS n, small OR (k = 1 AND NOT small AND rk = 1) AS suppressed FROM r"""


@query("two_cell_suppression", _SUPP)
def two_cell_suppression(spark, d):
    c = table(spark, d, "supplier").groupBy("s_nationkey", F.rint(F.col("s_acctbal") / 1000).cast("int").alias("band")).agg(F.count("*").alias("n"))
    return A.suppress(c, ["s_nationkey"], "n", 2, "band").withColumn("n", F.when(~F.col("suppressed"), F.col("n")))


@query(
    "size_buckets",
    """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n < 2 THEN '1' WHEN n < 6 THEN '2-5' WHEN n < 11 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM s GROUP BY 1""",
)
def size_buckets(spark, d):
    return A.concentration(table(spark, d, "orders"), "o_custkey", [("1", 1, 2), ("2-5", 2, 6), ("6-10", 6, 11), ("11+", 11, None)])


@query(
    "set_breadth",
    "WITH p AS (SELECT event_type, date_part('day', ts) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL) SELECT event_type, count(*) FILTER (users >= 40) AS reached, max(users) AS most FROM p GROUP BY 1",
)
def set_breadth(spark, d):
    p = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return p.groupBy("event_type").agg(F.count_if(F.col("users") >= 40).alias("reached"), F.max("users").alias("most"))


@query(
    "midpoint_percentile",
    f"""WITH g AS (SELECT c_mktsegment, median(p) AS x FROM (SELECT c_mktsegment, floor(o_totalprice / 1000) AS p FROM {_OC}) GROUP BY 1)
    SELECT c_mktsegment, x, round(100 * (count(*) FILTER (v < x) + 0.5 * count(*) FILTER (v = x)) / count(*), 6) AS percentile FROM g CROSS JOIN (SELECT floor(o_totalprice / 1000) AS v FROM orders) GROUP BY ALL""",
)
def midpoint_percentile(spark, d):
    rows = order_customer(spark, d).select("c_mktsegment", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))
    return A.midpoint_percentile(rows.groupBy("c_mktsegment").agg(F.median("v").alias("x")), rows, "c_mktsegment", "x", "v")


@query("quantiles", f"SELECT c_mktsegment, median(o_totalprice) AS med, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM {_OC} GROUP BY 1")
def quantiles(spark, d):
    return order_customer(spark, d).groupBy("c_mktsegment").agg(F.median("o_totalprice").alias("med"), F.round(F.percentile("o_totalprice", 0.9), 6).alias("p90"))


@query(
    "coverage_by_depth",
    """WITH c AS (SELECT r_name || '.' || n_name || CASE WHEN c_acctbal > 0 THEN '.' || c_mktsegment ELSE '' END AS code, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), d AS (SELECT len(string_split(code, '.')) AS depth FROM c)
    SELECT k AS level, count(*) FILTER (depth >= k) AS coded, round(count(*) FILTER (depth >= k) / count(*), 6) AS share FROM d CROSS JOIN (VALUES (1), (2), (3), (4)) v(k) GROUP BY 1""",
)
def coverage_by_depth(spark, d):
    depth = hierarchical_codes(spark, d).select(F.size(F.split("code", "\\.")).alias("depth"))
    by = depth.groupBy("depth").agg(F.count("*").alias("n")).withColumn("level", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    deep = F.sum(F.when(F.col("depth") >= F.col("level"), F.col("n")).otherwise(0))
    return by.groupBy("level").agg(deep.alias("coded"), F.round(deep / F.sum("n"), 6).alias("share"))


def hierarchical_codes(spark, d):
    """Dotted codes region.nation[.segment] of customers."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.withColumn("code", F.concat("r_name", F.lit("."), "n_name", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("."), "c_mktsegment")).otherwise("")))


@query("method_mix", "SELECT o_orderpriority AS method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def method_mix(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("method", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(
    "purity",
    "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c) SELECT p_brand, p_type, round(n / total, 6) AS purity, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1",
)
def purity(spark, d):
    return A.purity(table(spark, d, "part"), "p_brand", "p_type")


@query(
    "era_drift",
    """WITH c AS (SELECT CASE WHEN year(o_orderdate) < 1998 THEN 'first' ELSE 'last' END AS era, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, n / sum(n) OVER (PARTITION BY era) AS share, (rank() OVER (PARTITION BY era ORDER BY n) + (count(*) OVER (PARTITION BY era, n) - 1) / 2) / count(*) OVER (PARTITION BY era) AS pct FROM c)
    SELECT a.n_name, a.n AS n_first, b.n AS n_last, round(b.share / a.share - 1, 6) AS growth, round(b.pct - a.pct, 6) AS shift FROM r a JOIN r b ON a.n_name = b.n_name AND a.era = 'first' AND b.era = 'last' WHERE a.n >= 30 AND b.n >= 30""",
)
def era_drift(spark, d):
    from wayline.operators.windows import average_percent_rank

    rows = order_customer(spark, d).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy(F.when(F.year("o_orderdate") < 1998, "first").otherwise("last").alias("era"), "n_name").agg(F.count("*").alias("n"))
    totals = counts.groupBy("era").agg(F.sum("n").alias("t"))
    ranked = average_percent_rank(counts, ["era"], "n", "pct").join(totals, "era").withColumn("share", F.col("n") / F.col("t"))
    a, b = (ranked.filter(F.col("era") == e).select("n_name", *(F.col(c).alias(f"{c}_{e}") for c in ("n", "share", "pct"))) for e in ("first", "last"))
    both = a.join(b, "n_name").filter("n_first >= 30 AND n_last >= 30")
    return both.select("n_name", "n_first", "n_last", F.round(F.col("share_last") / F.col("share_first") - 1, 6).alias("growth"), F.round(F.col("pct_last") - F.col("pct_first"), 6).alias("shift"))


@query("content_fingerprint")
def content_fingerprint(spark, d):
    return A.fingerprint(table(spark, d, "lineitem"))


@query(
    "portable_fingerprint",
    """WITH r AS (SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.6f', l_quantity), printf('%.6f', l_extendedprice), printf('%.6f', l_discount), printf('%.6f', l_tax), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS t FROM lineitem), m AS (SELECT ('0x' || left(md5(t), 15))::BIGINT AS x FROM r)
    SELECT count(*) AS rows, bit_xor(x) AS checksum, CAST(sum(x) AS VARCHAR) AS total FROM m""",
)
def portable_fingerprint(spark, d):
    return A.portable_fingerprint(table(spark, d, "lineitem"))


@query(
    "nested_tier_counts",
    "SELECT p_brand, count(*) AS all_rows, count(*) FILTER (p_size > 10) AS tier1, count(*) FILTER (p_size > 10 AND p_retailprice > 1200) AS tier2, count(*) FILTER (p_size > 10) >= count(*) FILTER (p_size > 10 AND p_retailprice > 1200) AS nested FROM part GROUP BY 1",
)
def nested_tier_counts(spark, d):
    t1, t2 = F.count_if(F.col("p_size") > 10), F.count_if((F.col("p_size") > 10) & (F.col("p_retailprice") > 1200))
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("all_rows"), t1.alias("tier1"), t2.alias("tier2"), (t1 >= t2).alias("nested"))


@query(
    "participation_rates",
    "SELECT c_mktsegment, count(*) AS n, round(avg(CAST(o.o_custkey IS NOT NULL AS INT)), 6) AS ordering, round(avg(CAST(u.o_custkey IS NOT NULL AS INT)), 6) AS urgent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') u ON c_custkey = u.o_custkey GROUP BY 1",
)
def participation_rates(spark, d):
    flags = table(spark, d, "orders").groupBy("o_custkey").agg(F.lit(1).alias("ordering"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    c = table(spark, d, "customer").join(flags, F.col("c_custkey") == F.col("o_custkey"), "left")
    rate = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0))), 6).alias(x)
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), rate("ordering"), rate("urgent"))


@query(
    "group_funnel",
    f"SELECT c_mktsegment, count(*) AS records, count(DISTINCT o_custkey) AS entities, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS anchored, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice > 100000) AS windowed, round(1 - count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') / count(*), 6) AS dropped FROM {_OC} GROUP BY 1",
)
def group_funnel(spark, d):
    a = F.year("o_orderdate") >= 1996
    return order_customer(spark, d).groupBy("c_mktsegment").agg(
        F.count("*").alias("records"), F.count_distinct("o_custkey").alias("entities"), F.count_if(a).alias("anchored"), F.count_if(a & (F.col("o_totalprice") > 100000)).alias("windowed"), F.round(1 - F.count_if(a) / F.count("*"), 6).alias("dropped")
    )


@query(
    "external_share",
    "WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT o_orderpriority, y, n / sum(n) OVER (PARTITION BY y) AS ours FROM c), p AS (SELECT o_orderpriority, count(*) / (SELECT count(*) FROM orders) AS published FROM orders GROUP BY 1) SELECT y, o_orderpriority, round(ours, 6) AS ours, round(ours / published, 6) AS ratio FROM s JOIN p USING (o_orderpriority)",
)
def external_share(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("n"))
    years = o.groupBy("y").agg(F.sum("n").alias("yt"))
    published = o.groupBy("o_orderpriority").agg(F.sum("n").alias("pn")).join(F.broadcast(o.agg(F.sum("n").alias("t")))).select("o_orderpriority", (F.col("pn") / F.col("t")).alias("published"))
    s = o.join(years, "y").withColumn("ours", F.col("n") / F.col("yt")).join(published, "o_orderpriority")
    return s.select("y", "o_orderpriority", F.round("ours", 6).alias("ours"), F.round(F.col("ours") / F.col("published"), 6).alias("ratio"))


@query("having_groups", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1 HAVING count(*) >= 80 OR avg(p_retailprice) > 1500")
def having_groups(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))
    return g.filter("n >= 80 OR price > 1500").withColumn("price", F.round("price", 6))


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("head_with_includes", "SELECT p_name AS value, count(*) AS freq FROM part GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, p_name) <= 20 OR starts_with(p_name, 'a')")
def head_with_includes(spark, d):
    vocab = table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("freq"))
    return vocab.orderBy(F.desc("freq"), "value").limit(20).union(vocab.filter(F.startswith("value", F.lit("a")))).distinct()


@query("work_list", "WITH c AS (SELECT p_name AS value, count(*) AS freq FROM part GROUP BY 1) SELECT value, freq, round(sum(freq) OVER (ORDER BY freq DESC, value) / sum(freq) OVER (), 6) AS covered FROM c")
def work_list(spark, d):
    from wayline.operators.windows import running_share

    vocab = table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("freq"))
    return running_share(vocab, "freq", "value", "covered")


@query("append_new_keys", "SELECT p_type AS k, 'old' AS src FROM part WHERE p_size < 10 GROUP BY 1 UNION ALL SELECT p_brand, 'new' FROM part WHERE p_brand NOT IN (SELECT p_type FROM part WHERE p_size < 10) GROUP BY 1")
def append_new_keys(spark, d):
    p = table(spark, d, "part")
    old = p.filter("p_size < 10").select(F.col("p_type").alias("k")).distinct().withColumn("src", F.lit("old"))
    new = p.select(F.col("p_brand").alias("k")).distinct().join(old, "k", "left_anti").withColumn("src", F.lit("new"))
    return old.unionByName(new)


@query("set_algebra", "SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000) UNION ALL SELECT k, 'first' FROM (SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)")
def set_algebra(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    a, b = o.filter("y = 1995").select("k"), o.filter("y = 2000").select("k")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@query("cluster_balance", "WITH s AS (SELECT sum(p_size) / (SELECT sum(p_size) FROM part) AS p FROM part GROUP BY p_type) SELECT count(*) AS clusters, round(exp(-sum(p * ln(p))), 6) AS effective, round(max(p), 6) AS largest_share FROM s")
def cluster_balance(spark, d):
    from wayline.operators.aggregates import cluster_balance as balance

    return balance(table(spark, d, "part"), "p_type", "p_size")
