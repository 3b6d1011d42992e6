"""Queries of the window operators."""

from pyspark.sql import functions as F

from wayline.operators import windows as W
from wayline.plans.registry import query, table


@query("dup_flag", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50 ORDER BY l_linenumber) > 1 AS is_duplicate FROM lineitem")
def dup_flag(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 50)
    return W.duplicate_flag(li, ["l_orderkey", "k"], [F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "is_duplicate")


@query("pick_one", "SELECT o_custkey, o_orderkey, x FROM (SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '1-URGENT') AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderpriority, '1-URGENT') ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def pick_one(spark, d):
    o = table(spark, d, "orders").withColumn("x", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return W.pick_one(o, ["o_custkey"], [F.asc_nulls_last("x"), F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "x"])


@query("triples", "WITH t AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY ALL")
def triples(spark, d):
    return W.triples(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("salted_sample", "SELECT p_type, p_partkey, pick FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || 'gold'), p_partkey) AS pick FROM part) WHERE pick <= 10")
def salted_sample(spark, d):
    return W.salted_sample(table(spark, d, "part"), ["p_type"], "p_partkey", "gold", 10).select("p_type", "p_partkey", F.col("pick").cast("long").alias("pick"))


_VOC = "(SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1)"


@query(
    "tercile_sample",
    f"WITH t AS (SELECT value, n, ntile(3) OVER (ORDER BY n DESC, value) AS tercile FROM {_VOC}), s AS (SELECT *, row_number() OVER (PARTITION BY tercile ORDER BY md5(value || 'x'), value) AS pick FROM t) SELECT value, n, tercile, pick FROM s WHERE pick <= 15",
)
def tercile_sample(spark, d):
    v = table(spark, d, "part").groupBy(F.col("p_name").alias("value")).agg(F.count("*").alias("n"))
    s = W.salted_sample(W.terciles(v, "n", "value"), ["tercile"], "value", "x", 15)
    return s.select("value", "n", F.col("tercile").cast("long").alias("tercile"), F.col("pick").cast("long").alias("pick"))


@query("pct_rank_avg", "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part")
def pct_rank_avg(spark, d):
    return W.average_percent_rank(table(spark, d, "part"), ["p_brand"], "p_size", "pct").select("p_partkey", F.round("pct", 6).alias("pct"))


@query("z_scores", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z FROM part")
def z_scores(spark, d):
    return W.z_scores(table(spark, d, "part"), "p_retailprice", "z").select("p_partkey", F.round("z", 6).alias("z"))


@query("clip_confidence", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, round(least(1.0, n / (SELECT quantile_cont(n, 0.9) FROM c)), 6) AS confidence FROM c")
def clip_confidence(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return W.clip_confidence(c, "n", 0.9, "confidence").select("o_custkey", F.round("confidence", 6).alias("confidence"))


@query(
    "collapse_runs",
    """WITH l AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) OVER w AS run, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS segment FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, CAST(segment AS BIGINT) AS segment, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM m WHERE event_type <> 'error' GROUP BY ALL""",
)
def collapse_runs(spark, d):
    return W.collapse_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "error")


@query("partition_size", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def partition_size(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return o.join(per, "o_custkey").select("o_orderkey", "n", F.round(F.col("o_totalprice") / F.col("t"), 6).alias("share"))


@query("two_rankings", "WITH c AS (SELECT p_name, count(*) AS n, round(sum(p_retailprice), 4) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_name) AS by_n, row_number() OVER (ORDER BY v DESC, p_name) AS by_v FROM c) SELECT p_name, by_n, by_v FROM r WHERE by_n <= 20 OR by_v <= 20")
def two_rankings(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("v"))
    r = c.select("p_name", *(F.row_number().over(Window.orderBy(F.desc(x), "p_name")).cast("long").alias(f"by_{x}") for x in ("n", "v")))
    return r.filter("by_n <= 20 OR by_v <= 20")
