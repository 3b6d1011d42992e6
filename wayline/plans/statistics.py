"""Queries of the statistics."""

from pyspark.sql import functions as F

from wayline.operators import statistics as M
from wayline.plans.registry import query, table

_SURV = """(SELECT c_mktsegment, least(coalesce(u, l), l) AS t, u IS NOT NULL AS event FROM (SELECT o_custkey, date_diff('month', CAST(min(o_orderdate) AS DATE), CAST(min(o_orderdate) FILTER (o_orderpriority = '1-URGENT') AS DATE)) AS u, date_diff('month', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS l FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey)"""


def durations(spark, d):
    """Months from first order to first urgent one, censored at the last order."""
    from wayline.operators.trajectories import months_between

    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("b"), F.max("o_orderdate").alias("z"))
    o = o.select("o_custkey", months_between(F.col("a"), F.coalesce("b", "z")).alias("t"), F.col("b").isNotNull().alias("event"))
    return o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))


@query(
    "km_by_group",
    f"""WITH p AS (SELECT c_mktsegment, t, count(*) AS n, sum(event::INT) AS d FROM {_SURV} GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY t DESC) AS risk FROM p)
    SELECT c_mktsegment, t, CAST(risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN min(risk - d) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY t)""",
)
def km_by_group(spark, d):
    return M.kaplan_meier(durations(spark, d), "c_mktsegment", "t", "event").withColumn("survival", F.round("survival", 6))


@query(
    "median_survival",
    f"""WITH p AS (SELECT c_mktsegment, t, count(*) AS n, sum(event::INT) AS d FROM {_SURV} GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY t DESC) AS risk FROM p),
    s AS (SELECT c_mktsegment, t, CASE WHEN min(risk - d) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w) END AS survival FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY t)) SELECT c_mktsegment, min(t) FILTER (survival <= 0.5) AS median FROM s GROUP BY 1""",
)
def median_survival(spark, d):
    return M.median_survival(M.kaplan_meier(durations(spark, d), "c_mktsegment", "t", "event"), "c_mktsegment", "t")


@query("cox_newton")
def cox_newton(spark, d):
    x = durations(spark, d).withColumns({"rich": (F.col("c_acctbal") > 5000).cast("double"), "building": (F.col("c_mktsegment") == "BUILDING").cast("double")})
    return spark.createDataFrame([(k, round(v, 6)) for k, v in M.cox(x, "t", "event", ["rich", "building"]).items()], "term string, coefficient double")


@query("wls_cluster")
def wls_cluster(spark, d):
    cells = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))
    cells = cells.withColumns({"trend": F.col("y") - 1995, "late": (F.col("y") >= 1999).cast("int")}).withColumn("late_trend", F.col("trend") * F.col("late"))
    return spark.createDataFrame(M.wls_clustered(cells, "price", ["trend", "late", "late_trend", "balance"], "n", "c_nationkey"), "term string, coefficient double, error double")


@query("kmeans_profiles")
def kmeans_profiles(spark, d):
    from wayline.plans.trajectories import trajectory_features

    return M.kmeans_profiles(trajectory_features(spark, d), "o_custkey", ["moves", "up_share", "mean_dwell", "longest_gap"], 4)


@query("weak_label_logit")
def weak_label_logit(spark, d):
    e = table(spark, d, "embeddings").withColumns({"wl_label": F.when(F.col("vec_id") % 3 != 0, F.col("label")), "w": F.lit(1.0)})
    return M.weak_label_classifier(e, "vec_id", "embedding", "wl_label", "w", 0.5)


@query("vendi_bootstrap")
def vendi_bootstrap(spark, d):
    return M.bootstrap_vendi(table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string")), "label", "vec_id", "embedding", 30, 10)


@query(
    "within_spread",
    "WITH e AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings), s AS (SELECT label, i, sum(v[i]) AS s, count(*) AS k FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY ALL) SELECT label, max(k) AS k, round(1 - (sum(s * s) - max(k)) / (max(k) * (max(k) - 1)), 6) AS spread FROM s GROUP BY 1",
)
def within_spread(spark, d):
    return M.within_spread(table(spark, d, "embeddings"), "label", "embedding")


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    return M.spearman(table(spark, d, "part"), "p_size", "p_retailprice")


@query(
    "adjusted_rand",
    "WITH n AS (SELECT p_type AS a, left(p_name, 3) AS b, count(*) AS n FROM part GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM n), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT a, sum(n) AS n FROM n GROUP BY 1)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT b, sum(n) AS n FROM n GROUP BY 1)) SELECT round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM i, x, y",
)
def adjusted_rand(spark, d):
    return M.adjusted_rand(table(spark, d, "part").withColumn("b", F.left("p_name", F.lit(3))), "p_type", "b")


@query(
    "threshold_sweep",
    "WITH s AS (SELECT l_quantity / 25 - 1 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y FROM lineitem), g AS (SELECT t AS threshold, y, CASE WHEN s > t THEN 1 WHEN s < -t THEN -1 END AS c FROM s CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75)) v(t)) SELECT threshold, round(count(c) / count(*), 6) AS coverage, round(count(*) FILTER (c = y) / count(c), 6) AS accuracy, round(count(*) FILTER (c = 1 AND y = 1) / nullif(count(*) FILTER (c = 1), 0), 6) AS up_precision, round(count(*) FILTER (c = -1 AND y = -1) / nullif(count(*) FILTER (c = -1), 0), 6) AS down_precision FROM g GROUP BY 1",
)
def threshold_sweep(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 25 - 1).alias("s"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("y"))
    return M.threshold_sweep(li, "s", "y", [0.0, 0.25, 0.5, 0.75])


@query(
    "recommended_threshold",
    "WITH s AS (SELECT l_quantity / 25 - 1 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y FROM lineitem), g AS (SELECT t AS threshold, y, CASE WHEN s > t THEN 1 WHEN s < -t THEN -1 END AS c FROM s CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75)) v(t)), r AS (SELECT threshold, round(count(c) / count(*), 6) AS coverage, round(count(*) FILTER (c = y) / nullif(count(c), 0), 6) AS accuracy FROM g GROUP BY 1) SELECT threshold, coverage, accuracy, accuracy >= 0.5 AS meets_target FROM r ORDER BY accuracy >= 0.5 DESC, CASE WHEN accuracy >= 0.5 THEN 0 ELSE -accuracy END, threshold LIMIT 1",
)
def recommended_threshold(spark, d):
    return M.recommended_threshold(threshold_sweep(spark, d), 0.5)


def people(spark, d):
    """Vectors as roles of people, seven people to a label at least, and the same vectors cut to eight numbers as a second basis."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 97).alias("person"), "embedding", F.slice("embedding", 1, 8).alias("short"))


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    return M.paired_bootstrap(people(spark, d), "label", "person", "vec_id", ["embedding", "short"], 20, 10)


@query("sensitivity")
def sensitivity(spark, d):
    restrictions = {"even": F.col("vec_id") % 2 == 0, "positive": F.col("short")[0] > 0}
    return M.sensitivity(people(spark, d), restrictions, "label", "person", "vec_id", ["embedding", "short"], 20, 5)
