"""Queries of the column builders."""

from pyspark.sql import functions as F

from wayline.operators import projections as P
from wayline.operators.aggregates import top_value
from wayline.plans.registry import query, table


@query(
    "tiered_coalesce",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'vip' WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE o_orderstatus END AS label,
    CASE WHEN o_totalprice > 300000 THEN 'override' WHEN o_orderpriority <> '5-LOW' THEN 'priority' ELSE 'status' END AS label_source FROM orders""",
)
def tiered_coalesce(spark, d):
    o = table(spark, d, "orders")
    tiers = [("override", F.when(F.col("o_totalprice") > 300000, F.lit("vip")), None), ("priority", F.nullif("o_orderpriority", F.lit("5-LOW")), None), ("status", F.col("o_orderstatus"), None)]
    return P.tiered(o, "label", tiers).select("o_orderkey", "label", "label_source")


@query(
    "gated_tier",
    """SELECT p_partkey, CASE WHEN p_size BETWEEN 3 AND 7 THEN NULL ELSE p_type END AS kind,
    coalesce(CASE WHEN p_size BETWEEN 3 AND 7 THEN NULL ELSE p_type END, p_brand) AS code,
    CASE WHEN p_size BETWEEN 3 AND 7 THEN 'brand' ELSE 'type' END AS code_source FROM part""",
)
def gated_tier(spark, d):
    gate = ~F.col("p_size").between(3, 7)
    df = P.tiered(table(spark, d, "part"), "code", [("type", F.col("p_type"), gate), ("brand", F.col("p_brand"), None)])
    return df.select("p_partkey", F.when(gate, F.col("p_type")).alias("kind"), "code", "code_source")


@query(
    "bucket_labels",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'early' WHEN year(o_orderdate) < 2000 THEN 'middle' ELSE 'late' END AS era,
    CAST(floor(year(o_orderdate) / 5) * 5 AS INTEGER) AS cohort_bin FROM orders""",
)
def bucket_labels(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", P.bucket_label(y, [("early", None, 1997), ("middle", 1997, 2000), ("late", 2000, None)]).alias("era"), P.floor_bin(y, 5).alias("cohort_bin"))


@query(
    "nearest_bucket",
    """SELECT o_orderkey, CASE WHEN least(abs(y - 1995), abs(y - 1998), abs(y - 2001)) > 1 THEN NULL
    WHEN abs(y - 1995) <= 1 THEN 1995 WHEN abs(y - 1998) <= 1 THEN 1998 ELSE 2001 END AS target FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""",
)
def nearest_bucket(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.nearest_target(F.year("o_orderdate"), [1995, 1998, 2001], 1).alias("target"))


_PREFIX_SQL = """WITH codes AS (SELECT p_partkey, replace(p_brand, 'Brand#', '') || '.' || p_type AS code FROM part),
pre AS (SELECT left(code, 1) AS prefix, 'coarse ' || left(code, 1) AS label FROM codes UNION SELECT left(code, 2), 'fine ' || left(code, 2) FROM codes WHERE left(code, 1) IN ('1', '2')),
hit AS (SELECT p_partkey, label, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS rn FROM codes JOIN pre ON starts_with(code, prefix))
SELECT c.p_partkey, c.code, h.label FROM codes c LEFT JOIN hit h ON c.p_partkey = h.p_partkey AND rn = 1"""


@query("longest_prefix_code", _PREFIX_SQL)
def longest_prefix_code(spark, d):
    codes = table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), "p_type").alias("code"))
    fine = codes.filter(F.left("code", F.lit(1)).isin("1", "2")).select(F.left("code", F.lit(2)).alias("prefix"))
    prefixes = codes.select(F.left("code", F.lit(1)).alias("prefix")).distinct().withColumn("label", F.concat(F.lit("coarse "), "prefix"))
    prefixes = prefixes.unionByName(fine.distinct().withColumn("label", F.concat(F.lit("fine "), "prefix")))
    return P.longest_prefix(codes, "code", prefixes, "prefix", "label", 2).select("p_partkey", "code", "label")


@query(
    "trusted_modal_code",
    """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment) AS total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) AS rn FROM c)
    SELECT c_mktsegment, CASE WHEN n >= 100 AND n >= 0.2 * total THEN o_orderpriority END AS trusted, n AS support, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1""",
)
def trusted_modal_code(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = top_value(rows, ["c_mktsegment"], "o_orderpriority")
    return top.select("c_mktsegment", P.trusted(F.col("o_orderpriority"), F.col("support"), F.col("total"), 100, 0.2).alias("trusted"), "support", "total")


@query(
    "valid_intervals",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_dt, e AS end_dt FROM orders JOIN
    (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE e >= CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) <= DATE '2000-12-31'""",
)
def valid_intervals(spark, d):
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("end_dt"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("start_dt"))
    rows = o.join(ends, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return rows.filter(P.valid_interval(F.col("start_dt"), F.col("end_dt"), F.lit("2000-12-31").cast("date")))


@query("bounded_entities", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 10)")
def bounded_entities(spark, d):
    return P.bounded_entities(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10)


@query(
    "word_boundary_flag",
    r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(licensed|license)\b') AND NOT regexp_matches(coalesce(text, ''), '(?i)\b(apache)\b') AS flagged FROM documents",
)
def word_boundary_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", P.word_flag(F.coalesce("text", F.lit("")), ["licensed", "license"], ["apache"]).alias("flagged"))


@query("kind_prefix", "SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS first_family, split_part(p_brand, '#', 2) AS number FROM part")
def kind_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", F.startswith("p_brand", F.lit("Brand#1")).alias("first_family"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("number"))


@query(
    "equal_window",
    "WITH a AS (SELECT o_custkey, min(year(o_orderdate)) AS anchor FROM orders GROUP BY 1) SELECT o_custkey, anchor FROM a WHERE anchor <= 2001 - 5",
)
def equal_window(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("anchor")).filter(F.col("anchor") <= 2001 - 5)


@query(
    "backfill_sibling",
    """WITH b AS (SELECT p_partkey, nullif(p_type, 'SMALL') AS field, nullif(p_brand, 'Brand#11') AS degree, p_size FROM part)
    SELECT p_partkey, CASE WHEN field IS NULL AND degree IS NOT NULL AND p_size > 10 THEN degree ELSE field END AS field,
    CASE WHEN field IS NULL AND degree IS NOT NULL AND p_size > 10 THEN NULL ELSE degree END AS degree FROM b""",
)
def backfill_sibling(spark, d):
    b = table(spark, d, "part").select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("field"), F.nullif("p_brand", F.lit("Brand#11")).alias("degree"), "p_size")
    return P.backfill(b, "field", "degree", F.col("p_size") > 10).drop("p_size")


@query(
    "imputation_gate",
    """SELECT p_partkey, coalesce(p_size >= 20, FALSE) AND NOT regexp_matches(p_name, '(?i)red|blue') AND p_retailprice < 1500 AS imputed FROM part""",
)
def imputation_gate(spark, d):
    return table(spark, d, "part").select("p_partkey", P.all_of(F.col("p_size") >= 20, ~F.col("p_name").rlike("(?i)red|blue"), F.col("p_retailprice") < 1500).alias("imputed"))


@query("reapply_columns", "SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS with_tax FROM orders")
def reapply_columns(spark, d):
    once = P.reapply(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"with_tax": F.col("o_totalprice") * 2})
    return P.reapply(once, {"with_tax": F.col("o_totalprice") * 2})
