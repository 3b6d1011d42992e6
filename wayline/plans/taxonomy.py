"""Queries of the rules and taxonomies: parts as job titles, degrees and fields of study in several spellings."""

from pyspark.sql import functions as F

from wayline.operators import taxonomy as Y
from wayline.plans.registry import query, table
from wayline.plans.spelling import _FORMS, employers

_RULES = [
    ("family", 0, "old ring", "antique", "high", False, False), ("family", 1, "ring", "jewel", "high", False, False), ("family", 2, "bolt", "hardware", "high", False, False), ("family", 3, "gear", "hardware", "low", False, False),
    ("family", 4, "large rod", "rods", "low", False, False), ("family", 9, "hot plate", "kitchen", "high", True, False), ("seniority", 1, "standard", "senior", "high", False, False), ("seniority", 2, "small", "entry", "high", False, False),
    ("seniority", 0, "small ring", "entry", "high", False, True), ("flag", 0, "economy", "cheap", "high", False, False), ("flag", 0, "promo", "promo", "high", False, False), ("flag", 0, "red", "red", "high", False, False), ("flag", 0, "red rod", "red", "high", False, True),
]
RULES = "axis string, rank int, phrase string, label string, confidence string, exact boolean, blocks boolean"
_TITLES = """t AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_type || ' ' || p_name || ' at ' || p_brand WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN p_name ELSE p_type || '-' || p_name || ' @ home' END AS title, CASE WHEN p_partkey % 4 IN (0, 3) THEN lower(p_type || ' ' || p_name) ELSE p_name END AS w, CASE WHEN p_partkey % 4 = 1 THEN lower(p_type) ELSE '' END AS m FROM part), p AS (SELECT title, ' ' || w || ' ' AS w, m FROM t)"""


def titles(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    form = F.when(k == 0, F.concat("p_type", F.lit(" "), "p_name", F.lit(" at "), "p_brand")).when(k == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).when(k == 2, F.col("p_name")).otherwise(F.concat("p_type", F.lit("-"), "p_name", F.lit(" @ home")))
    return p.select(form.alias("title")).distinct().withColumns(Y.title_words(F.col("title"), {}))


@query("title_words", f"WITH {_TITLES} SELECT title, trim(w) AS words, CASE WHEN m = '' THEN CAST([] AS VARCHAR[]) ELSE [m] END AS modifiers FROM p")
def title_words(spark, d):
    return titles(spark, d)


@query(
    "classify_titles",
    f"""WITH {_TITLES}, c AS (SELECT *, CASE WHEN w = ' hot plate ' THEN 'kitchen' WHEN w LIKE '% old ring %' THEN 'antique' WHEN w LIKE '% ring %' THEN 'jewel' WHEN w LIKE '% bolt %' OR w LIKE '% gear %' THEN 'hardware' WHEN w LIKE '% large rod %' THEN 'rods' ELSE 'unclassified' END AS family FROM p)
    SELECT title, family, CASE WHEN w LIKE '% standard %' THEN 'senior' WHEN w LIKE '% small %' AND w NOT LIKE '% small ring %' THEN 'entry' ELSE 'mid' END AS seniority, list_sort(list_filter([CASE WHEN w LIKE '% economy %' OR m = 'economy' THEN 'cheap' END, CASE WHEN w LIKE '% promo %' OR m = 'promo' THEN 'promo' END, CASE WHEN w LIKE '% red %' AND w NOT LIKE '% red rod %' THEN 'red' END], lambda x: x IS NOT NULL)) AS flags,
      CASE WHEN family IN ('unclassified', 'rods') OR (family = 'hardware' AND w NOT LIKE '% bolt %') THEN 'low' ELSE 'high' END AS confidence FROM c""",
)
def classify_titles(spark, d):
    return Y.classify_titles(titles(spark, d), "title", "words", "modifiers", spark.createDataFrame(_RULES, RULES))


@query(
    "field_codes",
    f"""WITH {_FORMS}, q AS (SELECT name AS value, min(g) AS g, count(*) AS freq FROM f WHERE k <= 5 GROUP BY 1), m AS (SELECT *, replace(lower(value), '-', ' ') AS norm FROM q), n AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(norm, ' '))), ' ') AS toks FROM m),
    x AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS key, 'E.' || replace(lower(p_name || ' ' || p_type), ' ', '.') AS code FROM part WHERE p_type IN ('ECONOMY', 'LARGE')), y AS (SELECT array_to_string(list_sort(list_distinct(string_split(key, ' '))), ' ') AS key, min(code) AS code FROM x GROUP BY 1), ov AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS key FROM part WHERE p_type = 'PROMO' AND p_name LIKE 'red%'), al AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS key FROM part WHERE p_type = 'MEDIUM' AND p_name LIKE 'hot%'),
    o AS (SELECT n.*, CASE WHEN ov.key IS NOT NULL THEN 'cip:P' WHEN x.code IS NOT NULL THEN 'cip:' || x.code WHEN y.code IS NOT NULL THEN 'cip:' || y.code WHEN al.key IS NOT NULL THEN 'cip:H' ELSE 'field_raw:' || norm END AS id, CASE WHEN ov.key IS NOT NULL THEN 'cip_override' WHEN x.code IS NOT NULL OR y.code IS NOT NULL THEN 'cip_exact' WHEN al.key IS NOT NULL THEN 'cip_alias' ELSE 'raw' END AS method FROM n LEFT JOIN ov ON norm = ov.key LEFT JOIN x ON norm = x.key LEFT JOIN y ON toks = y.key LEFT JOIN al ON norm = al.key),
    c AS (SELECT g, arg_min(value, (-freq, value)) AS rep FROM o GROUP BY 1), t AS (SELECT o.value, o.id AS oid, o.method AS om, o.method = 'raw' AND o.value <> rep AS typo, r.id AS rid, r.norm AS rn FROM o JOIN c USING (g) JOIN o AS r ON r.value = rep),
    v AS (SELECT value, CASE WHEN typo AND starts_with(rid, 'cip:') THEN rid WHEN typo THEN 'field_raw:' || rn ELSE oid END AS canonical_id, CASE WHEN typo AND starts_with(rid, 'cip:') THEN 'typo_to_cip' WHEN typo THEN 'typo' ELSE om END AS method FROM t)
    SELECT *, CAST(CASE method WHEN 'cip_exact' THEN 1 WHEN 'typo_to_cip' THEN 0.9 WHEN 'typo' THEN 0.85 WHEN 'raw' THEN 0.5 ELSE 0.98 END AS DOUBLE) AS confidence FROM v""",
)
def field_codes(spark, d):
    vocab = employers(spark, d).filter("l_linenumber <= 5").groupBy("name").agg(F.count("*").alias("freq"))
    p = table(spark, d, "part").select(F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("key"), "p_type", "p_name").distinct()
    titles_ = p.filter("p_type in ('ECONOMY', 'LARGE')").select("key", F.concat(F.lit("E."), F.replace(F.col("key"), F.lit(" "), F.lit("."))).alias("code"))
    by_tokens = Y.normal_forms(titles_, "key").select(F.col("tokens").alias("key"), "code")
    override = p.filter("p_type = 'PROMO' and p_name like 'red%'").select("key", F.lit("P").alias("code"))
    alias = p.filter("p_type = 'MEDIUM' and p_name like 'hot%'").select("key", F.lit("H").alias("code"))
    tiers = [("cip_override", 0.98, "norm", override), ("cip_exact", 1.0, "norm", titles_), ("cip_exact", 1.0, "tokens", by_tokens), ("cip_alias", 0.98, "norm", alias)]
    return Y.tiered_codes(vocab, "name", "freq", tiers, "cip", "field_raw")


@query(
    "guarded_crosswalk",
    """WITH s AS (SELECT 'school ' || c_nationkey AS key, CASE WHEN c_custkey % 97 = 0 THEN 'odd' ELSE 'u' || c_nationkey END AS code, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY key) AS t, row_number() OVER (PARTITION BY key ORDER BY n DESC, code) AS rn, lead(n) OVER (PARTITION BY key ORDER BY n DESC, code) AS second FROM s)
    SELECT key, code FROM r WHERE rn = 1 AND (second IS NULL OR (n >= 0.98 * t AND n - second >= 10))""",
)
def guarded_crosswalk(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.concat(F.lit("School-"), F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 97 == 0, "odd").otherwise(F.concat(F.lit("u"), F.col("c_nationkey").cast("string"))).alias("code"))
    return Y.guarded_crosswalk(rows.groupBy("name", "code").agg(F.count("*").alias("n")), "name", "code", "n")


_CELLS = ["B.A.", "Bachelor of Arts in Furniture", "MSc in Building", "Automobile", "n/a", "4.0", "Machinery Diploma", "Doctor of Philosophy"]


@query(
    "degree_codes",
    """WITH c AS (SELECT DISTINCT o_orderkey % 8 AS k, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey), v AS (SELECT k, CASE k WHEN 0 THEN 'B.A.' WHEN 1 THEN 'Bachelor of Arts in ' || c_mktsegment WHEN 2 THEN 'MSc in ' || c_mktsegment WHEN 3 THEN c_mktsegment WHEN 4 THEN 'n/a' WHEN 5 THEN '4.0' WHEN 6 THEN c_mktsegment || ' Diploma' ELSE 'Doctor of Philosophy' END AS value, c_mktsegment AS s, 'F.' || c_mktsegment AS f FROM c)
    SELECT DISTINCT value, CASE k WHEN 0 THEN 'bachelor:ba' WHEN 1 THEN 'bachelor:ba' WHEN 2 THEN 'master:ms' WHEN 7 THEN 'doctorate:phd' WHEN 6 THEN 'degree_raw:' || lower(value) WHEN 3 THEN CASE WHEN s = 'MACHINERY' THEN 'degree_raw:machinery' ELSE 'degree_raw:__blank__' END ELSE 'degree_raw:__blank__' END AS canonical_id,
      CASE WHEN k = 0 THEN 'taxonomy_abbrev' WHEN k IN (1, 2, 7) THEN 'taxonomy' WHEN k = 3 AND s <> 'MACHINERY' THEN 'code_from_degree' ELSE 'raw' END AS method, CAST(CASE WHEN k IN (0, 1, 2, 7) THEN 1 WHEN k = 3 AND s <> 'MACHINERY' THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN k IN (1, 2, 3) AND s <> 'MACHINERY' THEN f END AS field_code FROM v""",
)
def degree_codes(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, s = F.col("o_orderkey") % 8, F.col("c_mktsegment")
    forms = [F.lit("B.A."), F.concat(F.lit("Bachelor of Arts in "), s), F.concat(F.lit("MSc in "), s), s, F.lit("n/a"), F.lit("4.0"), F.concat(s, F.lit(" Diploma")), F.lit("Doctor of Philosophy")]
    vocab = o.select(F.coalesce(*(F.when(k == i, x) for i, x in enumerate(forms))).alias("value")).distinct()
    abbreviations = spark.createDataFrame([("ba", "bachelor:ba"), ("phd", "doctorate:phd")], "key string, code string")
    rules = spark.createDataFrame([("degree", i, p, c, "high", False, False) for i, (p, c) in enumerate([("bachelor of arts", "bachelor:ba"), ("bachelor", "bachelor:unspecified"), ("msc", "master:ms"), ("doctor of philosophy", "doctorate:phd")])], RULES)
    fields = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.lower("c_mktsegment").alias("key"), F.concat(F.lit("F."), "c_mktsegment").alias("code")).distinct()
    return Y.degree_codes(vocab, "value", abbreviations, rules, fields, ["n a", "none"])


@query(
    "code_levels",
    """WITH c AS (SELECT DISTINCT 'cip:' || lpad(substr(p_brand, 7), 2, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0') AS code FROM part), n AS (SELECT code, CAST(substr(code, 5, 2) AS INT) AS a, CAST(substr(code, 8, 2) AS INT) AS b, CAST(substr(code, 10, 2) AS INT) AS e FROM c),
    l AS (SELECT code, CASE WHEN a = 12 AND b = 7 AND e BETWEEN 2 AND 4 THEN 1 WHEN a = 12 AND b BETWEEN 5 AND 20 THEN 0 WHEN a BETWEEN 1 AND 8 THEN 1 WHEN a BETWEEN 10 AND 19 THEN 2 WHEN a >= 20 THEN 3 ELSE 0 END AS level, CASE WHEN a = 12 AND b = 7 AND e BETWEEN 2 AND 4 THEN 'back' WHEN a = 12 AND b BETWEEN 5 AND 20 THEN 'Other' WHEN a BETWEEN 1 AND 8 THEN 'core' WHEN a BETWEEN 10 AND 19 THEN 'near' WHEN a >= 20 THEN 'far' ELSE 'Other' END AS grp FROM n)
    SELECT code, level, level = 1 AS within_1, level BETWEEN 1 AND 2 AS within_2, level BETWEEN 1 AND 3 AS within_3, grp FROM l""",
)
def code_levels(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    codes = table(spark, d, "part").select(F.concat(F.lit("cip:"), two(F.substring("p_brand", 7, 2)), F.lit("."), two(F.col("p_size")), two(F.col("p_partkey") % 7)).alias("code"))
    return Y.code_levels(codes, "code", [("01", "08", 1, "core"), ("10", "19", 2, "near"), ("2", None, 3, "far"), ("12.05", "12.20", 0, "Other"), ("12.0702", "12.0704", 1, "back")])


@query(
    "functional_cluster",
    """WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '29-1141' WHEN 1 THEN '55-1011' END AS code, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN p_type || ' ' || p_name || ' co' END AS company, CASE WHEN p_partkey % 5 = 0 THEN 'c1' ELSE ' ' END AS cid, CASE WHEN p_partkey % 3 > 0 THEN lower(p_type) || ', ' || p_name || ' and gear; small plates' END AS d, CASE p_partkey % 7 WHEN 0 THEN 'business_owner' WHEN 1 THEN 'employee' WHEN 2 THEN NULL ELSE 'self_employed' END AS kind FROM part),
    s AS (SELECT *, ' ' || lower(title) || ' ' AS t, ' ' || lower(company) || ' ' AS c, ' ' || trim(regexp_replace(d, '[^a-z]+', ' ', 'g')) || ' ' AS w FROM r), v AS (SELECT *, (w LIKE '% gear %')::INT + (w LIKE '% bolt %')::INT AS n51, (w LIKE '% economy %')::INT + (w LIKE '% ring %')::INT + (w LIKE '% small plates %')::INT AS n27 FROM s),
    x AS (SELECT *, CASE WHEN code LIKE '29%' THEN '29' END AS k1, CASE WHEN title = 'red widget' THEN '13' END AS k2, CASE WHEN t LIKE '% rod %' AND t NOT LIKE '% hot rod %' THEN '47' WHEN t LIKE '% hot rod %' THEN '49' END AS k3, CASE WHEN trim(cid) = '' AND c LIKE '% promo %' THEN '41' END AS k4, CASE WHEN n51 > n27 THEN '51' WHEN n27 > n51 THEN '27' END AS k5, greatest(n51, n27) AS n FROM v)
    SELECT id, coalesce(k1, k2, k3, k4, k5, CASE WHEN coalesce(kind, 'self_employed') = 'employee' THEN 'unspecified' ELSE coalesce(kind, 'self_employed') || '_unspecified' END) AS cluster, CASE WHEN k1 IS NOT NULL THEN 'code' WHEN k2 IS NOT NULL THEN 'qualifier' WHEN k3 IS NOT NULL THEN 'title_keyword' WHEN k4 IS NOT NULL THEN 'company_brand' WHEN k5 IS NOT NULL THEN 'description' ELSE 'unspecified' END AS method,
      CAST(CASE WHEN k1 IS NOT NULL THEN 1 WHEN k2 IS NOT NULL THEN 0.8 WHEN k3 IS NOT NULL THEN 0.7 WHEN k4 IS NOT NULL THEN 0.6 WHEN k5 IS NOT NULL THEN round(least(0.65, 0.45 + 0.05 * n), 2) ELSE 0.5 END AS DOUBLE) AS confidence FROM x""",
)
def functional_cluster(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    rows = p.select(
        k.alias("id"), F.when(k % 6 == 0, "29-1141").when(k % 6 == 1, "55-1011").alias("code"), F.col("p_name").alias("title"), F.when(k % 4 > 0, F.concat("p_type", F.lit(" "), "p_name", F.lit(" co"))).alias("company"), F.when(k % 5 == 0, "c1").otherwise(" ").alias("cid"),
        F.when(k % 3 > 0, F.concat(F.lower("p_type"), F.lit(", "), "p_name", F.lit(" and gear; small plates"))).alias("d"), F.when(k % 7 == 0, "business_owner").when(k % 7 == 1, "employee").when(k % 7 > 2, "self_employed").alias("kind"),
    )
    said = [("title", 1, "rod", "47"), ("title", 0, "hot rod", "49"), ("company", 0, "promo", "41"), ("description", 0, "gear", "51"), ("description", 0, "bolt", "51"), ("description", 0, "economy", "27"), ("description", 0, "ring", "27"), ("description", 0, "small plates", "27")]
    rules = spark.createDataFrame([(a, r, w, c, "", False, False) for a, r, w, c in said], RULES)
    return Y.functional_cluster(rows, "id", "code", "title", "company", "cid", "d", "kind", spark.createDataFrame([("red widget", "13")], "value string, cluster string"), rules)
