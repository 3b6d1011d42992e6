"""Queries of the canonicalisers."""

from pyspark.sql import functions as F

from wayline.functions import text as X
from wayline.operators import canon as C
from wayline.plans.registry import query, table


@query(
    "normalize_key",
    r"SELECT value, freq, k AS match_key, array_to_string(list_sort(list_distinct(list_filter(string_split(k, ' '), lambda t: t <> ''))), ' ') AS token_key FROM (SELECT value, freq, trim(regexp_replace(replace(strip_accents(lower(value)), '&', ' and '), '[^a-z0-9+#]+', ' ', 'g')) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS value, count(*) AS freq FROM documents GROUP BY 1))",
)
def normalize_key(spark, d):
    vocab = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).groupBy("value").agg(F.count("*").alias("freq"))
    keyed = X.fold(vocab, "value", "folded").withColumn("match_key", X.match_key(F.col("folded")))
    return keyed.select("value", "freq", "match_key", X.token_key(F.col("match_key")).alias("token_key"))


@query("clean_description", r"SELECT doc_id, length(c) AS n FROM (SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), '') AS c FROM documents)")
def clean_description(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.clean_text(F.col("text"))).cast("long").alias("n"))


_RULES = [("exact", "red blue", "pair", 1.0), ("regex", "^(green|black)", "dark", 0.9), ("tokens", "small white", "small white", 0.8), ("regex", "large|standard", "sized", 0.6)]


@query(
    "rule_ladder",
    """WITH v AS (SELECT p_type || ' ' || p_name AS value, count(*) AS n FROM part GROUP BY 1), l AS (SELECT value, n, lower(value) AS t FROM v)
    SELECT value, n, CASE WHEN t = 'red blue' THEN 'pair' WHEN regexp_matches(t, '^(green|black)') THEN 'dark' WHEN list_has_all(string_split(t, ' '), ['small', 'white']) THEN 'small white' WHEN regexp_matches(t, 'large|standard') THEN 'sized' END AS label,
    CASE WHEN t = 'red blue' THEN 'exact' WHEN regexp_matches(t, '^(green|black)') THEN 'regex' WHEN list_has_all(string_split(t, ' '), ['small', 'white']) THEN 'tokens' WHEN regexp_matches(t, 'large|standard') THEN 'regex' END AS label_method,
    CAST(CASE WHEN t = 'red blue' THEN 1.0 WHEN regexp_matches(t, '^(green|black)') THEN 0.9 WHEN list_has_all(string_split(t, ' '), ['small', 'white']) THEN 0.8 WHEN regexp_matches(t, 'large|standard') THEN 0.6 END AS DOUBLE) AS label_confidence FROM l""",
)
def rule_ladder(spark, d):
    return C.rule_ladder(titles(spark, d), "value", _RULES, "label")


def titles(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws(" ", "p_type", "p_name").alias("value")).agg(F.count("*").alias("n"))


_LEVELS = ["small", "medium", "large", "economy", "promo", "standard"]


@query(
    "title_like_parse",
    """WITH v AS (SELECT DISTINCT p_type || ' ' || p_name AS value FROM part), w AS (SELECT value, list_transform(list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda t: t <> ''), lambda t: CASE WHEN t = 'promo' THEN 'economy' ELSE t END) AS ws FROM v),
    s AS (SELECT value, array_to_string(list_sort(list_distinct(list_filter(ws, lambda t: t IN ('small','medium','large','economy','promo','standard')))), ',') AS levels, array_to_string(list_sort(list_distinct(list_filter(ws, lambda t: t NOT IN ('small','medium','large','economy','promo','standard')))), ' ') AS base FROM w)
    SELECT value, levels, base, 'title:' || levels || '|' || base AS canonical FROM s""",
)
def title_like_parse(spark, d):
    return C.parse_title(titles(spark, d).select("value"), "value", _LEVELS, {"promo": "economy"})


@query("max_rank_token", "SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 END) AS rank FROM orders GROUP BY 1")
def max_rank_token(spark, d):
    joined = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_set("o_orderpriority"), ",").alias("tokens"))
    return joined.select("o_custkey", C.max_rank(F.col("tokens"), {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}).alias("rank"))


@query(
    "lexicon_ladder",
    """WITH v AS (SELECT p_type || ' ' || p_name AS value, p_name AS base FROM part GROUP BY ALL), lex AS (SELECT p_type || ' ' || p_name AS title, p_name, p_brand AS code FROM part WHERE p_size > 47),
    a AS (SELECT lower(title) AS k, min(code) AS c FROM lex GROUP BY 1 HAVING count(DISTINCT code) = 1), b AS (SELECT lower(p_name) AS k, min(code) AS c FROM lex GROUP BY 1 HAVING count(DISTINCT code) = 1)
    SELECT value, base, coalesce(a.c, b.c) AS code, CASE WHEN a.c IS NOT NULL THEN 'norm' WHEN b.c IS NOT NULL THEN 'base' END AS method FROM v LEFT JOIN a ON lower(value) = a.k LEFT JOIN b ON lower(base) = b.k""",
)
def lexicon_ladder(spark, d):
    p = table(spark, d, "part").withColumn("title", F.concat_ws(" ", "p_type", "p_name"))
    vocab = p.select(F.col("title").alias("value"), F.col("p_name").alias("base")).distinct()
    lexicon = p.filter("p_size > 47").withColumnRenamed("p_brand", "code")
    return C.lexicon_ladder(vocab, "value", lexicon, "code", [("norm", F.lower("value"), F.lower("title")), ("base", F.lower("base"), F.lower("p_name"))])


@query("typo_clusters")
def typo_clusters(spark, d):
    vocab = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).filter("length(value) > 4")
    return C.typo_clusters(vocab.groupBy("value").agg(F.count("*").alias("n")), "value", "n", 1)


_PLACES = """p AS (SELECT CASE c_custkey % 12 WHEN 0 THEN n_name || ', Texas,  United States' WHEN 1 THEN n_name || ', OH' WHEN 2 THEN 'Ohio, United States' WHEN 3 THEN n_name || ', Ontario, Canada' WHEN 4 THEN 'Greater Dallas Area' WHEN 5 THEN 'Austin' WHEN 6 THEN 'Texas' WHEN 7 THEN ' India ' WHEN 8 THEN 'Remote' WHEN 9 THEN n_name WHEN 10 THEN n_name || ', Texas, Canada' WHEN 11 THEN ' ' END AS value, c_custkey % 12 AS k, lower(n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "location_parse",
    f"""WITH {_PLACES} SELECT DISTINCT value, CASE WHEN k IN (0, 1, 2, 4, 5, 6) THEN 'US' WHEN k = 3 THEN 'CA' WHEN k = 7 THEN 'IN' END AS country, CASE WHEN k IN (0, 4, 5, 6) THEN 'TX' WHEN k IN (1, 2) THEN 'OH' END AS state, CASE WHEN k IN (0, 1, 3) THEN n WHEN k = 4 THEN 'dallas' WHEN k = 5 THEN 'austin' END AS city,
    CASE k WHEN 0 THEN 'city_state_country' WHEN 1 THEN 'city_state' WHEN 2 THEN 'state_country' WHEN 3 THEN 'city_country' WHEN 4 THEN 'metro' WHEN 5 THEN 'city_alias' WHEN 6 THEN 'state' WHEN 7 THEN 'country' WHEN 8 THEN 'remote' WHEN 11 THEN 'empty' ELSE 'unparsed' END AS location_method, CAST(CASE WHEN k = 4 THEN 0.95 WHEN k = 5 THEN 0.9 WHEN k IN (9, 10, 11) THEN 0 ELSE 1 END AS DOUBLE) AS location_confidence FROM p""",
)
def location_parse(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    forms = ["{}, Texas,  United States", "{}, OH", "Ohio, United States", "{}, Ontario, Canada", "Greater Dallas Area", "Austin", "Texas", " India ", "Remote", "{}", "{}, Texas, Canada", " "]
    written = F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % 12 + 1).cast("int"))
    vocab = rows.select(F.replace(written, F.lit("{}"), F.col("n_name")).alias("value")).distinct()
    gazetteers = {"united states": "US", "canada": "CA", "india": "IN"}, {"texas": "TX", "ohio": "OH"}
    return vocab.withColumns(C.parse_location(F.col("value"), *gazetteers, "US", {"dallas": ("dallas", "TX")}, {"austin": ("austin", "TX")}, ["remote", "anywhere"]))


@query("compound_split", "WITH v AS (SELECT DISTINCT p_type, p_name FROM part) SELECT p_type || ' and ' || p_name || '; minor in ' || p_type AS value, 2 AS majors, 1 AS minors, lower(p_type) AS first_part FROM v")
def compound_split(spark, d):
    v = table(spark, d, "part").select("p_type", "p_name").distinct().select(F.concat("p_type", F.lit(" and "), "p_name", F.lit("; minor in "), "p_type").alias("value"))
    count = lambda role: F.size(F.filter("parts", lambda x: x["role"] == role))
    return C.split_compound(v, "value").select("value", count("major").alias("majors"), count("minor").alias("minors"), F.lower(F.col("parts")[0]["text"]).alias("first_part"))


@query(
    "functional_vote",
    """WITH t AS (SELECT doc_id, string_split(lower(text), ' ') AS t FROM documents), h AS (SELECT doc_id, len(list_filter(t, lambda x: x IN ('the', 'and'))) AS en, len(list_filter(t, lambda x: x IN ('der', 'und'))) AS de, len(list_filter(t, lambda x: x IN ('les', 'une'))) AS fr FROM t),
    v AS (SELECT doc_id, unnest([{'c': 'de', 'n': de}, {'c': 'en', 'n': en}, {'c': 'fr', 'n': fr}]) AS v FROM h), r AS (SELECT doc_id, v.c AS c, v.n AS n, row_number() OVER w AS rn, lead(v.n) OVER w AS nx FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY v.n DESC, v.c))
    SELECT doc_id, CASE WHEN n > 0 AND n - coalesce(nx, 0) >= 2 THEN c ELSE 'unresolved' END AS cluster, n AS hits FROM r WHERE rn = 1""",
)
def functional_vote(spark, d):
    return C.functional_vote(table(spark, d, "documents"), "doc_id", "text", {"en": ["the", "and"], "de": ["der", "und"], "fr": ["les", "une"]}, 2)


@query(
    "evidence_vocabulary",
    """WITH b AS (SELECT o_custkey, p_brand, p_type, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), g AS (SELECT p_brand, count(*) AS n_rows, count(DISTINCT o_custkey) AS persons FROM b GROUP BY 1),
    m AS (SELECT p_brand, p_type AS modal_name FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM b GROUP BY p_brand, p_type) WHERE rn = 1),
    t AS (SELECT p_brand, list(p_name ORDER BY rn) AS texts FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS rn FROM b GROUP BY p_brand, p_name) WHERE rn <= 3 GROUP BY 1) SELECT * FROM g JOIN m USING (p_brand) JOIN t USING (p_brand)""",
)
def evidence_vocabulary(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return C.evidence(rows.select("o_custkey", "p_brand", "p_type", "p_name"), "p_brand", "o_custkey", "p_type", "p_name", 3)


@query("head_component", r"SELECT page_id, trim(regexp_split_to_array(lower(url), '[,;/(]| - ')[1]) AS head FROM pages")
def head_component(spark, d):
    return table(spark, d, "pages").select("page_id", C.head_component(F.col("url")).alias("head"))


@query(
    "rating_matrix",
    """WITH c AS (SELECT p_type, p_brand, avg(p_retailprice) AS r FROM part GROUP BY ALL), z AS (SELECT p_type, p_brand, (r - avg(r) OVER (PARTITION BY p_brand)) / stddev_pop(r) OVER (PARTITION BY p_brand) AS z FROM c), l AS (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY p_type)) AS len FROM z)
    SELECT p_type, list(round(z / len, 6) ORDER BY p_brand) AS vector FROM l GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT p_brand) FROM part)""",
)
def rating_matrix(spark, d):
    return C.rating_matrix(table(spark, d, "part"), "p_type", "p_brand", "p_retailprice")


@query(
    "code_status",
    "WITH r AS (SELECT p_brand, left(p_brand, 7) AS family, p_size % 6 AS zone, p_type = 'ECONOMY' AS is_base, p_partkey FROM part), b AS (SELECT family, arg_min(zone, p_partkey) AS z FROM r WHERE is_base GROUP BY 1), m AS (SELECT family, zone FROM (SELECT family, zone, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, zone) AS rn FROM r GROUP BY family, zone) WHERE rn = 1) SELECT m.family, coalesce(b.z, m.zone) AS zone, CASE WHEN b.z IS NULL THEN 'mode' ELSE 'base' END AS zone_source FROM m LEFT JOIN b USING (family)",
)
def code_status(spark, d):
    from wayline.operators.aggregates import top_value

    r = table(spark, d, "part").select(F.left("p_brand", F.lit(7)).alias("family"), (F.col("p_size") % 6).alias("zone"), (F.col("p_type") == "ECONOMY").alias("is_base"), "p_partkey")
    base = r.groupBy("family").agg(F.min_by("zone", F.when(F.col("is_base"), F.col("p_partkey"))).alias("z"))
    mode = top_value(r, ["family"], "zone").select("family", "zone")
    return mode.join(base, "family", "left").select("family", F.coalesce("z", "zone").alias("zone"), F.when(F.col("z").isNull(), "mode").otherwise("base").alias("zone_source"))


@query("truncated_codes", "WITH c AS (SELECT r_name || '.' || n_name AS code FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT code, split_part(code, '.', 1) AS l1, code AS l2, CAST(NULL AS VARCHAR) AS l3 FROM c")
def truncated_codes(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("."), "n_name").alias("code"))
    return n.select("code", *(X.truncate_code(F.col("code"), k).alias(f"l{k}") for k in (1, 2, 3)))


@query(
    "backfilled_ratings",
    """WITH o AS (SELECT p_brand, p_type, avg(p_retailprice) AS r FROM part WHERE right(p_brand, 1) <> '3' GROUP BY 1, 2), b AS (SELECT DISTINCT p_brand, left(p_brand, 7) AS parent FROM part), m AS (SELECT parent, p_type, avg(r) AS r FROM o JOIN b USING (p_brand) GROUP BY 1, 2)
    SELECT p_brand, p_type, round(r, 6) AS rating, 'own' AS source FROM o UNION ALL SELECT p_brand, p_type, round(r, 6), 'crosswalk' FROM b JOIN m USING (parent) WHERE p_brand NOT IN (SELECT p_brand FROM o)""",
)
def backfilled_ratings(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type", F.col("p_retailprice").alias("rating"))
    crosswalk = p.select("p_brand", F.left("p_brand", F.lit(7)).alias("parent")).distinct()
    found = C.backfilled_ratings(p.filter(F.right("p_brand", F.lit(1)) != "3"), "p_brand", "p_type", "rating", crosswalk)
    return found.withColumn("rating", F.round("rating", 6))
