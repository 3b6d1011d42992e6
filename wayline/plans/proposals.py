"""Queries of the proposals: vectors as values, parts as roles."""

from pyspark.sql import functions as F

from wayline.operators import proposals as P
from wayline.operators.aggregates import top_value
from wayline.operators.joins import nearest_vectors
from wayline.plans.registry import query, table


def named_vectors(spark, d):
    """Vectors with the name of the part of their number."""
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    return e.join(p, F.col("vec_id") == F.col("p_partkey")).select("vec_id", "embedding", "label", "p_name")


_NAMED = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, p_name FROM embeddings JOIN part ON vec_id = p_partkey), r AS (SELECT vec_id AS rid, label, v, CASE WHEN vec_id % 2 = 0 THEN string_split(p_name, ' ')[-1] ELSE p_name END AS name FROM e WHERE vec_id % 5 = 0)"


@query(
    "nearest_by_words",
    f"WITH {_NAMED} SELECT vec_id AS query, rid AS neighbour, round(list_cosine_similarity(e.v, r.v), 9) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(e.v, r.v), 9) DESC, rid) AS rank FROM e JOIN r ON list_has_all(string_split(lower(e.p_name), ' '), string_split(lower(r.name), ' ')) QUALIFY rank <= 2",
)
def nearest_by_words(spark, d):
    e = named_vectors(spark, d)
    name = F.when(F.col("vec_id") % 2 == 0, F.element_at(F.split("p_name", " "), -1)).otherwise(F.col("p_name"))
    found = P.nearest_by_words(e, e.filter("vec_id % 5 = 0").withColumn("p_name", name), "vec_id", "embedding", "p_name", 2)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "vector_proposals",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT vec_id AS rid, label AS l, v AS rv FROM e WHERE vec_id % 5 = 0), n AS (SELECT vec_id, l, round(list_cosine_similarity(v, rv), 9) AS s FROM e JOIN r ON rid <> vec_id QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, rv), 9) DESC, rid) = 1)
    SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'id:' || label WHEN s >= 0.3 THEN 'id:' || l WHEN vec_id % 4 > 0 THEN 'raw:' || vec_id END AS value, CASE WHEN vec_id % 3 = 0 THEN 'own' WHEN s >= 0.3 THEN 'proposed' WHEN vec_id % 4 > 0 THEN 'rest' END AS source, CASE WHEN vec_id % 3 > 0 AND s >= 0.3 THEN s END AS similarity FROM e LEFT JOIN n USING (vec_id)""",
)
def vector_proposals(spark, d):
    e = table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("id:"), F.col("label").cast("string")))
    reference = e.filter("vec_id % 5 = 0")
    own = F.when(F.col("vec_id") % 3 == 0, F.col("name"))
    rest = F.when(F.col("vec_id") % 4 > 0, F.concat(F.lit("raw:"), F.col("vec_id").cast("string")))
    near = nearest_vectors(e.filter(own.isNull()), reference, "vec_id", "embedding", 1)  # others are never proposed a name
    return P.vector_proposals(e, "vec_id", own, near, reference, "name", 0.3, rest)


@query(
    "hybrid_codes",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT label AS c, list_reverse(v) AS dv FROM e WHERE vec_id IN (SELECT min(vec_id) FROM e GROUP BY label)), a AS (SELECT label AS c, v AS tv FROM e WHERE vec_id % 4 = 0),
    t AS (SELECT e.vec_id, a.c, round(max(list_cosine_similarity(e.v, a.tv)), 9) AS tt FROM e CROSS JOIN a GROUP BY ALL), s AS (SELECT e.vec_id, b.c, round(list_cosine_similarity(list_reverse(e.v), b.dv), 9) AS dt, tt FROM e CROSS JOIN b LEFT JOIN t ON t.vec_id = e.vec_id AND t.c = b.c)
    SELECT vec_id, c AS label, tt AS title_term, dt AS description_term FROM s WHERE vec_id % 7 = 0 OR tt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN vec_id % 7 = 0 THEN dt ELSE round(tt + dt, 9) END DESC, c) = 1""",
)
def hybrid_codes(spark, d):
    e = table(spark, d, "embeddings").withColumn("about", F.reverse("embedding"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    codes = e.join(first, "vec_id").select("label", F.col("about").alias("embedding"))
    return P.hybrid_codes(e, "vec_id", "embedding", "about", e.filter("vec_id % 4 = 0"), codes, "label", "embedding", F.col("vec_id") % 7 == 0, block_rows=100)


@query(
    "crosswalk_bridge",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS t FROM part GROUP BY 1, 2), w AS (SELECT p_brand, p_type, round(n / t, 6) AS share FROM c WHERE CAST(right(p_brand, 1) AS INT) % 2 = 1 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1),
    m AS (SELECT left(p_brand, 7) AS g, p_type AS usual FROM w GROUP BY left(p_brand, 7), p_type QUALIFY row_number() OVER (PARTITION BY left(p_brand, 7) ORDER BY count(*) DESC, p_type) = 1), j AS (SELECT p_partkey, w.p_type AS own, share, usual FROM part p LEFT JOIN w ON w.p_brand = p.p_brand AND p_size >= 20 LEFT JOIN m ON g = CASE WHEN p_size % 5 > 0 THEN left(p.p_brand, 7) END)
    SELECT p_partkey, coalesce(own, usual) AS label, CAST(CASE WHEN own IS NOT NULL THEN share WHEN usual IS NOT NULL THEN 0.3 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN own IS NOT NULL THEN 'code' WHEN usual IS NOT NULL THEN 'major' ELSE 'abstain' END AS source FROM j""",
)
def crosswalk_bridge(spark, d):
    p = table(spark, d, "part").withColumn("major", F.when(F.col("p_size") % 5 > 0, F.left("p_brand", F.lit(7))))
    top = top_value(p.filter(F.right("p_brand", F.lit(1)).cast("int") % 2 == 1), ["p_brand"], "p_type").withColumn("share", F.round(F.col("support") / F.col("total"), 6))
    return P.crosswalk_bridge(p, "p_partkey", "p_brand", "p_size", "major", top, "p_type", "share", F.left("p_brand", F.lit(7)), 20)


@query(
    "family_gate",
    """WITH t AS (SELECT p_partkey, p_type, p_size, string_split(p_name, ' ')[1] AS family, CASE WHEN p_size > 25 THEN 'managerial' ELSE 'staff' END AS stratum FROM part), a AS (SELECT family, p_type AS anchor FROM t WHERE p_partkey % 3 = 0 GROUP BY family, p_type QUALIFY row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, p_type) = 1), j AS (SELECT * FROM t JOIN a USING (family)),
    g AS (SELECT family, stratum, count(*) FILTER (p_partkey % 3 = 1) AS gold_n, round(count(*) FILTER (p_partkey % 3 = 1 AND p_type = anchor) / nullif(count(*) FILTER (p_partkey % 3 = 1), 0), 6) AS gold_precision, round(coalesce(sum(p_size) FILTER (p_partkey % 3 = 1 AND p_type = anchor), 0) / sum(p_size) FILTER (p_partkey % 3 = 1), 6) AS gold_weighted,
      count(*) FILTER (p_partkey % 3 = 2) AS jury_n, round(count(*) FILTER (p_partkey % 3 = 2 AND p_type = anchor) / nullif(count(*) FILTER (p_partkey % 3 = 2), 0), 6) AS jury_precision, round(coalesce(sum(p_size) FILTER (p_partkey % 3 = 2 AND p_type = anchor), 0) / sum(p_size) FILTER (p_partkey % 3 = 2), 6) AS jury_weighted FROM j WHERE p_partkey % 3 > 0 GROUP BY ALL)
    SELECT *, coalesce(gold_n >= 5 AND gold_precision >= 0.15 AND gold_weighted >= 0.15 AND jury_n >= 5 AND jury_precision >= 0.15 AND jury_weighted >= 0.15, FALSE) AND family <> 'hot' AS landable FROM g""",
)
def family_gate(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_type", "p_size", F.element_at(F.split("p_name", " "), 1).alias("family"), F.when(F.col("p_size") > 25, "managerial").otherwise("staff").alias("stratum"))
    anchors = top_value(t.filter("p_partkey % 3 = 0"), ["family"], "p_type").select("family", F.col("p_type").alias("anchor"))
    rows = t.join(anchors, "family")
    populations = {"gold": rows.filter("p_partkey % 3 = 1"), "jury": rows.filter("p_partkey % 3 = 2")}
    return P.family_gate(populations, "family", "stratum", "anchor", "p_type", "p_size", 5, 0.15, ["hot"])
