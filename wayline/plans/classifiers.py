"""Queries of the classifiers."""

from pyspark.sql import functions as F

from wayline.operators import classifiers as C
from wayline.operators.joins import nearest_vectors
from wayline.plans.evaluation import _VOTES, votes
from wayline.plans.graphs import trade_edges
from wayline.plans.registry import query, table

_NN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), nn AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


def neighbours(spark, d, k):
    e = table(spark, d, "embeddings")
    return nearest_vectors(e, e, "vec_id", "embedding", k)


@query(
    "knn_vote",
    f"""WITH {_NN}, v AS (SELECT query, b.label, sum(round(similarity, 6)) AS s FROM nn JOIN e b ON b.vec_id = neighbour WHERE rank <= 5 GROUP BY ALL), r AS (SELECT *, round(round(s, 6) / round(sum(s) OVER (PARTITION BY query), 6), 4) AS share, round(s, 6) / round(sum(s) OVER (PARTITION BY query), 6) AS raw, row_number() OVER (PARTITION BY query ORDER BY s DESC, label) AS rn FROM v) SELECT query, CASE WHEN raw >= 0.4 THEN label END AS predicted, share FROM r WHERE rn = 1""",
)
def knn_vote(spark, d):
    return C.neighbour_vote(neighbours(spark, d, 5), table(spark, d, "embeddings"), "vec_id", "label", 0.4)


@query(
    "loo_knn_sweep",
    f"WITH {_NN}, k AS (SELECT similarity AS s, p.label = g.label AS hit FROM nn JOIN e p ON p.vec_id = neighbour JOIN e g ON g.vec_id = query WHERE rank = 1) SELECT t AS threshold, round(count(*) FILTER (s >= t) / count(*), 6) AS coverage, round(count(*) FILTER (s >= t AND hit) / nullif(count(*) FILTER (s >= t), 0), 6) AS accuracy FROM k CROSS JOIN (VALUES (0.0::DOUBLE), (0.3), (0.35)) v(t) GROUP BY 1",
)
def loo_knn_sweep(spark, d):
    return C.leave_one_out_sweep(neighbours(spark, d, 1), table(spark, d, "embeddings"), "vec_id", "label", [0.0, 0.3, 0.35])


@query("knn_graph", f"WITH {_NN}, b AS (SELECT query AS src, neighbour AS dst, round(similarity, 9) AS s FROM nn WHERE rank <= 3 UNION ALL SELECT neighbour, query, round(similarity, 9) FROM nn WHERE rank <= 3) SELECT src, dst, round(sum(ln(1 + s)), 6) AS weight FROM b GROUP BY ALL")
def knn_graph(spark, d):
    return C.knn_graph(neighbours(spark, d, 3))


@query(
    "vector_clusters",
    """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.6), r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
    SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY 1""",
)
def vector_clusters(spark, d):
    return C.vector_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


@query("ensemble_vote", f"WITH {_VOTES}, c AS (SELECT doc_id, count(*) FILTER (code = '1') AS a, count(*) FILTER (code = '0') AS b FROM v WHERE juror <> 'source' OR code = '1' GROUP BY 1) SELECT doc_id, CASE WHEN a > b THEN '1' WHEN b > a THEN '0' END AS decided, greatest(a, b) AS votes FROM c")
def ensemble_vote(spark, d):
    v = votes(spark, d).withColumn("code", F.when((F.col("juror") != "source") | (F.col("code") == "1"), F.col("code")))
    return C.ensemble_vote(v, "doc_id", "code")


@query(
    "tie_break_rules",
    f"""WITH {_VOTES}, w AS (SELECT *, CASE juror WHEN 'length' THEN 2 ELSE 1 + doc_id % 2 END AS conf FROM v), s AS (SELECT doc_id FROM w GROUP BY 1 HAVING count(DISTINCT code) > 1), b AS (SELECT w.doc_id, max(conf) AS b FROM w JOIN s USING (doc_id) GROUP BY 1), t AS (SELECT w.doc_id, count(DISTINCT code) AS k, min(code) AS c FROM w JOIN b ON w.doc_id = b.doc_id AND conf = b GROUP BY 1)
    SELECT doc_id, CASE WHEN k = 1 THEN c ELSE CAST(quality AS VARCHAR) END AS decided, CASE WHEN k = 1 THEN 'confidence' WHEN quality IS NOT NULL THEN 'anchor' ELSE 'open' END AS rule FROM t LEFT JOIN labels USING (doc_id)""",
)
def tie_break_rules(spark, d):
    v = votes(spark, d).withColumn("conf", F.when(F.col("juror") == "length", 2).otherwise(1 + F.col("doc_id") % 2))
    anchors = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("anchor"))
    return C.tie_break(v, "doc_id", "code", "conf", anchors, "anchor")


@query(
    "head_word_lexicon",
    "WITH c AS (SELECT string_split(lower(p_name), ' ')[-1] AS head, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY head) AS total, row_number() OVER (PARTITION BY head ORDER BY n DESC, p_type) AS rn FROM c) SELECT head, p_type, n AS support, CAST(total AS BIGINT) AS total FROM r WHERE rn = 1 AND n >= 0.18 * total AND total >= 5",
)
def head_word_lexicon(spark, d):
    return C.head_word_lexicon(table(spark, d, "part"), "p_name", "p_type", 0.18, 5)


@query(
    "row_overrides",
    "WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand END AS code, CASE WHEN p_type = 'PROMO' THEN 'Brand#99' WHEN p_retailprice > 1900 THEN 'Xtra' END AS override, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_retailprice > 1900 THEN 'price' END AS reason FROM part) SELECT p_partkey, override, reason FROM p WHERE override IS NOT NULL AND (code IS NULL OR (left(code, 1) = left(override, 1) AND code <> override))",
)
def row_overrides(spark, d):
    p = table(spark, d, "part").withColumn("code", F.when(F.col("p_size") > 5, F.col("p_brand")))
    return C.overrides(p, "p_partkey", "code", [("promo", F.col("p_type") == "PROMO", "Brand#99"), ("price", F.col("p_retailprice") > 1900, "Xtra")])


@query("spectral_embedding")
def spectral_embedding(spark, d):
    return C.spectral_embedding(trade_edges(spark, d).filter(~F.col("is_self_loop")), 4)


@query("mean_vectors", "WITH x AS (SELECT label, embedding::DOUBLE[] AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS m FROM x GROUP BY ALL) SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM m GROUP BY 1")
def mean_vectors(spark, d):
    return C.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")


@query(
    "anchor_offset_errors",
    "WITH a AS (SELECT c_mktsegment, min(year(o_orderdate)) AS truth, min(year(o_orderdate)) FILTER (o_orderpriority = '1-URGENT') AS est FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment), g AS (SELECT c_mktsegment, k AS offset, abs(truth - (est + k)) AS gap FROM a CROSS JOIN (VALUES (-2), (-1), (0)) v(k) WHERE est IS NOT NULL) SELECT c_mktsegment, \"offset\", count(*) AS n, round(avg(CAST(gap <= 1 AS INT)), 6) AS within1, round(avg(CAST(gap <= 2 AS INT)), 6) AS within2, avg(CAST(gap <= 1 AS INT)) >= 2 / 3 AS passes FROM g GROUP BY ALL",
)
def anchor_offset_errors(spark, d):
    from wayline.plans.aggregates import order_customer

    y = F.year("o_orderdate")
    a = order_customer(spark, d).groupBy("o_custkey", "c_mktsegment").agg(F.min(y).alias("truth"), F.min(F.when(F.col("o_orderpriority") == "1-URGENT", y)).alias("est")).filter("est IS NOT NULL")
    return C.offset_errors(a, "truth", "est", [-2, -1, 0], "c_mktsegment")


@query(
    "mutual_information",
    "WITH c AS (SELECT p_type AS a, left(p_name, 3) AS b, count(*) AS n FROM part GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c), m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM j), h AS (SELECT -sum(x / t * ln(x / t)) AS h FROM (SELECT a, sum(n) AS x, (SELECT sum(n) FROM c) AS t FROM c GROUP BY 1)), k AS (SELECT -sum(x / t * ln(x / t)) AS h FROM (SELECT b, sum(n) AS x, (SELECT sum(n) FROM c) AS t FROM c GROUP BY 1)) SELECT round(mi, 6) AS mi, round(2 * mi / (h.h + k.h), 6) AS nmi FROM m, h, k",
)
def mutual_information(spark, d):
    return C.mutual_information(table(spark, d, "part").withColumn("b", F.left("p_name", F.lit(3))), "p_type", "b")


@query(
    "entity_domains",
    "WITH c AS (SELECT o_custkey, p_type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_type) AS rank FROM c) SELECT o_custkey, p_type, n, rank FROM r WHERE rank <= 2",
)
def entity_domains(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return C.top_by_count(lines, "o_custkey", "p_type", 2).withColumn("rank", F.col("rank").cast("long"))
