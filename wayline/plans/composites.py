"""Queries of the composite operators and of the sources and sinks that go through files."""

from pyspark.sql import functions as F

from wayline.operators import composites as K
from wayline.operators import projections
from wayline.operators.aggregates import top_value
from wayline.operators.joins import nearest_vectors
from wayline.plans.evaluation import _VOTES, votes
from wayline.plans.flatten import SPEC, raw
from wayline.plans.joins import _STEP, steps
from wayline.plans.registry import query, table
from wayline.sources import records, sinks
from wayline.sources.scratch import scratch


@query(
    "company_ladder",
    """WITH cw AS (SELECT lower(p_name) AS match, min(p_brand) AS id FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1), t AS (SELECT p_partkey, lower(trim(p_name)) AS x, CASE WHEN p_partkey % 10 = 0 THEN p_partkey END AS own, id FROM part LEFT JOIN cw ON lower(trim(p_name)) = match),
    m AS (SELECT *, CASE WHEN regexp_matches(x, '^red') THEN 'placeholder' WHEN own IS NOT NULL THEN 'id' WHEN id IS NOT NULL THEN 'crosswalk' ELSE 'raw' END AS company_method FROM t)
    SELECT p_partkey, CASE company_method WHEN 'placeholder' THEN 'nonorg:self' WHEN 'id' THEN 'id:' || own WHEN 'crosswalk' THEN 'id:' || id ELSE 'raw:' || x END AS company, company_method, CAST(CASE company_method WHEN 'placeholder' THEN 1 WHEN 'id' THEN 1 WHEN 'crosswalk' THEN 0.97 ELSE 0.5 END AS DOUBLE) AS company_confidence FROM m""",
)
def company_ladder(spark, d):
    p = table(spark, d, "part")
    crosswalk = p.filter("p_size > 40").select(F.lower("p_name").alias("match"), F.col("p_brand").alias("id"))
    rows = p.select("p_partkey", "p_name", F.when(F.col("p_partkey") % 10 == 0, F.col("p_partkey")).alias("own"))
    return K.company_ladder(rows, "p_name", "own", {"^red": "self"}, crosswalk).select("p_partkey", "company", "company_method", "company_confidence")


@query(
    "rescue_levels",
    """WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS level FROM part), c AS (SELECT p_name, level, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_name) AS t FROM t WHERE level IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT p_name, level, n, t, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, level) AS rn FROM c), ok AS (SELECT p_name, level AS r FROM top WHERE rn = 1 AND t >= 3 AND n >= 0.4 * t)
    SELECT p_partkey, coalesce(level, r) AS level, CASE WHEN level IS NOT NULL THEN 'own' WHEN r IS NOT NULL THEN 'rescued' END AS level_source FROM t LEFT JOIN ok USING (p_name)""",
)
def rescue_levels(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("level"))
    return K.rescue_levels(p, "level", "p_name", 3, 0.4).select("p_partkey", "level", "level_source")


@query(
    "classify_industry",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_nationkey) AS t FROM customer GROUP BY 1, 2), pr AS (SELECT c_nationkey AS n_nationkey, left(c_mktsegment, 1) || '.' || c_mktsegment AS prior_code, n / t AS ps FROM c WHERE c_nationkey % 7 > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1),
    j AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'A.' || n_regionkey END AS cc, CASE WHEN regexp_matches(n_name, '1$') THEN 'B.LND.X' WHEN regexp_matches(n_name, '_2') THEN 'M.INI' WHEN n_nationkey % 5 = 3 THEN 'F' END AS rc, n_nationkey % 5 = 3 AND NOT regexp_matches(n_name, '1$|_2') AS many, prior_code AS pc, ps FROM nation LEFT JOIN pr USING (n_nationkey)),
    s AS (SELECT *, coalesce(cc, rc, pc, 'XOT') AS code, CASE WHEN cc IS NOT NULL THEN 'curated' WHEN rc IS NOT NULL THEN 'name_rule' WHEN pc IS NOT NULL THEN 'occupation_prior' ELSE 'unresolved' END AS source FROM j), q AS (SELECT *, split_part(code, '.', 1) = split_part(pc, '.', 1) AS agrees, len(string_split(code, '.')) AS depth FROM s),
    r AS (SELECT *, round(CAST(least(1.0, CASE source WHEN 'curated' THEN 1 WHEN 'name_rule' THEN CASE WHEN many THEN 0.9 ELSE 0.82 END WHEN 'occupation_prior' THEN ps ELSE 0 END + CASE WHEN source IN ('curated', 'name_rule') AND agrees THEN 0.05 ELSE 0 END) AS DOUBLE), 3) AS confidence FROM q)
    SELECT n_nationkey, code, CAST(depth AS INT) AS depth, source, confidence, [confidence FOR i IN range(depth)] AS per_level, CASE source WHEN 'curated' THEN FALSE WHEN 'name_rule' THEN coalesce(NOT agrees, FALSE) ELSE TRUE END AS review FROM r""",
)
def classify_industry(spark, d):
    n = table(spark, d, "nation")
    named = n.withColumn("n_name", F.concat("n_name", F.when(F.col("n_nationkey") % 5 == 3, " trading house").otherwise("")))
    curated = n.filter("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("A."), F.col("n_regionkey").cast("string")).alias("curated_code"))
    top = top_value(table(spark, d, "customer").filter("c_nationkey % 7 > 0"), ["c_nationkey"], "c_mktsegment")
    prior = top.select(F.col("c_nationkey").alias("n_nationkey"), F.concat(F.left("c_mktsegment", F.lit(1)), F.lit("."), "c_mktsegment").alias("prior_code"), (F.col("support") / F.col("total")).alias("prior_confidence"))
    return K.classify_industry(named, "n_nationkey", "n_name", curated, [("1(?: |$)", "B.LND.X"), ("_2", "M.INI"), ("trading house", "F")], prior)


@query(
    "cohort_profile",
    f"""WITH t AS {_STEP}, m AS (SELECT year(o_orderdate) AS entry_year, round(avg(o_totalprice), 4) AS macro FROM orders GROUP BY 1), f AS (SELECT o_custkey, year(s) AS entry_year, o_orderpriority AS entry_value FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s, e, o_orderkey) = 1),
    n AS (SELECT o_custkey, max(year(e)) AS last_year, count(*) AS n_steps, coalesce(bool_or(e >= DATE '2001-01-01'), FALSE) AS right_censored FROM t GROUP BY 1), g AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 3 > 0 THEN 1940 + c_custkey % 70 END AS a, CASE WHEN c_custkey % 4 > 0 THEN 1990 END AS b FROM customer)
    SELECT o_custkey, entry_year, last_year, n_steps, entry_value, right_censored, last_year - entry_year AS years_seen, entry_year - 22 AS birth_year_proxy, CASE WHEN entry_year - 22 BETWEEN 1946 AND 1964 THEN 'Boomer' WHEN entry_year - 22 BETWEEN 1965 AND 1980 THEN 'Gen X' WHEN entry_year - 22 BETWEEN 1981 AND 1996 THEN 'Millennial' END AS generation, entry_year BETWEEN 1995 AND 1998 AS valid_cohort,
      CAST(floor(entry_year / 5) * 5 AS INT) AS cohort, CAST(coalesce(CASE WHEN a BETWEEN 1950 AND 2000 THEN a END, CASE WHEN b BETWEEN 1950 AND 2000 THEN b END) AS INT) AS graduation_year, macro FROM f JOIN n USING (o_custkey) LEFT JOIN m USING (entry_year) LEFT JOIN g USING (o_custkey)""",
)
def cohort_profile(spark, d):
    macro = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("macro"))
    key = F.col("c_custkey")
    anchors = table(spark, d, "customer").select(key.alias("o_custkey"), F.when(key % 3 > 0, 1940 + key % 70).alias("a"), F.when(key % 4 > 0, 1990).alias("b"))
    return K.cohort_profile(steps(spark, d), "o_custkey", ["s", "e", "o_orderkey"], F.col("o_orderpriority"), macro, "y", 2001, (1995, 1998), anchors=anchors)


@query(
    "role_features",
    """WITH l AS (SELECT p.*, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN p_brand END AS code FROM lineitem JOIN part p ON l_partkey = p_partkey), b AS (SELECT p_type, code, count(*) AS n FROM l WHERE code IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, code) = 1), x AS (SELECT p_type, p_name, count(*) AS n FROM l GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name) = 1), s AS (SELECT p_type, count(*) AS steps, count(DISTINCT l_suppkey) AS persons, count(code) AS coded_steps, avg(CAST(p_size > 25 AS INT)) AS o, avg(p_size) AS m FROM l GROUP BY 1)
    SELECT p_type, steps, persons, coded_steps, round(o, 6) AS owner_share, round(m, 6) AS mean_seniority, code, coalesce(b.n, 0) AS code_support, p_name AS usual_text, round(coalesce(b.n, 0) / nullif(coded_steps, 0), 6) AS code_share FROM s LEFT JOIN b USING (p_type) LEFT JOIN x USING (p_type)""",
)
def role_features(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("code", F.when(F.col("l_linenumber") % 3 == 0, F.col("p_brand")))  # noqa: E741
    return K.role_features(l, "p_type", "l_suppkey", "code", F.col("p_size") > 25, F.col("p_size"), "p_name")


@query(
    "assign_archetypes",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT min(vec_id) AS vec_id FROM e GROUP BY label), q AS (SELECT e.* FROM e JOIN p USING (vec_id)), s AS (SELECT a.vec_id, q.label, round(list_cosine_similarity(a.v, q.v), 9) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, q.v), 9) DESC, q.vec_id) AS rn FROM e a CROSS JOIN q),
    n AS (SELECT vec_id, max(label) FILTER (rn = 1) AS near, max(c) FILTER (rn = 1) AS s1, max(c) FILTER (rn = 2) AS s2 FROM s GROUP BY 1), r AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 AND vec_id % 30 >= 10 AND vec_id % 30 >= 0.05 * vec_id THEN CAST(label AS VARCHAR) END AS rule, vec_id % 9 >= 5 AND s1 >= 0.45 AND s1 - coalesce(s2, -1) >= 0.05 AS led, near, s1 FROM e JOIN n USING (vec_id))
    SELECT vec_id, coalesce(rule, CASE WHEN led THEN CAST(near AS VARCHAR) END, 'other') AS archetype, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN led THEN 'embed' ELSE 'residual_other' END AS archetype_source, CASE WHEN rule IS NULL AND led THEN round(s1, 3) END AS cosine FROM r""",
)
def assign_archetypes(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    prototypes = e.join(first, "vec_id").withColumn("archetype", F.col("label"))
    near = nearest_vectors(e, prototypes, "vec_id", "embedding", 2, keep_self=True)
    code = K.trusted_code(F.col("label"), F.col("vec_id") % 30, F.col("vec_id"))
    return K.assign_archetypes(e, "vec_id", F.when(F.col("vec_id") % 3 == 0, code), F.col("vec_id") % 9, near, prototypes, "other")


_JURY = f"""{_VOTES}, w AS (SELECT doc_id, juror, CASE WHEN juror = 'source' AND doc_id % 5 = 0 THEN 'unsure' ELSE code END AS code FROM v WHERE NOT (juror = 'length' AND doc_id % 7 = 0)),
    o AS (SELECT doc_id, CASE WHEN count(*) < 3 THEN 'incomplete' WHEN count(*) FILTER (code = 'unsure') > 0 THEN 'abstained' WHEN min(code) = max(code) THEN 'accepted' ELSE 'disagree' END AS outcome, min(code) AS code FROM w GROUP BY 1)"""


def _jury(spark, d):
    v = votes(spark, d).filter("not (juror = 'length' and doc_id % 7 = 0)")
    return v.withColumn("code", F.when((F.col("juror") == "source") & (F.col("doc_id") % 5 == 0), "unsure").otherwise(F.col("code")))


@query("vote_outcomes", f"WITH {_JURY} SELECT doc_id, outcome, CASE WHEN outcome = 'accepted' THEN code END AS code FROM o")
def vote_outcomes(spark, d):
    return K.vote_outcomes(_jury(spark, d), "doc_id", "juror", "code", ["length", "language", "source"], ["unsure"])


@query(
    "accepted_votes",
    f"WITH {_JURY} SELECT doc_id, code, 3 AS n_jurors FROM o JOIN documents USING (doc_id) WHERE outcome = 'accepted' AND lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def accepted_votes(spark, d):
    population = table(spark, d, "documents").filter("lang = 'en'")
    known = table(spark, d, "labels").filter("quality = 1")
    return K.accepted_votes(_jury(spark, d), "doc_id", "juror", "code", ["length", "language", "source"], ["unsure"], population, known)


_MARKED = "m AS (SELECT doc_id, lang, source, quality, n_chars, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS mark, CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars > 500 AS INT) END AS predicted FROM documents JOIN labels USING (doc_id))"


def marked(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    mark = F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "yes").otherwise("no")
    return j.withColumns({"mark": mark, "predicted": F.when(F.col("doc_id") % 5 > 0, (F.col("n_chars") > 500).cast("int"))})


@query("label_precision", f"WITH {_MARKED} SELECT lang, count(*) AS n, round(count(*) FILTER (mark = 'yes') / count(*), 6) AS strict, round(count(*) FILTER (mark = 'yes') / nullif(count(*) FILTER (mark <> 'unsure'), 0), 6) AS lenient FROM m GROUP BY 1")
def label_precision(spark, d):
    return K.label_precision(marked(spark, d), "lang", "mark", "yes", "unsure")


@query(
    "tier_scores",
    f"WITH {_MARKED}, t AS (SELECT source, count(*) AS n, count(predicted) AS m, count(*) FILTER (predicted = quality) AS r, sum(n_chars) AS wn, coalesce(sum(n_chars) FILTER (predicted IS NOT NULL), 0) AS wm, coalesce(sum(n_chars) FILTER (predicted = quality), 0) AS wr FROM m WHERE quality IS NOT NULL GROUP BY 1) SELECT source, n, round(m / n, 6) AS coverage, round(r / nullif(m, 0), 6) AS precision, round(r / n, 6) AS recall, round(wr / nullif(wm, 0), 6) AS weighted_precision, round(wr / nullif(wn, 0), 6) AS weighted_recall FROM t",
)
def tier_scores(spark, d):
    return K.tier_scores(marked(spark, d), "source", "quality", "predicted", F.col("n_chars"))


@query(
    "approach_comparison",
    """WITH t AS (SELECT p_partkey, p_type AS ref, lower(p_type) AS folded, CASE WHEN p_size > 25 THEN p_type END AS large, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS mixed FROM part), l AS (SELECT p_partkey, ref, 'folded' AS method, folded AS got FROM t UNION ALL SELECT p_partkey, ref, 'large', large FROM t UNION ALL SELECT p_partkey, ref, 'mixed', mixed FROM t),
    s AS (SELECT method, count(DISTINCT got) / count(DISTINCT p_partkey) AS reduction, count(*) AS k, count(got) AS m, count(*) FILTER (got = ref) AS r FROM l GROUP BY 1) SELECT method, round(reduction, 6) AS reduction, round(m / k, 6) AS coverage, round(r / nullif(m, 0), 6) AS precision, round(r / k, 6) AS recall, round(2 * (r / nullif(m, 0)) * (r / k) / nullif(r / nullif(m, 0) + r / k, 0), 6) AS f1 FROM s""",
)
def approach_comparison(spark, d):
    p = table(spark, d, "part")
    t = p.select("p_partkey", F.col("p_type").alias("ref"), F.lower("p_type").alias("folded"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("large"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("mixed"))
    return K.approach_comparison(t, "p_partkey", ["folded", "large", "mixed"], "ref")


@query(
    "pair_separation",
    """WITH c AS (SELECT round(l_discount, 9) AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1), u AS (SELECT *, sum(q) OVER (ORDER BY s) AS upto FROM c)
    SELECT CAST(sum(p) AS BIGINT) AS merge_pairs, CAST(sum(q) AS BIGINT) AS keep_pairs, round(sum(p * (upto - q / 2)) / (sum(p) * sum(q)), 6) AS auc, round(sum(s * p) / sum(p), 6) AS merge_mean, round(sum(s * q) / sum(q), 6) AS keep_mean FROM u""",
)
def pair_separation(spark, d):
    return K.pair_separation(table(spark, d, "lineitem"), "l_discount", F.col("l_returnflag") == "R")


@query("backbone_unchanged", "SELECT count(*) AS rows_before, count(*) AS rows_after, TRUE AS unchanged FROM orders")
def backbone_unchanged(spark, d):
    before = table(spark, d, "orders")
    usual = top_value(before, ["o_custkey"], "o_orderpriority").select("o_custkey", F.col("o_orderpriority").alias("usual"))
    return K.unchanged(before, before.join(usual, "o_custkey", "left"))


@query("snapshot_drift", "WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS r FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT o_orderpriority, r AS recorded, n AS now, coalesce(n, 0) - coalesce(r, 0) AS delta FROM a FULL JOIN b USING (o_orderpriority)")
def snapshot_drift(spark, d):
    o = table(spark, d, "orders")
    recorded = o.filter("o_orderkey % 2 = 0 and o_orderpriority <> '5-LOW'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return K.drift(o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), recorded, "o_orderpriority", "n")


@query("seeded_kmeans")
def seeded_kmeans(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return K.seeded_kmeans(e, "vec_id", "embedding", e.join(first.select("vec_id"), "vec_id"), "label")


@query(
    "employment_type",
    "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^green') THEN 'retired' WHEN regexp_matches(lower(p_type), 'small') THEN 'self_employed' WHEN regexp_matches(lower(p_name), 'blue$') THEN 'student' ELSE 'employee' END AS employment, CASE WHEN regexp_matches(lower(p_name), '^green') THEN 'title' WHEN regexp_matches(lower(p_type), 'small') THEN 'company' WHEN regexp_matches(lower(p_name), 'blue$') THEN 'title' ELSE 'default' END AS side FROM part",
)
def employment_type(spark, d):
    rules = [("title", "^green", "retired"), ("company", "small", "self_employed"), ("title", "blue$", "student")]
    kind, side = K.employment_type(F.col("p_name"), F.col("p_type"), rules, "employee")
    return table(spark, d, "part").select("p_partkey", kind.alias("employment"), side.alias("side"))


@query("slim_extract", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity >= 10")
def slim_extract(spark, d):
    return projections.slim(table(spark, d, "lineitem"), F.col("l_shipdate").isNotNull() & (F.col("l_quantity") >= 10), {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "shipped": F.col("l_shipdate").cast("date")})


@query("read_lines", "SELECT count(*) AS lines, count(*) FILTER (o_orderkey % 50 IN (1, 2)) AS bad, TRUE AS numbered FROM orders WHERE o_orderkey % 50 <> 3")
def read_lines(spark, d):
    """Lines written to files with a sidecar beside them, read back with their file and row."""
    path = scratch(spark, "lines")
    raw(spark, d).write.text(path)
    table(spark, d, "region").select("r_name").write.mode("append").option("compression", "gzip").text(path)
    found = records.read_lines(spark, path, SPEC, glob="part-*.txt")
    per = found.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), (F.count_distinct("source_row") == F.max("source_row")).alias("ok"))
    return per.agg(F.sum("n").alias("lines"), F.sum("b").alias("bad"), F.bool_and("ok").alias("numbered"))


@query("read_delimited", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 > 0")
def read_delimited(spark, d):
    """Tab-separated text with a header line, a name in quotes, and lines that do not fit."""
    path = scratch(spark, "delimited")
    key = F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise(F.col("n_nationkey").cast("string"))
    lines = table(spark, d, "nation").select(F.concat_ws("\t", key, F.concat(F.lit('"'), "n_name")).alias("value"))
    lines.write.text(path)
    read = records.read_delimited(spark, path, "n_nationkey int, name string", header=False)
    return read.select("n_nationkey", F.substring("name", 2, 99).alias("n_name"))


@query("replaced_table", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def replaced_table(spark, d):
    """A table written, replaced as a whole, and read."""
    path, o = scratch(spark, "replaced"), table(spark, d, "orders")
    for rows in (o, o.filter("o_orderstatus = 'F'")):
        sinks.replace_table(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("run_manifest", "SELECT 'nation' AS step, count(*) AS rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def run_manifest(spark, d):
    """The rows that two steps wrote, counted on the way and read from their manifest."""
    entries = [{"step": name, **sinks.replace_table(table(spark, d, name), scratch(spark, name))} for name in ("nation", "supplier")]
    path = scratch(spark, "manifest")
    sinks.write_manifest(table(spark, d, "nation"), entries, path)
    return spark.read.schema("step string, rows long").json(path)


@query("tidy_export", "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL")
def tidy_export(spark, d):
    """A long-form cube written as delimited text with a header, and read."""
    path = scratch(spark, "tidy")
    cube = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    sinks.tidy_csv(cube, path)
    return spark.read.csv(path, header=True, schema="segment string, nation int, n long")
