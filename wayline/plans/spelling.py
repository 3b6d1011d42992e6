"""Queries of the operators for names that differ by typing errors, and of employers at value and row grain."""

from pyspark.sql import functions as F

from wayline.operators import company as N
from wayline.operators import spelling as S
from wayline.plans.registry import query, table

_FORMS = """r AS (SELECT l_orderkey, l_linenumber AS k, lower(p_name || ' ' || p_type) AS b, lower(p_name) AS nm, lower(p_type) AS ty, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT l_orderkey, k, array_to_string(list_sort(string_split(b, ' ')), ' ') AS g, CASE k WHEN 1 THEN upper(b) WHEN 2 THEN ty || ' ' || nm WHEN 3 THEN nm || ' ' || left(ty, 3) || substr(ty, 3) WHEN 4 THEN b WHEN 5 THEN replace(b, ' ', '-') WHEN 6 THEN '--' ELSE 'Freelance' END AS name,
      CASE WHEN k = 4 AND ty IN ('economy', 'standard', 'small') AND p_size <= 40 THEN 'co_' || replace(b, ' ', '_') END AS own FROM r)"""
_VALUES = f"""{_FORMS}, q AS (SELECT name AS value, min(g) AS g, count(*) AS freq, count(own) AS id_rows, min(own) AS id FROM f GROUP BY 1),
    m AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS norm, CASE WHEN id_rows >= 3 AND id_rows >= 0.5 * freq THEN id END AS modal FROM q),
    w AS (SELECT norm, arg_min(modal, (-freq, value)) AS twin FROM m WHERE modal IS NOT NULL GROUP BY 1),
    o AS (SELECT m.*, CASE WHEN norm = '' THEN 'nonorg:none' WHEN norm = 'freelance' THEN 'nonorg:self' WHEN coalesce(modal, twin) IS NOT NULL THEN 'id:' || coalesce(modal, twin) ELSE 'raw:' || norm END AS company,
      CASE WHEN norm IN ('', 'freelance') THEN 'placeholder' WHEN modal IS NOT NULL THEN 'company_id' WHEN twin IS NOT NULL THEN 'name_crosswalk' ELSE 'raw' END AS method FROM m LEFT JOIN w USING (norm)),
    c AS (SELECT g, arg_min(value, (-freq, value)) AS rep FROM o WHERE method <> 'placeholder' GROUP BY 1),
    t AS (SELECT o.value, o.company AS own_company, o.method AS own_method, o.method = 'raw' AND o.value <> c.rep AS typo, r.company AS rc, r.norm AS rn FROM o LEFT JOIN c USING (g) LEFT JOIN o AS r ON r.value = c.rep),
    v AS (SELECT value, CASE WHEN typo AND starts_with(rc, 'id:') THEN rc WHEN typo THEN 'raw:' || rn ELSE own_company END AS company, CASE WHEN typo AND starts_with(rc, 'id:') THEN 'typo_to_id' WHEN typo THEN 'typo' ELSE own_method END AS method FROM t),
    s AS (SELECT *, CAST(CASE method WHEN 'placeholder' THEN 1 WHEN 'company_id' THEN 0.9 WHEN 'name_crosswalk' THEN 0.97 WHEN 'typo_to_id' THEN 0.9 WHEN 'typo' THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence FROM v)"""


def employers(spark, d):
    """Order lines as rows of employment: each part's name and type in seven spellings, some of them with an id."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.lower("p_name").alias("nm"), F.lower("p_type").alias("ty"))
    r = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("b", F.concat_ws(" ", "nm", "ty"))
    twice = F.concat(F.left("ty", F.lit(3)), F.expr("substring(ty, 3)"))
    forms = [F.upper("b"), F.concat_ws(" ", "ty", "nm"), F.concat_ws(" ", F.col("nm"), twice), F.col("b"), F.replace(F.col("b"), F.lit(" "), F.lit("-")), F.lit("--")]
    name = F.coalesce(*(F.when(F.col("l_linenumber") == k + 1, x) for k, x in enumerate(forms)), F.lit("Freelance"))
    has_id = (F.col("l_linenumber") == 4) & F.col("ty").isin("economy", "standard", "small") & (F.col("p_size") <= 40)
    return r.select("l_orderkey", "l_linenumber", name.alias("name"), F.when(has_id, F.concat(F.lit("co_"), F.replace(F.col("b"), F.lit(" "), F.lit("_")))).alias("own"))


def _named(spark, d):
    rows = employers(spark, d)
    return rows, N.company_values(N.company_vocabulary(rows, "name", "own"), [("^freelance$", "self")])


@query(
    "token_typo_clusters",
    f"""WITH {_FORMS}, q AS (SELECT name AS value, min(g) AS g, count(*) AS freq FROM f WHERE k <= 5 GROUP BY 1), m AS (SELECT value, g, freq, replace(lower(value), '-', ' ') AS words FROM q), c AS (SELECT g, arg_min(value, (-freq, value)) AS representative FROM m GROUP BY 1)
    SELECT value, representative FROM m JOIN c USING (g)""",
)
def token_typo_clusters(spark, d):
    vocab = employers(spark, d).filter("l_linenumber <= 5").groupBy(F.col("name").alias("value")).agg(F.count("*").alias("freq"))
    return S.token_typo_clusters(vocab.withColumn("words", F.regexp_replace(F.lower("value"), "-", " ")), "value", "freq", "words")


@query("misspelt_words")
def misspelt_words(spark, d):
    """The words of all documents that count as the same as another one."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return S.word_pairs(words, "word")


@query("company_values", f"WITH {_VALUES} SELECT value, company, method, confidence FROM s")
def company_values(spark, d):
    return _named(spark, d)[1]


@query(
    "company_rows",
    f"""WITH {_VALUES} SELECT l_orderkey, k AS l_linenumber, name, own, CASE WHEN method <> 'placeholder' AND own IS NOT NULL THEN 'id:' || own ELSE company END AS company, CASE WHEN method <> 'placeholder' AND own IS NOT NULL THEN 'company_id' ELSE method END AS company_method, CASE WHEN own IS NOT NULL THEN 1.0 ELSE confidence END AS company_confidence
    FROM f LEFT JOIN s ON name = value""",
)
def company_rows(spark, d):
    rows, values = _named(spark, d)
    return N.company_rows(rows, "name", "own", values)
