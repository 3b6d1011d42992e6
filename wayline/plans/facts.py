"""Queries of the fact tables: orders as education entries and as employment, whose lines are positions."""

from pyspark.sql import functions as F

from wayline.operators import facts as X
from wayline.plans.registry import query, table

_SEGMENTS = {"AUTOMOBILE": "cip:47.0604", "BUILDING": "cip:46", "FURNITURE": "cip:23.01", "HOUSEHOLD": "field_raw:__blank__"}
_DEGREES = {"1-URGENT": "doctorate:phd", "2-HIGH": "master:ms", "3-MEDIUM": "bachelor:ba", "4-NOT SPECIFIED": "degree_raw:none"}
_LEVELS = {"doctorate": 6, "master": 5, "bachelor": 4}

_EDUCATION = """raw AS (SELECT o_custkey AS person, o_orderkey // 2 * 2 AS idx0, o_orderkey AS idx, CASE WHEN o_orderkey % 5 > 0 THEN n_name END AS school, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS degree, CASE WHEN o_orderkey % 3 > 0 THEN c_mktsegment END AS field,
      CAST(year(o_orderdate) // 4 * 4 AS VARCHAR) AS start_year, CASE WHEN o_orderkey % 11 = 0 THEN 'Present' ELSE CAST(year(o_orderdate) // 4 * 4 + o_orderkey % 3 AS VARCHAR) END AS end_year, CASE WHEN o_orderkey % 4 = 0 THEN 'https://example.org/school/u-' || n_nationkey || '/?a=1' END AS url FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    ms AS (SELECT n_name AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'slug:s-' || n_nationkey ELSE 'school_raw:' || lower(n_name) END AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'alias' ELSE 'raw' END AS method, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence FROM nation),
    md(value, id) AS (VALUES ('1-URGENT', 'doctorate:phd'), ('2-HIGH', 'master:ms'), ('3-MEDIUM', 'bachelor:ba'), ('4-NOT SPECIFIED', 'degree_raw:none')),
    mf(value, id) AS (VALUES ('AUTOMOBILE', 'cip:47.0604'), ('BUILDING', 'cip:46'), ('FURNITURE', 'cip:23.01'), ('HOUSEHOLD', 'field_raw:__blank__')),
    gr(code, group_level, field_group) AS (VALUES ('23.01', 1, 'letters'), ('54.0101', 2, 'history'), ('46', 3, 'trades')),
    j AS (SELECT raw.*, nullif(regexp_extract(url, '/school/([^/?#]+)', 1), '') AS page, ms.id AS sid, ms.method AS sm, ms.confidence AS sc, md.id AS did, mf.id AS fid, CASE WHEN degree IN ('2-HIGH') THEN 'cip:54.0101' END AS dfid FROM raw LEFT JOIN ms ON school = ms.value LEFT JOIN md ON degree = md.value LEFT JOIN mf ON field = mf.value),
    k AS (SELECT *, dfid IS NOT NULL AND (fid IS NULL OR fid = 'field_raw:__blank__') AS back FROM j), c AS (SELECT *, CASE WHEN back THEN dfid ELSE fid END AS ff FROM k), e AS (SELECT *, CASE WHEN starts_with(ff, 'cip:') THEN substr(ff, 5) END AS code FROM c),
    facts AS (SELECT person, idx, school AS school_raw, CASE WHEN page IS NOT NULL THEN 'slug:' || page ELSE sid END AS school_canonical_id, CASE WHEN page IS NOT NULL THEN page WHEN starts_with(sid, 'slug:') THEN substr(sid, 6) END AS school_slug, CASE WHEN page IS NOT NULL THEN 'slug' ELSE sm END AS school_method, CASE WHEN page IS NOT NULL THEN 1.0 ELSE sc END AS school_confidence,
      degree AS degree_raw, did AS degree_canonical_id, CAST(CASE split_part(did, ':', 1) WHEN 'doctorate' THEN 6 WHEN 'master' THEN 5 WHEN 'bachelor' THEN 4 END AS TINYINT) AS degree_level, CASE WHEN did IS NOT NULL AND NOT starts_with(did, 'degree_raw:') THEN split_part(did, ':', 2) END AS degree_type, CASE WHEN did IS NOT NULL THEN 'exact' END AS degree_method, CASE WHEN did IS NOT NULL THEN 0.9::DOUBLE END AS degree_confidence,
      field AS field_raw, ff AS field_canonical_id, e.code, split_part(e.code, '.', 1) AS code2, CASE WHEN length(split_part(e.code, '.', 2)) >= 2 THEN split_part(e.code, '.', 1) || '.' || left(split_part(e.code, '.', 2), 2) END AS code4, CASE WHEN back THEN 'code_from_degree' WHEN fid IS NOT NULL THEN 'title' END AS field_method, CASE WHEN back THEN 0.9::DOUBLE WHEN fid IS NOT NULL THEN 0.8::DOUBLE END AS field_confidence,
      TRY_CAST(start_year AS SMALLINT) AS start_year, TRY_CAST(end_year AS SMALLINT) AS end_year, group_level, field_group, coalesce(TRY_CAST(end_year AS SMALLINT) > 1999, FALSE) AS in_progress, row_number() OVER (PARTITION BY person, school, degree, field, start_year, TRY_CAST(end_year AS SMALLINT) ORDER BY idx) > 1 AS is_duplicate FROM e LEFT JOIN gr ON e.code = gr.code)"""


def _entries(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, begin = F.col("o_orderkey"), F.floor(F.year("o_orderdate") / 4).cast("int") * 4
    return o.select(
        F.col("o_custkey").alias("person"), key.alias("idx"), F.when(key % 5 > 0, F.col("n_name")).alias("school"), F.when(key % 7 > 0, F.col("o_orderpriority")).alias("degree"),
        F.when(key % 3 > 0, F.col("c_mktsegment")).alias("field"), begin.cast("string").alias("start_year"), F.when(key % 11 == 0, "Present").otherwise((begin + key % 3).cast("string")).alias("end_year"),
        F.when(key % 4 == 0, F.concat(F.lit("https://example.org/school/u-"), F.col("n_nationkey").cast("string"), F.lit("/?a=1"))).alias("url"),
    )


def _table(spark, pairs, method, confidence):
    return spark.createDataFrame([(v, i, method, confidence) for v, i in pairs.items()], "value string, canonical_id string, method string, confidence double")


def education(spark, d):
    nation, even = table(spark, d, "nation"), F.col("n_nationkey") % 2 == 0
    schools = nation.select(
        F.col("n_name").alias("value"), F.when(even, F.concat(F.lit("slug:s-"), F.col("n_nationkey").cast("string"))).otherwise(F.concat(F.lit("school_raw:"), F.lower("n_name"))).alias("canonical_id"),
        F.when(even, "alias").otherwise("raw").alias("method"), F.when(even, 0.95).otherwise(0.5).alias("confidence"),
    )
    maps = {"school": schools, "degree": _table(spark, _DEGREES, "exact", 0.9), "field": _table(spark, _SEGMENTS, "title", 0.8), "degree_field": _table(spark, {"2-HIGH": "cip:54.0101"}, "exact", 0.9)}
    groups = spark.createDataFrame([("23.01", 1, "letters"), ("54.0101", 2, "history"), ("46", 3, "trades")], "code string, group_level int, field_group string")
    return X.education_facts(_entries(spark, d), ["person", "idx"], maps, _LEVELS, groups, 1999)


@query("education_facts", f"WITH {_EDUCATION} SELECT * FROM facts")
def education_facts(spark, d):
    return education(spark, d)


_ROLLUP = f"""{_EDUCATION}, f AS (SELECT * FROM facts WHERE NOT is_duplicate),
    a AS (SELECT person, count(*) AS n_rows, max(degree_level) AS highest_level, min(end_year) FILTER (WHERE degree_level = 4) AS bachelor_year, min(end_year) AS first_year, max(end_year) AS last_year, coalesce(bool_or(group_level = 1), FALSE) AS group1_any, coalesce(bool_or(group_level IN (1, 2)), FALSE) AS group2_any, coalesce(bool_or(group_level IN (1, 2, 3)), FALSE) AS group3_any, coalesce(bool_or(group_level = 1 AND degree_level = 4), FALSE) AS group1_bachelor_any FROM f GROUP BY 1),
    h AS (SELECT f.person, max(end_year) AS highest_year FROM f JOIN a ON f.person = a.person AND f.degree_level = a.highest_level GROUP BY 1),
    t AS (SELECT person, code, code2, code4, group_level, field_group FROM f WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person ORDER BY degree_level DESC NULLS LAST, end_year DESC NULLS LAST, idx) = 1),
    s AS (SELECT person, school_slug FROM f WHERE school_slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person ORDER BY degree_level DESC NULLS LAST, end_year DESC NULLS LAST, idx) = 1),
    rolled AS (SELECT a.*, highest_year, code, code2, code4, group_level, field_group, school_slug FROM a LEFT JOIN h USING (person) LEFT JOIN t USING (person) LEFT JOIN s USING (person))"""


@query("education_rollup", f"WITH {_ROLLUP} SELECT * FROM rolled")
def education_rollup(spark, d):
    return X.education_rollup(education(spark, d), "person", "idx", 4)


@query(
    "institution_columns",
    f"""WITH {_ROLLUP}, x AS (SELECT school_slug, min(unit) AS unit FROM (SELECT 's-' || n_nationkey AS school_slug, n_regionkey AS unit FROM nation UNION ALL SELECT 'u-' || n_nationkey, (n_regionkey + 1) % 7 FROM nation UNION ALL SELECT 's-2', 9) GROUP BY 1)
    SELECT person, school_slug, r_regionkey AS inst_unit, r_name AS inst_label FROM rolled LEFT JOIN x USING (school_slug) LEFT JOIN region ON unit = r_regionkey""",
)
def institution_columns(spark, d):
    n = table(spark, d, "nation")
    of = lambda prefix, unit: n.select(F.concat(F.lit(prefix), F.col("n_nationkey").cast("string")).alias("school_slug"), unit.cast("long").alias("unit"))
    crosswalk = of("s-", F.col("n_regionkey")).unionByName(of("u-", (F.col("n_regionkey") + 1) % 7)).unionByName(spark.createDataFrame([("s-2", 9)], "school_slug string, unit long"))
    meta = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("unit"), F.col("r_name").alias("label"))
    people = X.education_rollup(education(spark, d), "person", "idx", 4).select("person", "school_slug")
    return X.institution_columns(people, "school_slug", crosswalk, meta, "unit", ["label"])


_CAREER = """x AS (SELECT o_custkey AS person, o_orderkey AS experience_idx, CASE WHEN o_orderkey % 9 > 0 THEN c_mktsegment END AS company, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'c' || o_orderkey % 6 END AS company_id, CASE WHEN o_orderkey % 5 = 0 THEN 'https://example.org/school/U-' || n_nationkey || '/' END AS url, n_name AS location, o_orderpriority AS title,
      strftime(o_orderdate, '%b %Y') AS start_date, CASE o_orderkey % 6 WHEN 0 THEN 'Present' WHEN 1 THEN '2001' END AS end_date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    y AS (SELECT o_custkey AS person, l_orderkey AS experience_idx, l_linenumber AS position_idx, CASE WHEN l_linenumber % 4 > 0 THEN l_returnflag END AS title, n_name AS location, strftime(l_shipdate, '%b %Y') AS start_date, CAST(NULL AS VARCHAR) AS end_date FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_shipdate) AS l_shipdate FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    steps AS (SELECT 'experience' AS source_table, person, experience_idx, CAST(NULL AS INT) AS position_idx, company, company_id, url, title, location, start_date, end_date FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.person = x.person AND y.experience_idx = x.experience_idx)
      UNION ALL SELECT 'position', y.person, y.experience_idx, position_idx, company, company_id, url, y.title, y.location, y.start_date, y.end_date FROM y LEFT JOIN x USING (person, experience_idx))"""


def _steps(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    experience = o.select(
        F.col("o_custkey").alias("person"), key.alias("experience_idx"), F.when(key % 9 > 0, F.col("c_mktsegment")).alias("company"),
        F.when(key % 4 == 0, " ").when(key % 4 == 1, F.concat(F.lit("c"), (key % 6).cast("string"))).alias("company_id"), F.when(key % 5 == 0, F.concat(F.lit("https://example.org/school/U-"), F.col("n_nationkey").cast("string"), F.lit("/"))).alias("url"),
        F.col("n_name").alias("location"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "MMM yyyy").alias("start_date"), F.when(key % 6 == 0, "Present").when(key % 6 == 1, "2001").alias("end_date"),
    )
    lines = table(spark, d, "lineitem").filter("l_orderkey % 3 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_shipdate").alias("l_shipdate")).join(o, F.col("l_orderkey") == key)
    positions = lines.select(
        F.col("o_custkey").alias("person"), F.col("l_orderkey").alias("experience_idx"), F.col("l_linenumber").cast("int").alias("position_idx"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_returnflag")).alias("title"),
        F.col("n_name").alias("location"), F.date_format("l_shipdate", "MMM yyyy").alias("start_date"), F.lit(None).cast("string").alias("end_date"),
    )
    return X.two_grains(experience, positions, ["person", "experience_idx"], "position_idx", ["company", "company_id", "url"])


@query("two_grains", f"WITH {_CAREER} SELECT * FROM steps")
def two_grains(spark, d):
    return _steps(spark, d)


@query(
    "career_facts",
    f"""WITH {_CAREER}, mc(value, id, method, confidence) AS (VALUES ('AUTOMOBILE', 'id:auto', 'company_id', 0.9::DOUBLE), ('BUILDING', 'raw:building', 'raw', 0.5::DOUBLE), ('FURNITURE', 'nonorg:self_employed', 'placeholder', 1.0::DOUBLE), ('HOUSEHOLD', 'nonorg:none', 'placeholder', 1.0::DOUBLE), (NULL, 'nonorg:none', 'placeholder', 1.0::DOUBLE)),
    ma(value, id) AS (VALUES ('c1', 'one'), ('c5', 'five')), mt(value, id, status, solo, owner, jury) AS (VALUES ('1-URGENT', 'title:lead|engineer', NULL, FALSE, TRUE, '15'), ('2-HIGH', 'title:|clerk', 'student', FALSE, FALSE, NULL), ('3-MEDIUM', 'title_raw:x', NULL, TRUE, FALSE, NULL), ('A', 'title:senior|seller', NULL, NULL, NULL, '41')),
    mo(value, id) AS (VALUES ('2-HIGH', 'soc:43-9061'), ('A', 'soc_none:a')), mg(value, family, anchor, landable) AS (VALUES ('5-LOW', 'ops', '11', TRUE), ('N', 'sales', '41', TRUE), ('R', 'care', '29', FALSE)), ml AS (SELECT n_name AS value, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3),
    ov AS (SELECT source_table, person, experience_idx, position_idx, '11-1021' AS code_override, '11' AS major_override FROM steps WHERE experience_idx % 13 = 0), fc AS (SELECT source_table, person, experience_idx, position_idx, 'trade' AS functional_cluster FROM steps WHERE experience_idx % 10 < 2),
    j AS (SELECT s.*, mc.id AS cid, mc.method AS cm, mc.confidence AS cc, nullif(trim(s.company_id), '') AS own, ma.id AS aid, nullif(lower(regexp_extract(url, '/school/([^/?#]+)', 1)), '') AS page, mt.id AS tid, status, coalesce(solo, FALSE) AS solo, coalesce(owner, FALSE) AS owner, jury, CASE WHEN starts_with(mo.id, 'soc:') THEN substr(mo.id, 5) END AS soc, mo.id AS oid, family, anchor, coalesce(landable, FALSE) AND functional_cluster IS NULL AS lands, country, code_override, major_override, functional_cluster
      FROM steps s LEFT JOIN mc ON s.company IS NOT DISTINCT FROM mc.value LEFT JOIN ma ON nullif(trim(s.company_id), '') = ma.value LEFT JOIN mt ON s.title = mt.value LEFT JOIN mo ON s.title = mo.value LEFT JOIN mg ON s.title = mg.value LEFT JOIN ml ON s.location = ml.value
      LEFT JOIN ov ON s.source_table = ov.source_table AND s.person = ov.person AND s.experience_idx = ov.experience_idx AND s.position_idx IS NOT DISTINCT FROM ov.position_idx LEFT JOIN fc ON s.source_table = fc.source_table AND s.person = fc.person AND s.experience_idx = fc.experience_idx AND s.position_idx IS NOT DISTINCT FROM fc.position_idx)
    SELECT source_table, person, experience_idx, position_idx, company AS company_raw, company_id AS company_id_raw, title AS title_raw, location AS location_raw,
      CASE WHEN cm = 'placeholder' THEN cid WHEN own IS NOT NULL THEN 'id:' || coalesce(aid, own) WHEN page IS NOT NULL THEN 'id:' || page ELSE cid END AS company_canonical_id, CASE WHEN cm = 'placeholder' THEN NULL WHEN own IS NOT NULL THEN coalesce(aid, own) WHEN page IS NOT NULL THEN page WHEN starts_with(cid, 'id:') THEN substr(cid, 4) END AS company_id_canonical,
      CASE WHEN cm = 'placeholder' THEN cm WHEN own IS NOT NULL THEN 'company_id' WHEN page IS NOT NULL THEN 'school_url' ELSE cm END AS company_method, CASE WHEN cm = 'placeholder' THEN 1.0 WHEN own IS NOT NULL THEN 1.0 WHEN page IS NOT NULL THEN 0.98 ELSE cc END AS company_confidence,
      CASE WHEN status IS NOT NULL THEN status WHEN cm = 'placeholder' THEN CASE cid WHEN 'nonorg:none' THEN 'unknown' ELSE substr(cid, 8) END WHEN solo THEN 'self_employed' WHEN owner THEN 'business_owner' ELSE 'employee' END AS employment_type, CASE WHEN status IS NOT NULL THEN 'title_status' WHEN cm = 'placeholder' THEN 'company_placeholder' WHEN solo THEN 'title_solo_marker' WHEN owner THEN 'title_owner_marker' ELSE 'default_employee' END AS employment_type_method,
      CAST(CASE WHEN status IS NOT NULL THEN 1 WHEN cm = 'placeholder' THEN 1 WHEN solo THEN 0.95 WHEN owner THEN 0.9 ELSE 0.8 END AS DOUBLE) AS employment_type_confidence, tid AS title_canonical_id, CASE WHEN starts_with(tid, 'title:') THEN nullif(regexp_extract(tid, '^title:([^|]*)\\|', 1), '') END AS seniority_level, CASE WHEN starts_with(tid, 'title:') THEN regexp_extract(tid, '^title:[^|]*\\|(.*)$', 1) END AS role_canonical,
      CASE WHEN tid IS NOT NULL THEN 'rules' END AS title_method, CASE WHEN tid IS NOT NULL THEN 0.9::DOUBLE END AS title_confidence, soc AS occupation_code, CASE WHEN oid IS NOT NULL THEN 'exact' END AS occupation_method, CASE WHEN oid IS NOT NULL THEN 0.9::DOUBLE END AS occupation_confidence, coalesce(major_override, left(soc, 2), jury, CASE WHEN lands THEN anchor END) AS occupation_major_pooled,
      CASE WHEN soc IS NOT NULL THEN 'det' WHEN major_override IS NOT NULL THEN 'override' WHEN jury IS NOT NULL THEN 'jury' WHEN lands THEN 'family' END AS occupation_source, coalesce(code_override, soc) AS occupation_code_pooled, CASE WHEN code_override IS NOT NULL THEN 'override' WHEN soc IS NOT NULL THEN 'det' END AS occupation_code_source, family AS title_family, functional_cluster, country AS location_country, start_date, end_date,
      TRY_CAST(nullif(regexp_extract(start_date, '(19|20)[0-9][0-9]'), '') AS SMALLINT) AS start_year, CAST(nullif(list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], left(start_date, 3)), 0) AS TINYINT) AS start_month, TRY_CAST(nullif(regexp_extract(end_date, '(19|20)[0-9][0-9]'), '') AS SMALLINT) AS end_year, CAST(NULL AS TINYINT) AS end_month, coalesce(trim(end_date) = 'Present', FALSE) AS is_current,
      row_number() OVER (PARTITION BY person, company, title, start_date, end_date ORDER BY source_table, experience_idx, position_idx NULLS FIRST) > 1 AS is_duplicate FROM j""",
)
def career_facts(spark, d):
    steps, keys = _steps(spark, d), ["source_table", "person", "experience_idx", "position_idx"]
    rows = lambda data, names: spark.createDataFrame(data, names)
    n = table(spark, d, "nation").filter("n_nationkey <> 3").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    titles = [("1-URGENT", "title:lead|engineer", None, False, True, "15"), ("2-HIGH", "title:|clerk", "student", False, False, None), ("3-MEDIUM", "title_raw:x", None, True, False, None), ("A", "title:senior|seller", None, None, None, "41")]
    companies = [("AUTOMOBILE", "id:auto", "company_id", 0.9), ("BUILDING", "raw:building", "raw", 0.5), ("FURNITURE", "nonorg:self_employed", "placeholder", 1.0), ("HOUSEHOLD", "nonorg:none", "placeholder", 1.0), (None, "nonorg:none", "placeholder", 1.0)]
    maps = {
        "company": rows(companies, "value string, canonical_id string, method string, confidence double"),
        "alias": rows([("c1", "one"), ("c5", "five")], "value string, canonical_id string"),
        "title": rows(titles, "value string, canonical_id string, employment_status string, employment_solo boolean, employment_owner boolean, jury_major string").withColumns({"method": F.lit("rules"), "confidence": F.lit(0.9)}),
        "occupation": rows([("2-HIGH", "soc:43-9061", "exact", 0.9), ("A", "soc_none:a", "exact", 0.9)], "value string, canonical_id string, method string, confidence double"),
        "family": rows([("5-LOW", "ops", "11", True), ("N", "sales", "41", True), ("R", "care", "29", False)], "value string, family string, anchor string, landable boolean"),
        "place": n.select(F.col("n_name").alias("value"), F.col("r_name").alias("country")),
    }
    overrides = steps.filter("experience_idx % 13 = 0").select(*keys, F.lit("11-1021").alias("code_override"), F.lit("11").alias("major_override"))
    clusters = steps.filter("experience_idx % 10 < 2").select(*keys, F.lit("trade").alias("functional_cluster"))
    return X.career_facts(steps, keys, maps, overrides, clusters, {"none": "unknown"})
