"""Queries of votes, calibration, agreement and data quality."""

from pyspark.sql import functions as F

from wayline.operators import evaluation as E
from wayline.plans.aggregates import hierarchical_codes
from wayline.plans.registry import query, table

_VOTES = """v AS (SELECT doc_id, 'length' AS juror, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS code FROM documents UNION ALL SELECT doc_id, 'language', CASE WHEN lang = 'en' THEN '1' ELSE '0' END FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN source = 'src0' THEN '0' ELSE '1' END FROM documents)"""


def votes(spark, d):
    docs = table(spark, d, "documents")
    rules = {"length": F.col("n_chars") > 1000, "language": F.col("lang") == "en", "source": F.col("source") != "src0"}
    cast = F.explode(F.array(*(F.struct(F.lit(j).alias("juror"), F.when(r, "1").otherwise("0").alias("code")) for j, r in rules.items())))
    return docs.select("doc_id", cast.alias("v")).select("doc_id", "v.*")


@query("vote_state", f"WITH {_VOTES} SELECT doc_id, 3 AS votes, count(DISTINCT code) AS codes, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS unanimous, CASE WHEN count(*) FILTER (code = '1') >= 2 THEN '1' ELSE '0' END AS majority, CASE WHEN count(DISTINCT code) = 1 THEN 'unanimous' ELSE 'majority' END AS state FROM v GROUP BY 1")
def vote_state(spark, d):
    return E.vote_state(votes(spark, d), "doc_id", "code")


@query(
    "hier_consensus",
    """WITH v AS (SELECT c_nationkey AS item, r_name || '.' || n_name || CASE WHEN c_acctbal > 0 THEN '.' || c_mktsegment ELSE '' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), t AS (SELECT item, count(*) AS t FROM v GROUP BY 1),
    p AS (SELECT item, array_to_string(string_split(code, '.')[1:k], '.') AS p, k FROM v CROSS JOIN (VALUES (1), (2), (3)) x(k) WHERE len(string_split(code, '.')) >= k), n AS (SELECT item, p, k, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT item, p, k, row_number() OVER (PARTITION BY item ORDER BY k DESC, n DESC, p DESC) AS rn FROM n JOIN t USING (item) WHERE n > 0.2 * t)
    SELECT t.item AS c_nationkey, p AS consensus, coalesce(k, 0) AS depth FROM t LEFT JOIN b ON t.item = b.item AND rn = 1""",
)
def hier_consensus(spark, d):
    return E.hierarchical_consensus(hierarchical_codes(spark, d).select("c_nationkey", "code"), "c_nationkey", "code", 0.2, 3)


_GOLD = "g AS (SELECT doc_id, CAST(quality AS VARCHAR) AS gold, toxic AS band FROM labels)"


@query(
    "calibration_bands",
    f"""WITH {_VOTES}, {_GOLD}, s AS (SELECT doc_id, CASE WHEN count(DISTINCT code) = 1 THEN 'unanimous' ELSE 'majority' END AS state, CASE WHEN count(*) FILTER (code = '1') >= 2 THEN '1' ELSE '0' END AS called FROM v GROUP BY 1),
    o AS (SELECT 'juror:' || juror AS slice, count(*) AS n, avg(CAST(code = gold AS INT)) AS a FROM v JOIN g USING (doc_id) GROUP BY 1 UNION ALL SELECT 'state:' || state, count(*), avg(CAST(called = gold AS INT)) FROM s JOIN g USING (doc_id) GROUP BY 1 UNION ALL SELECT 'band:' || band, count(*), avg(CAST(called = gold AS INT)) FROM s JOIN g USING (doc_id) GROUP BY 1) SELECT slice, n, round(a, 6) AS accuracy, a >= 0.85 AS passes FROM o""",
)
def calibration_bands(spark, d):
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"), F.col("toxic").alias("band"))
    return E.calibration(votes(spark, d), gold, "doc_id", "juror", "code", "gold", "band", 0.85)


@query(
    "level_scores",
    """WITH c AS (SELECT r_name || '.' || n_name || CASE WHEN c_acctbal > 0 THEN '.' || c_mktsegment ELSE '' END AS gold, CASE WHEN c_custkey % 4 > 0 THEN r_name || CASE WHEN c_custkey % 4 > 1 THEN '.' || n_name || CASE WHEN c_custkey % 4 > 2 THEN '.BUILDING' ELSE '' END ELSE '' END END AS pred FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    l AS (SELECT k AS level, CASE WHEN len(string_split(pred, '.')) >= k THEN array_to_string(string_split(pred, '.')[1:k], '.') END AS p, CASE WHEN len(string_split(gold, '.')) >= k THEN array_to_string(string_split(gold, '.')[1:k], '.') END AS g FROM c CROSS JOIN (VALUES (1), (2), (3)) x(k))
    SELECT level, count(p) AS predicted, count(g) AS known, round(count(*) FILTER (p = g) / count(p), 6) AS precision, round(count(*) FILTER (p = g) / count(g), 6) AS recall FROM l GROUP BY 1""",
)
def level_scores(spark, d):
    k = F.col("c_custkey") % 4
    pred = F.when(k > 0, F.concat("r_name", F.when(k > 1, F.concat(F.lit("."), "n_name", F.when(k > 2, ".BUILDING").otherwise(""))).otherwise("")))
    return E.level_scores(hierarchical_codes(spark, d).withColumn("pred", pred), "pred", "code", 3)


_PRED = "p AS (SELECT quality AS gold, CASE WHEN n_chars > 3000 THEN 1 WHEN n_chars > 200 THEN CASE WHEN lang = 'en' THEN 1 ELSE 0 END END AS pred FROM labels JOIN documents USING (doc_id))"


def predictions(spark, d):
    call = F.when(F.col("n_chars") > 3000, 1).when(F.col("n_chars") > 200, F.when(F.col("lang") == "en", 1).otherwise(0))
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("gold"), call.alias("pred"))


@query(
    "macro_f1",
    f"WITH {_PRED}, f AS (SELECT c, 2 * (SELECT count(*) FROM p WHERE pred = c AND gold = c) / ((SELECT count(*) FROM p WHERE gold = c) + (SELECT count(*) FROM p WHERE pred = c)) AS f1 FROM (SELECT DISTINCT gold AS c FROM p)) SELECT round((SELECT avg(f1) FROM f), 6) AS macro_f1, round(count(pred) / count(*), 6) AS coverage, round(count(*) FILTER (pred = gold) / count(pred), 6) AS accuracy FROM p",
)
def macro_f1(spark, d):
    return E.macro_f1(predictions(spark, d), "pred", "gold")


@query(
    "kappa",
    f"WITH {_PRED}, k AS (SELECT * FROM p WHERE pred IS NOT NULL), c AS (SELECT count(*) AS n, count(*) FILTER (pred = gold) / count(*) AS po, (count(*) FILTER (pred = 1) * count(*) FILTER (gold = 1) + count(*) FILTER (pred = 0) * count(*) FILTER (gold = 0)) / (count(*) * count(*)) AS pe FROM k) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM c",
)
def kappa(spark, d):
    return E.kappa(predictions(spark, d), "pred", "gold")


@query("wilson", "WITH c AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (lang = 'en') / count(*) AS p FROM documents GROUP BY 1) SELECT source, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c")
def wilson(spark, d):
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("lang") == "en").alias("k"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return c.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "pair_scores",
    "WITH p AS (SELECT p_partkey AS a, p_partkey + 1 AS b, p_partkey % 3 = 0 AS same FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)), j AS (SELECT same, coalesce(x.p_type = y.p_type, FALSE) AS m FROM p LEFT JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b), c AS (SELECT count(*) FILTER (m AND same) AS tp, count(*) FILTER (m AND NOT same) AS fp, count(*) FILTER (NOT m AND same) AS fn FROM j) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
)
def pair_scores(spark, d):
    p = table(spark, d, "part")
    last = p.agg(F.max("p_partkey").alias("m"))
    pairs = p.join(F.broadcast(last)).filter("p_partkey < m").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), (F.col("p_partkey") % 3 == 0).alias("same"))
    return E.pair_scores(pairs, p, "a", "b", "same", "p_partkey", "p_type")


@query("bias_delta", "WITH a AS (SELECT c_mktsegment, round(avg(o_totalprice), 6) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), b AS (SELECT c_mktsegment, round(avg(o_totalprice), 6) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_mktsegment, a, b, round(b - a, 6) AS delta, abs(b - a) > 1000 AS material FROM a JOIN b USING (c_mktsegment)")
def bias_delta(spark, d):
    from wayline.plans.aggregates import order_customer

    stat = lambda df: df.groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    rows = order_customer(spark, d)
    return E.bias_delta(stat(rows), stat(rows.filter("o_orderstatus = 'F'")), ["c_mktsegment"], "v", 1000)


@query("key_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(spark, d):
    return E.key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("rule_violations", "SELECT 'ships after order' AS rule, count(*) FILTER (NOT l_shipdate >= o_orderdate) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'discount below tax', count(*) FILTER (NOT l_discount <= l_tax) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def rule_violations(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.rule_violations(j, {"ships after order": F.col("l_shipdate") >= F.col("o_orderdate"), "discount below tax": F.col("l_discount") <= F.col("l_tax")})


@query("row_preservation", "SELECT count(*) AS rows_before, count(*) AS rows_after, TRUE AS preserved FROM orders")
def row_preservation(spark, d):
    from wayline.operators.joins import map_values

    o = table(spark, d, "orders")
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    return E.row_preservation(o, map_values(o, names, {"o_custkey": "c_custkey"}, ["c_name"]))


@query("column_profile", "SELECT 'source' AS column, count(*) AS rows, count(*) FILTER (source IS NULL) AS nulls, count(*) FILTER (trim(source) = '') AS blanks, count(DISTINCT source) AS distinct, count(DISTINCT lower(source)) AS distinct_lower, CAST(median(length(source)) AS DOUBLE) AS median_length FROM documents UNION ALL SELECT 'text', count(*), count(*) FILTER (text IS NULL), count(*) FILTER (trim(text) = ''), count(DISTINCT text), count(DISTINCT lower(text)), CAST(median(length(text)) AS DOUBLE) FROM documents")
def column_profile(spark, d):
    return E.column_profile(table(spark, d, "documents"), ["source", "text"])


@query(
    "kappa_weighted",
    "WITH k AS (SELECT quality AS a, toxic AS b, n_chars AS w FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*) AS n, sum(w) AS s, sum(w) FILTER (a = b) / sum(w) AS po FROM k), e AS (SELECT sum(x * y) AS e FROM (SELECT a AS c, sum(w) AS x FROM k GROUP BY 1) JOIN (SELECT b AS c, sum(w) AS y FROM k GROUP BY 1) USING (c)) SELECT n, round(po, 6) AS agreement, round((po - e / s / s) / (1 - e / s / s), 6) AS kappa FROM t, e",
)
def kappa_weighted(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return E.kappa(j, "quality", "toxic", F.col("n_chars"))


@query("disagreements", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def disagreements(spark, d):
    return E.disagreements(table(spark, d, "labels"), "doc_id", "quality", "toxic")


_CALLS = "c AS (SELECT doc_id, source, lang, n_chars, CAST(quality AS VARCHAR) AS gold, CAST(toxic AS VARCHAR) AS second, CASE WHEN doc_id % 6 > 0 THEN CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END END AS call FROM labels JOIN documents USING (doc_id))"


def calls(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    call = F.when(F.col("doc_id") % 6 > 0, F.when(F.col("n_chars") > 1000, "1").otherwise("0"))
    return j.select("source", "lang", "n_chars", F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("second"), call.alias("call"))


@query(
    "assignment_scores",
    f"""WITH {_CALLS}, l AS (SELECT 'all' AS slice, * FROM c UNION ALL SELECT 'source:' || source, * FROM c UNION ALL SELECT 'lang:' || lang, * FROM c), s AS (SELECT slice, count(*) AS n, sum(n_chars) AS wn, count(call) AS m, coalesce(sum(n_chars) FILTER (call IS NOT NULL), 0) AS wm, count(*) FILTER (call = gold) AS st, coalesce(sum(n_chars) FILTER (call = gold), 0) AS wst, count(*) FILTER (call IN (gold, second)) AS le, coalesce(sum(n_chars) FILTER (call IN (gold, second)), 0) AS wle FROM l GROUP BY 1)
    SELECT slice, n, round(m / n, 6) AS coverage, round(wm / wn, 6) AS coverage_weighted, round(st / n, 6) AS strict, round(le / n, 6) AS lenient, round(wst / wn, 6) AS strict_weighted, round(wle / wn, 6) AS lenient_weighted, round(st / nullif(m, 0), 6) AS strict_assigned, round(le / nullif(m, 0), 6) AS lenient_assigned FROM s""",
)
def assignment_scores(spark, d):
    return E.assignment_scores(calls(spark, d), "call", "gold", "second", "n_chars", ["source", "lang"])


@query("confusion", f"WITH {_CALLS} SELECT gold, call, count(*) AS n FROM c WHERE gold IS DISTINCT FROM call GROUP BY 1, 2")
def confusion(spark, d):
    return E.confusion(calls(spark, d), "call", "gold")


def _leaderboard_sql():
    from wayline.plans.graphs import _TRADE

    return f"""WITH {_TRADE}, o AS (SELECT src, sum(weight) AS o FROM e WHERE src <> dst GROUP BY 1), i AS (SELECT dst, sum(weight) AS i FROM e WHERE src <> dst GROUP BY 1), nf AS (SELECT coalesce(src, dst) AS node, coalesce(i, 0) - coalesce(o, 0) AS score FROM o FULL JOIN i ON src = dst),
    pw AS (SELECT a, b, won / (won + lost) AS p FROM (SELECT a, b, sum(won) AS won, sum(lost) AS lost FROM (SELECT dst AS a, src AS b, weight AS won, 0 AS lost FROM e WHERE src <> dst UNION ALL SELECT src, dst, 0, weight FROM e WHERE src <> dst) GROUP BY ALL)), f AS (SELECT a, sum(p) AS w, sum(1 - p) AS l FROM pw GROUP BY 1),
    dv AS (SELECT pw.a AS node, any_value(f.w) + sum(pw.p * g.w) - any_value(f.l) - sum((1 - pw.p) * g.l) AS score FROM pw JOIN f ON f.a = pw.a JOIN f g ON g.a = pw.b GROUP BY 1), an AS (SELECT c_nationkey AS node, avg(c_acctbal) AS value FROM customer GROUP BY 1),
    raw AS (SELECT 'davids' AS method, node, CAST(round(score, 6) AS DOUBLE) AS score FROM dv UNION ALL SELECT 'net_flow', node, CAST(score AS DOUBLE) FROM nf), tn AS (SELECT method, corr(score, value) AS c FROM raw JOIN an USING (node) GROUP BY 1), sc AS (SELECT method, node, CASE WHEN c < 0 THEN -score ELSE score END AS score FROM raw JOIN tn USING (method)),
    rk AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS a, rank() OVER (PARTITION BY method ORDER BY value) + (count(*) OVER (PARTITION BY method, value) - 1) / 2 AS b FROM sc JOIN an USING (node)), rho AS (SELECT method, round(corr(a, b), 6) AS spearman FROM rk GROUP BY 1),
    sv AS (SELECT src, dst, sign(y.n_regionkey - x.n_regionkey) AS truth FROM e JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst WHERE x.n_regionkey <> y.n_regionkey), cl AS (SELECT h.method, truth, sign(h.score - l.score) AS call FROM sv JOIN sc l ON l.node = src JOIN sc h ON h.node = dst AND h.method = l.method),
    ac AS (SELECT method, count(*) AS silver, round(count(*) FILTER (call <> 0) / count(*), 6) AS coverage, round(count(*) FILTER (call = truth) / nullif(count(*) FILTER (call <> 0), 0), 6) AS accuracy, round(count(*) FILTER (call > 0 AND truth > 0) / nullif(count(*) FILTER (call > 0), 0), 6) AS up_precision, round(count(*) FILTER (call < 0 AND truth < 0) / nullif(count(*) FILTER (call < 0), 0), 6) AS down_precision FROM cl GROUP BY 1),
    ld AS (SELECT l.method, count(*) FILTER (h.score > l.score) AS ladders_kept, count(*) AS ladders FROM nation JOIN sc l ON l.node = n_nationkey JOIN sc h ON h.node = n_nationkey + 1 AND h.method = l.method WHERE n_nationkey % 5 = 0 GROUP BY 1) SELECT * FROM ac LEFT JOIN rho USING (method) LEFT JOIN ld USING (method)"""


@query("ranking_leaderboard", _leaderboard_sql())
def ranking_leaderboard(spark, d):
    """Nations ranked by pairwise wins and by net flow; directions and ladders by region and number, the customers' mean balance as anchor."""
    from wayline.operators import graphs as G
    from wayline.plans.graphs import trade_edges

    e, n = trade_edges(spark, d), table(spark, d, "nation")
    region = lambda end: n.select(F.col("n_nationkey").alias(end), F.col("n_regionkey").alias(f"r_{end}"))
    methods = {"davids": G.davids_score(e).withColumn("score", F.round("score", 6)), "net_flow": G.node_strengths(e).select("node", F.col("net_flow").alias("score"))}
    silver = e.join(region("src"), "src").join(region("dst"), "dst").select("src", "dst", F.signum(F.col("r_dst") - F.col("r_src")).alias("truth")).filter("truth <> 0")
    anchor = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("value"))
    ladders = n.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("low"), (F.col("n_nationkey") + 1).alias("high"))
    return E.ranking_leaderboard(methods, silver, anchor, ladders)


@query(
    "calibration_terciles",
    f"""WITH {_VOTES}, {_GOLD}, c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS pos, count(*) OVER () AS t FROM c), b AS (SELECT source, CAST(CASE WHEN pos <= (t % 3) * (t // 3 + 1) THEN ceil(pos / (t // 3 + 1)) ELSE t % 3 + ceil((pos - (t % 3) * (t // 3 + 1)) / (t // 3)) END AS INT) AS tercile FROM k),
    s AS (SELECT doc_id, CASE WHEN count(*) FILTER (code = '1') >= 2 THEN '1' ELSE '0' END AS called FROM v GROUP BY 1) SELECT 'band:' || tercile AS slice, count(*) AS n, round(avg(CAST(called = gold AS INT)), 6) AS accuracy, avg(CAST(called = gold AS INT)) >= 0.5 AS passes FROM s JOIN g USING (doc_id) JOIN documents USING (doc_id) JOIN b USING (source) GROUP BY tercile""",
)
def calibration_terciles(spark, d):
    """Accuracy of the votes by tercile of how often a source occurs."""
    from wayline.operators.windows import terciles

    docs = table(spark, d, "documents")
    bands = terciles(docs.groupBy("source").agg(F.count("*").alias("n")), "n", "source").select("source", "tercile")
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("gold"))
    gold = gold.join(docs.select("doc_id", "source"), "doc_id").join(bands, "source").select("doc_id", "gold", "tercile")
    return E.calibration(votes(spark, d), gold, "doc_id", "juror", "code", "gold", "tercile", 0.5).filter("slice LIKE 'band:%'")


_HEAD = """h AS (SELECT p_partkey AS row, upper(left(p_type, 1)) || '.' || p_brand AS code FROM part WHERE p_partkey % 50 <> 7), r AS (SELECT p_partkey AS row, CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'xun' WHEN 2 THEN 'Q.Q' WHEN 3 THEN upper(left(p_type, 1)) WHEN 4 THEN upper(left(p_type, 1)) || '.Brand#1' WHEN 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 'E' ELSE upper(left(p_type, 1)) || '.' || p_brand END ELSE lower(upper(left(p_type, 1)) || '.' || p_brand) END AS code FROM part),
    v AS (SELECT DISTINCT upper(code) AS code FROM h UNION SELECT DISTINCT upper(left(p_type, 1)) FROM part UNION SELECT DISTINCT upper(left(p_type, 1)) || '.BRAND#1' FROM part)"""


def _reviewed(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    top = F.left("p_type", F.lit(1))
    whole = F.concat(top, F.lit("."), F.col("p_brand"))
    head = p.filter(k % 50 != 7).select(k.alias("row"), F.upper(whole).alias("code"))
    said = F.when(k % 10 == 0, None).when(k % 10 == 1, "xun").when(k % 10 == 2, "Q.Q").when(k % 10 == 3, top).when(k % 10 == 4, F.concat(top, F.lit(".Brand#1"))).when(k % 10 == 5, F.when(k % 3 == 0, "E").otherwise(whole)).otherwise(F.lower(whole))
    valid = head.select("code").union(p.select(top)).union(p.select(F.concat(top, F.lit(".BRAND#1")))).distinct()
    return head, p.select(k.alias("row"), said.alias("code")), valid


@query(
    "head_gate",
    f"""WITH {_HEAD}, j AS (SELECT h.row IS NOT NULL AS known, upper(r.code) AS said, upper(h.code) AS head, v.code IS NOT NULL AS valid FROM r LEFT JOIN h USING (row) LEFT JOIN v ON v.code = upper(r.code)), s AS (SELECT *, known AND (said IS NULL OR said = 'XUN') AS silent FROM j), t AS (SELECT *, known AND NOT silent AND valid AS scored FROM s),
    u AS (SELECT *, scored AND split_part(said, '.', 1) = split_part(head, '.', 1) AS f FROM t), w AS (SELECT *, f AND said LIKE '%.%' AND head LIKE '%.%' AS deep FROM u), c AS (SELECT count(*) AS reviews, count(*) FILTER (NOT known) AS unmatched, count(*) FILTER (silent) AS abstained, count(*) FILTER (known AND NOT silent AND NOT valid) AS invalid, count(*) FILTER (scored) AS scored, count(*) FILTER (f) AS l1, count(*) FILTER (deep) AS level2_n, count(*) FILTER (deep AND said = head) AS l2, count(*) FILTER (scored AND said = head) AS e FROM w)
    SELECT reviews, unmatched, abstained, invalid, scored, round(l1 / scored, 6) AS level1, level2_n, round(l2 / level2_n, 6) AS level2, round(e / scored, 6) AS exact, unmatched = 0 AND l1 / scored >= 0.9 AS passes FROM c""",
)
def head_gate(spark, d):
    head, review, valid = _reviewed(spark, d)
    return E.head_gate(head, review, "row", "code", ["XUN"], valid)


_GOLD = """r AS (SELECT p_name AS text, p_brand AS line, CASE p_size % 3 WHEN 0 THEN 'det' WHEN 1 THEN 'jury' ELSE 'degree_type' END AS source, CASE WHEN p_size % 5 > 0 THEN p_type END AS code FROM part), g AS (SELECT DISTINCT text, CASE WHEN text LIKE 'r%' THEN 'det' WHEN text LIKE '%o%' THEN 'jury' ELSE 'rest' END AS tier, CASE WHEN text LIKE '%ring' THEN 'XUN' WHEN text LIKE '%bolt' THEN 'ECONOMY' ELSE 'PROMO' END AS gold_code, CASE WHEN text LIKE 'n%' THEN 'SMALL' END AS gold_secondary FROM r WHERE text NOT LIKE 'hot%'),
    s AS (SELECT text, line, count(*) AS n, arg_min(source, (coalesce(source, ''), code IS NOT NULL, coalesce(code, ''))) AS ms, arg_min(coalesce(code, '-'), (coalesce(source, ''), code IS NOT NULL, coalesce(code, ''))) AS mc FROM r GROUP BY 1, 2), m AS (SELECT text, ms, nullif(mc, '-') AS mc FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, line) = 1), w AS (SELECT text, count(*) AS k, count(*) FILTER (code = gold_code) AS ok FROM r JOIN g USING (text) GROUP BY 1),
    lv(code, level) AS (VALUES ('ECONOMY', 1), ('PROMO', 2), ('SMALL', 2), ('LARGE', 1)), j AS (SELECT g.*, ms, mc, k, ok, gold_code <> 'XUN' AS graded, a.level IS NOT DISTINCT FROM b.level AS same FROM g LEFT JOIN m USING (text) LEFT JOIN w USING (text) LEFT JOIN lv a ON mc = a.code LEFT JOIN lv b ON gold_code = b.code)"""


@query(
    "gold_scores",
    f"""WITH {_GOLD}, c AS (SELECT tier, count(*) AS n, count(*) FILTER (graded) AS graded, count(*) FILTER (graded AND mc = gold_code) AS s, count(*) FILTER (graded AND (coalesce(mc = gold_code, FALSE) OR coalesce(mc = gold_secondary, FALSE))) AS l, count(*) FILTER (graded AND same) AS v, count(*) FILTER (graded AND mc IS NOT NULL) AS c, sum(k) FILTER (graded) AS w, sum(ok) FILTER (graded) AS o, count(*) FILTER (NOT graded AND mc IS NULL) AS abstained, count(*) FILTER (NOT graded AND mc IS NOT NULL AND ms = 'jury') AS string_label, count(*) FILTER (NOT graded AND mc IS NOT NULL AND ms <> 'jury') AS degree_line FROM j GROUP BY 1)
    SELECT tier, n, graded, round(s / nullif(graded, 0), 6) AS strict, round(l / nullif(graded, 0), 6) AS lenient, round((l - s) / nullif(graded, 0), 6) AS gap, round(v / nullif(graded, 0), 6) AS level, round(o / w, 6) AS row_strict, round(c / nullif(graded, 0), 6) AS reach, abstained, string_label, degree_line FROM c""",
)
def gold_scores(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size")
    rows = p.select(F.col("p_name").alias("text"), F.col("p_brand").alias("line"), F.when(n % 3 == 0, "det").when(n % 3 == 1, "jury").otherwise("degree_type").alias("source"), F.when(n % 5 > 0, F.col("p_type")).alias("code"))
    t = F.col("text")
    gold = rows.filter(~t.startswith("hot")).select("text").distinct().withColumns({
        "tier": F.when(t.startswith("r"), "det").when(t.contains("o"), "jury").otherwise("rest"), "gold_code": F.when(t.endswith("ring"), "XUN").when(t.endswith("bolt"), "ECONOMY").otherwise("PROMO"), "gold_secondary": F.when(t.startswith("n"), "SMALL"),
    })
    levels = spark.createDataFrame([("ECONOMY", 1), ("PROMO", 2), ("SMALL", 2), ("LARGE", 1)], "code string, level int")
    return E.gold_scores(rows, gold, "text", "line", "source", "code", "tier", levels, "XUN", ["jury"])
