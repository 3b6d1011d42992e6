"""Fact tables: one exchange for all mappings, rows kept, picks; rules taken from hand-made cases."""

import pytest
from pyspark.sql import functions as F

from wayline.operators import composites as K
from wayline.operators import facts as X
from wayline.sources import records


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_mappings_share_one_exchange(spark):
    """As many exchanges for nine mappings as for two, and none of them carries the wide rows by a mapped value."""
    facts = spark.range(1000).select("id", *(F.concat(F.lit(f"v{k}_"), (F.col("id") % (k + 2)).cast("string")).alias(f"c{k}") for k in range(9)), F.repeat(F.lit("x"), 50).alias("wide"))
    tables = {f"m{k}": (f"c{k}", spark.range(5).select(F.concat(F.lit(f"v{k}_"), F.col("id").cast("string")).alias("value"), F.col("id").alias("code"))) for k in range(9)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, many = (X.map_values(facts, ["id"], dict(list(tables.items())[:n])) for n in (2, 9))
        assert exchanges(few) == exchanges(many) <= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {r.id: r for r in many.collect()}
    assert len(got) == 1000 and got[7].m3.code == 2 and got[6].m8 is None and got[4].m8.code == 4


def test_mapped_rows_stay_as_many_with_nulls_and_double_entries(spark):
    facts = spark.createDataFrame([("a", 1, "x"), ("a", None, "x"), ("b", 1, None), ("b", 2, "other")], "p string, i int, v string")
    mapping = spark.createDataFrame([("x", "two"), ("x", "one"), (None, "none")], "value string, to string")
    got = sorted((r.p, str(r.i), r.m and r.m.to) for r in X.map_values(facts, ["p", "i"], {"m": ("v", mapping)}).collect())
    assert got == [("a", "1", "one"), ("a", "None", "one"), ("b", "1", "none"), ("b", "2", None)]
    without = X.map_values(facts, ["p", "i"], {"m": ("v", mapping.filter("value is not null"))})
    assert without.count() == 4 and X.map_values(facts.limit(0), ["p", "i"], {"m": ("v", mapping)}).count() == 0


def test_dates_as_profiles_write_them(spark):
    rows = spark.createDataFrame([("Jan 1998",), ("2003",), ("Present",), (None,), ("since Dec 2010",), ("1850",)], "d string")
    got = [tuple(r) for r in rows.select(*(c.alias(n) for n, c in X.date_columns("start", F.col("d")).items())).collect()]
    assert got == [(1998, 1), (2003, None), (None, None), (None, None), (2010, 12), (None, None)]


def test_rollup_picks_under_different_orders(spark):
    rows = [
        (1, 1, 4, 2001, "23.01", 1, "s1", False), (1, 2, 5, None, None, None, None, False), (1, 3, 5, 1999, "46", 3, None, False), (1, 4, 6, 2030, "9", None, "dup", True),
        (2, 1, None, 2010, None, None, "s2", False), (3, 5, 4, 2005, "46", 3, "late", False), (3, 2, 4, 2005, "47", None, "first", False),
    ]
    facts = spark.createDataFrame(rows, "person int, idx int, degree_level int, end_year int, code string, group_level int, school_slug string, is_duplicate boolean").withColumns({"code2": F.col("code"), "code4": F.col("code"), "field_group": F.lit("g")})
    got = {r.person: r for r in X.education_rollup(facts, "person", "idx", 4).collect()}
    one = got[1]
    assert (one.n_rows, one.highest_level, one.highest_year, one.bachelor_year, one.first_year, one.last_year) == (3, 5, 1999, 2001, 1999, 2001)
    assert (one.code, one.school_slug, one.group1_any, one.group1_bachelor_any) == ("46", "s1", True, True)
    assert (got[2].highest_level, got[2].highest_year, got[2].code, got[2].school_slug, got[2].group3_any) == (None, None, None, "s2", False)
    assert (got[3].code, got[3].school_slug, got[3].group2_any, got[3].group3_any) == ("47", "first", False, True)


def test_institutions_keep_rows_and_replace_earlier_columns(spark):
    people = spark.createDataFrame([(1, "a", "old"), (2, None, "old"), (3, "z", "old")], "person int, school_slug string, inst_label string")
    crosswalk = spark.createDataFrame([("a", 2), ("a", 1), (None, 7)], "school_slug string, unit int")
    meta = spark.createDataFrame([(1, "one"), (2, "two"), (7, "seven")], "unit int, label string")
    got = X.institution_columns(people, "school_slug", crosswalk, meta, "unit", ["label"])
    assert sorted(map(tuple, got.select("person", "inst_unit", "inst_label").collect())) == [(1, 1, "one"), (2, None, None), (3, None, None)]


def test_only_a_whole_unanimous_jury_is_accepted(spark):
    votes = {1: ["4", "4"], 2: ["4", "6"], 3: ["4", "XUN"], 4: ["4"], 5: ["XUN", "XUN"], 6: ["4", None]}
    rows = spark.createDataFrame([(i, f"j{k}", c) for i, v in votes.items() for k, c in enumerate(v)] + [(4, "guest", "4")], "item int, juror string, code string")
    got = {r.item: (r.outcome, r.code) for r in K.vote_outcomes(rows, "item", "juror", "code", ["j0", "j1"], ["XUN"]).collect()}
    assert got == {1: ("accepted", "4"), 2: ("disagree", None), 3: ("abstained", None), 4: ("incomplete", None), 5: ("abstained", None), 6: ("incomplete", None)}


def test_industry_reviews_follow_the_source(spark):
    companies = spark.createDataFrame([(1, "Acme"), (2, "First Real Estate Group"), (3, "Acme Co"), (4, "Zzxq Q"), (5, "Realty")], "k int, name string")
    curated = spark.createDataFrame([(1, "A.B")], "k int, curated_code string")
    prior = spark.createDataFrame([(1, "M.X", 0.9), (2, "F", 0.9), (3, "M.X", 0.9), (5, "RE", 0.4)], "k int, prior_code string, prior_confidence double")
    got = {r.k: (r.code, r.depth, r.source, r.confidence, r.per_level, r.review) for r in K.classify_industry(companies, "k", "name", curated, [("real estate", "RE.REST"), ("realty", "RE")], prior).collect()}
    assert got[1] == ("A.B", 2, "curated", 1.0, [1.0, 1.0], False)  # a curated code stands against the prior
    assert got[2] == ("RE.REST", 2, "name_rule", 0.9, [0.9, 0.9], True)
    assert got[3] == ("M.X", 2, "occupation_prior", 0.9, [0.9, 0.9], True) and got[4] == ("XOT", 1, "unresolved", 0.0, [0.0], True)
    assert got[5] == ("RE", 1, "name_rule", 0.87, [0.87], False)


def test_archetypes_need_persons_likeness_and_a_lead(spark):
    roles = spark.createDataFrame([(k, None if k else "r", 9 if k != 4 else 4) for k in range(6)], "k int, rule string, persons int")
    near = [(q, 100 + r, s, r + 1) for q, sims in {0: (0.9, 0.1), 1: (0.9, 0.1), 2: (0.44, 0.1), 3: (0.9, 0.86), 4: (0.9, 0.1)}.items() for r, s in enumerate(sims)]
    neighbours = spark.createDataFrame(near, "query int, neighbour int, similarity double, rank int")
    prototypes = spark.createDataFrame([(100, "p"), (101, "q")], "k int, archetype string")
    got = {r.k: (r.archetype, r.archetype_source, r.cosine) for r in K.assign_archetypes(roles, "k", F.col("rule"), F.col("persons"), neighbours, prototypes, "other").collect()}
    assert got[0] == ("r", "rule", None) and got[1] == ("p", "embed", 0.9) and all(got[k] == ("other", "residual_other", None) for k in (2, 3, 4, 5))
    codes = spark.createDataFrame([("a", 10, 200), ("a", 9, 20), ("a", 10, 201), (None, 10, 10)], "c string, s int, n int").select(K.trusted_code(F.col("c"), F.col("s"), F.col("n")).alias("t"))
    assert [r.t for r in codes.collect()] == ["a", None, None, None]


def test_censoring_by_the_snapshot_year(spark):
    steps = spark.createDataFrame([(1, "2000-01-01", "2001-03-01"), (1, "2003-01-01", "2009-12-31"), (2, "2004-05-05", "2010-01-01"), (3, "1970-01-01", "1971-01-01")], "e int, s string, t string").withColumns({"s": F.to_date("s"), "t": F.to_date("t")})
    macro = spark.createDataFrame([(2000, 4.5)], "y int, macro double")
    got = {r.e: r for r in K.cohort_profile(steps, "e", ["s", "t"], F.lit("v"), macro, "y", 2010, (1990, 2005)).collect()}
    assert (got[1].right_censored, got[2].right_censored, got[1].years_seen, got[1].generation, got[3].generation, got[3].valid_cohort, got[1].cohort, got[1].macro) == (False, True, 9, "Gen X", "Boomer", False, 2000, 4.5)


@pytest.mark.parametrize("header", [True, False])
def test_bad_lines_go_whatever_is_asked_for(spark, tmp_path, header):
    head = "k\tname\n" if header else ""
    for k in range(2):
        (tmp_path / f"f{k}.tsv").write_text("# preamble\n" * 2 + head + "none\tA\n1\tB\n2\tC\textra\n\n3\t\n" + f"4{k}\t\"q\n")
    got = records.read_delimited(spark, str(tmp_path), "k int, name string", header=header, skip_rows=2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, "B"), (1, "B"), (3, None), (3, None), (40, '"q'), (41, '"q')]
    assert got.count() == 6 and sorted(str(r.name) for r in got.select("name").collect()) == sorted(str(n) for _, n in rows)


def test_missing_tables_warn_and_other_errors_stay(spark, tmp_path):
    from pyspark.errors import AnalysisException

    with pytest.warns(UserWarning, match="not there"):
        assert records.optional(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(AnalysisException):
        records.optional(spark, f"{tmp_path}/empty", "a int")


def test_lines_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    spec = records.Record("t", "id", (records.Field("id"),))
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id": {k}}}\n' + "\n" * (k % 2) for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = records.read_lines(spark, str(tmp_path), spec)
        assert rows.rdd.getNumPartitions() >= 1
        assert sorted((r.source_row, r.rec.id) for r in rows.collect()) == [(k + 1, str(k)) for k in range(4000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
