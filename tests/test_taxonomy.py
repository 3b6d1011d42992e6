"""Rules and taxonomies as tables: titles, codes, prefixes; hand-made cases and the length of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import taxonomy as Y
from wayline.plans.taxonomy import RULES

SHORT = {"sr": "senior", "vp": "vice president", "asst": "assistant", "mgr": "manager", "coord": "coordinator", "dir": "director", "ops": "operations"}


def test_words_of_titles(spark):
    cases = {
        "Sr. Marketing Manager": "senior marketing manager", "V.P. of Sales": "vice president of sales", "Asst. Mgr": "assistant manager", "Program Coord.": "program coordinator", "Dir. of Ops": "director of operations",
        "Sales & Marketing": "sales and marketing", "Teacher at Lincoln High": "teacher", "Barista @ Starbucks": "barista", "Teacher's Aide": "teacher aide", "Cashier (part-time)": "cashier", "attorney at law": "attorney at law", "stay-at-home mom": "stay at home mom", "": "", "Ingénieur [C++]": "ingénieur",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").withColumns(Y.title_words(F.col("t"), SHORT))
    got = {r.t: r for r in df.collect()}
    assert {t: got[t].words for t in cases} == cases and got[None].words is None
    assert got["Cashier (part-time)"].modifiers == ["part time"] and got["Ingénieur [C++]"].modifiers == ["c++"]


TITLE_RULES = [
    ("family", 1, "intern", "intern", "high", True, False), ("family", 5, "marketing", "marketing", "high", False, False), ("family", 6, "teacher", "teaching", "high", False, False), ("family", 2, "marketing research", "research", "low", False, False),
    ("family", 7, "student", "student", "high", False, False), ("seniority", 1, "intern", "intern", "", False, False), ("seniority", 0, "intern coordinator", "intern", "", False, True), ("seniority", 2, "senior", "senior", "", False, False),
    ("seniority", 0, "senior living", "senior", "", False, True), ("flag", 0, "part time", "part_time", "", False, False), ("flag", 0, "student", "student", "", False, False), ("flag", 0, "volunteer", "volunteer", "", False, False),
]


def titled(spark, titles, rules):
    df = spark.createDataFrame([(t,) for t in titles], "t string").withColumns(Y.title_words(F.col("t"), SHORT))
    return {r.t: (r.family, r.seniority, r.flags, r.confidence) for r in Y.classify_titles(df, "t", "words", "modifiers", spark.createDataFrame(rules, RULES)).collect()}


def test_titles_by_rank_exclusions_and_modifiers(spark):
    got = titled(spark, ["intern", "marketing intern", "Marketing Research Sr.", "senior living teacher", "senior teacher (part-time)", "marketing intern coordinator", "student", "student teacher, volunteer", "zzz", "", None, "remarketing"], TITLE_RULES)
    assert got["intern"] == ("intern", "intern", [], "high") and got["marketing intern"] == ("marketing", "intern", ["intern"], "high")
    assert got["Marketing Research Sr."] == ("research", "senior", [], "low") and got["senior living teacher"] == ("teaching", "mid", [], "high")
    assert got["senior teacher (part-time)"] == ("teaching", "senior", ["part_time"], "high") and got["marketing intern coordinator"] == ("marketing", "mid", [], "high")
    assert got["student"] == ("student", "entry", [], "high") and got["student teacher, volunteer"] == ("teaching", "mid", ["student", "volunteer"], "high")
    assert all(got[t] == ("unclassified", "mid", [], "low") for t in ("zzz", "", None, "remarketing"))


def test_titles_against_a_walk_over_the_rules(spark):
    rng, words = random.Random(2), "a b c d e".split()
    rules = {}
    for k in range(60):
        axis = rng.choice(["family", "seniority", "flag"])
        phrase = " ".join(rng.choices(words, k=rng.randint(1, 3)))
        rules[axis, phrase] = (axis, k, phrase, f"{axis}{k % 7}", "high", rng.random() < 0.2, rng.random() < 0.2)
    rules = list(rules.values())
    titles = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(150)})

    def walk(title):
        out = {}
        for axis in ("family", "seniority", "flag"):
            hit = [r for r in rules if r[0] == axis and (title == r[2] if r[5] else f" {r[2]} " in f" {title} ")]
            blocked = {r[3] for r in hit if r[6]}
            out[axis] = sorted((not r[5], r[1], r[3]) for r in hit if not r[6] and r[3] not in blocked)
        first = lambda a, d: out[a][0][2] if out[a] else d
        return first("family", "unclassified"), first("seniority", "mid"), sorted({x[2] for x in out["flag"]})

    got = titled(spark, titles, rules)
    assert {t: got[t][:3] for t in titles} == {t: walk(t) for t in titles}


def test_a_thousand_rules_make_no_longer_plan(spark):
    df = spark.createDataFrame([("a b",)], "t string").withColumns(Y.title_words(F.col("t"), {}))
    size = lambda n: len(Y.classify_titles(df, "t", "words", "modifiers", spark.createDataFrame([("family", k, f"w{k} x", f"f{k}", "", False, False) for k in range(n)], RULES))._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(1000) == size(10)


def test_tiers_then_spelling(spark):
    vocab = spark.createDataFrame([("Computer Science", 9), ("science, computer", 2), ("Computer Scence", 1), ("Bus. Admin", 3), ("history", 4), ("Histtory", 1), ("Weaving Arts", 5), ("Weavving Arts", 1), ("역사", 2), ("--", 1)], "v string, n long")
    exact = spark.createDataFrame([("computer science", "11.07"), ("history", "54.01")], "key string, code string")
    tokens = Y.normal_forms(exact, "key").select(F.col("tokens").alias("key"), "code")
    alias, override = (spark.createDataFrame([x], "key string, code string") for x in (("bus admin", "52.02"), ("history", "54")))
    got = {r.value: (r.canonical_id, r.method, r.confidence) for r in Y.tiered_codes(vocab, "v", "n", [("cip_override", 0.98, "norm", override), ("cip_exact", 1.0, "norm", exact), ("cip_exact", 1.0, "tokens", tokens), ("cip_alias", 0.98, "norm", alias)], "cip", "field_raw").collect()}
    assert got["Computer Science"] == got["science, computer"] == ("cip:11.07", "cip_exact", 1.0) and got["Computer Scence"] == ("cip:11.07", "typo_to_cip", 0.9)
    assert got["Bus. Admin"] == ("cip:52.02", "cip_alias", 0.98) and got["history"] == ("cip:54", "cip_override", 0.98) and got["Histtory"] == ("cip:54", "typo_to_cip", 0.9)
    assert got["Weavving Arts"] == ("field_raw:weaving arts", "typo", 0.85) and got["역사"] == ("field_raw:역사", "raw", 0.5) and got["--"] == ("field_raw:--", "raw", 0.5)


def test_schools_by_own_slug_then_crosswalk(spark):
    rows = spark.createDataFrame([("Big U", "big", 500), ("Big-U", "other", 3), ("Torn U", "a", 5), ("torn u", "b", 4), ("One", "one", 1), ("None", None, 9)], "name string, slug string, n long")
    crosswalk = Y.guarded_crosswalk(rows, "name", "slug", "n")
    assert sorted(map(tuple, crosswalk.collect())) == [("big u", "big"), ("one", "one")]
    vocab = spark.createDataFrame([("BIG U.", 4, None), ("Torn U", 5, "a"), ("Big Uu", 1, None), ("Nowhere", 1, None)], "name string, n long, slug string")
    got = {r.value: (r.canonical_id, r.method, r.confidence) for r in Y.tiered_codes(vocab, "name", "n", [("slug_crosswalk", 0.98, "norm", crosswalk)], "slug", "name", own="slug", own_method="slug").collect()}
    assert got == {"BIG U.": ("slug:big", "slug_crosswalk", 0.98), "Torn U": ("slug:a", "slug", 1.0), "Big Uu": ("name:big uu", "raw", 0.5), "Nowhere": ("name:nowhere", "raw", 0.5)}


@pytest.mark.parametrize("n", [2, 4])
def test_prefixes_cover_ranges_exactly(n):
    rng = random.Random(n)
    for _ in range(200):
        a, b = sorted(rng.randrange(10**n) for _ in range(2))
        made = Y.digit_prefixes(str(a).zfill(n), str(b).zfill(n))
        assert [x for x in range(10**n) if any(str(x).zfill(n).startswith(p) for p in made)] == list(range(a, b + 1)) and len(made) <= 18 * n
    with pytest.raises(ValueError):
        Y.digit_prefixes("20", "1")


def test_longest_rule_places_a_code(spark):
    rules = [("23", None, 1, "English"), ("30", None, 3, "Mixed"), ("30.22", None, 1, "Classics"), ("30.2202", None, 0, "Other"), ("45", "46", 2, "Social"), ("45.06", None, 0, "Other")]
    codes = spark.createDataFrame([(c,) for c in ("23", "cip:23.0101", "30.01", "30.2201", "30.2202", "45.10", "46", "45.0603", "99", "", None, "xx")], "code string")
    got = {r.code: (r.level, r.within_1, r.within_2, r.within_3, r.grp) for r in Y.code_levels(codes, "code", rules).collect()}
    one, two, three, out = (lambda k: (k, k == 1, 0 < k <= 2, 0 < k <= 3)), None, None, (0, False, False, False, "Other")
    assert got["23"] == got["cip:23.0101"] == (*one(1), "English") and got["30.01"] == (*one(3), "Mixed") and got["30.2201"] == (*one(1), "Classics")
    assert got["45.10"] == got["46"] == (*one(2), "Social") and all(got[c] == out for c in ("30.2202", "45.0603", "99", "", None, "xx"))
    with pytest.raises(ValueError):
        Y.code_levels(codes, "code", [("1", None, 1, "a"), ("1", None, 2, "a")])


def test_cleaned_values_in_one_normal_form(spark):
    from wayline.functions.text import clean_values

    cases = {"ﬁne　text": "fine text", "it’s": "it's", "a\x07b\n c": "a b c", "２０２４": "2024", "e\u0301": "é", " ": None, "plain": "plain"}
    df = spark.createDataFrame([(v,) for v in [*cases, None]], "v string")
    assert {r.v: r.c for r in clean_values(df, "v", "c").collect()} == {**cases, None: None}
