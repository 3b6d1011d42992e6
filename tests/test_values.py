"""Values of fits, draws, networks, gates and panels against plain computations and hand-made cases."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from wayline.operators import evaluation as E
from wayline.operators import graphs as G
from wayline.operators import persons as R
from wayline.operators import statistics as M
from wayline.operators.components import connected_components
from wayline.plans import registry


def test_kmeans_cards_of_clear_groups(spark):
    rows = [(k, float(10 * (k % 3)) + (k % 7) / 100, float(-5 * (k % 3)) + (k % 5) / 100) for k in range(90)] + [(900, None, 1.0)]
    got = sorted((r.n, r.x, r.y) for r in M.kmeans_profiles(spark.createDataFrame(rows, "id int, x double, y double"), "id", ["x", "y"], 3).collect())
    want = sorted((30, round(float(np.mean([r[1] for r in rows[:90] if r[0] % 3 == g])), 6), round(float(np.mean([r[2] for r in rows[:90] if r[0] % 3 == g])), 6)) for g in range(3))
    assert got == want


def test_weak_labels_spread_to_their_side_only_when_sure(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(3 if k % 2 else -3, 0.5, 4)], (k % 2) if k < 40 else None, 1.0) for k in range(80)] + [(99, [0.0] * 4, None, 1.0)]
    got = {r.id: (r.predicted, r.confidence) for r in M.weak_label_classifier(spark.createDataFrame(rows, "id int, v array<double>, label int, w double"), "id", "v", "label", "w", 0.9).collect()}
    assert all(got[k][0] == k % 2 and got[k][1] >= 0.9 for k in range(80)) and got[99][0] is None and got[99][1] < 0.9


def vendi(vectors):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    p = np.linalg.eigvalsh(x @ x.T / len(x))
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def test_vendi_of_the_keys_drawn(spark):
    rng = np.random.default_rng(2)
    rows = [(g, k, rng.normal(size=5).tolist()) for g in "ab" for k in range(25 if g == "a" else 4)]
    got = {r.g: r for r in M.bootstrap_vendi(spark.createDataFrame(rows, "g string, id int, v array<double>"), "g", "id", "v", 6, 8).collect()}
    for g in "ab":
        of = {k: v for h, k, v in rows if h == g}
        each = [round(vendi([of[k] for k in sorted(of, key=lambda k: (hashlib.md5(f"{k}|{rep}".encode()).hexdigest(), k))[:6]]), 6) for rep in range(1, 9)]
        assert (got[g].replicates, got[g].mean) == (8, round(float(np.mean(each)), 6)) and abs(got[g].low - np.percentile(each, 2.5)) < 2e-6


def test_vectors_do_not_travel_with_every_replicate(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), "id", F.array(*(F.rand(k) for k in range(4))).alias("v"))
    plan = M.bootstrap_vendi(df, "g", "id", "v", 5, 10)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.split("\n") if "Generate explode" in line]
    assert exploded and "WindowGroupLimit" in M.bootstrap_vendi(df, "g", "id", "v", 5, 10)._jdf.queryExecution().executedPlan().toString()


def test_axes_count_persons_modes_and_coverage(spark):
    rows = [("p", "a", "b", "x", 1.0), ("p", "a", "b", "y", 3.0), ("q", "a", "b", "y", None), ("q", "a", "a", "x", 2.0), ("r", None, "b", "x", 9.0), ("r", "b", "a", "y", 1.0), ("s", "b", "a", "x", 1.0), (None, "b", "a", None, 1.0)]
    moves = spark.createDataFrame(rows, "person string, s string, t string, kind string, dwell double").withColumns({"u": F.upper("s"), "w": F.upper("t")})
    axes = {"low": ("s", "t"), "high": ("u", "w")}
    got = {(r.axis, r.src, r.dst): (r.weight, r.persons, r.dwell, r.modal, r.is_self_loop) for r in G.axis_networks(moves, axes, "person", {"dwell": F.col("dwell")}, {"modal": "kind"}).collect()}
    assert got["low", "a", "b"] == (3, 2, 2.0, "y", False) and got["high", "A", "A"] == (1, 1, 2.0, "x", True) and len(got) == 6
    assert got["low", "b", "a"] == (3, 2, 1.0, "x", False)  # x and y stand once each: the least
    assert sorted(map(tuple, G.axis_coverage(moves, axes).collect())) == [("high", 8, 7, 0.875), ("low", 8, 7, 0.875)]
    assert [r.coverage for r in G.axis_coverage(moves.limit(0), {"low": ("s", "t")}).collect()] == [0.0]


def gate(spark, review, head=((1, "A.B"), (2, "A.C"), (3, "M.X"), (4, "F"))):
    make = lambda rows: spark.createDataFrame(list(rows), "n int, code string")
    valid = make((0, c) for c in ("A", "A.B", "A.C", "M", "M.X", "F"))
    return E.head_gate(make(head), make(review), "n", "code", ["XUN", "XOT"], valid).first()


def test_gate_on_the_head_labels(spark):
    r = gate(spark, [(1, " a.b "), (2, "A.B"), (3, "xun"), (4, "F")])
    assert (r.reviews, r.unmatched, r.abstained, r.invalid, r.scored, r.level1, r.level2_n, r.level2, r.exact, r.passes) == (4, 0, 1, 0, 3, 1.0, 2, 0.5, 0.666667, True)
    r = gate(spark, [(1, "M.X"), (2, "A"), (3, "Q.Q"), (4, None)])
    assert (r.invalid, r.abstained, r.scored, r.level1, r.level2_n, r.passes) == (1, 1, 2, 0.5, 0, False)
    r = gate(spark, [(1, "A.B"), (77, "A.B")])
    assert (r.unmatched, r.scored, r.level1, r.passes) == (1, 1, 1.0, False)
    assert not gate(spark, [(3, "XOT")]).passes


def test_gold_is_judged_by_the_modal_row(spark):
    rows = [("hist", "BA", "jury", "54")] * 3 + [("hist", "MA", "jury", "23")] * 2 + [("gpa", "Advertising", "degree_type", "09"), ("summa", "BA", "jury", "53"), ("none", "BA", None, None), ("eng", "AA", "det", "14"), ("eng", "BB", "det", "15")]
    gold = [("hist", "t", "54", "23"), ("eng", "t", "15", "14"), ("gpa", "t", "XUN", None), ("summa", "t", "XUN", None), ("none", "t", "XUN", None), ("lost", "t", "11", None)]
    make = spark.createDataFrame
    r = E.gold_scores(make(rows, "text string, line string, source string, code string"), make(gold, "text string, tier string, gold_code string, gold_secondary string"), "text", "line", "source", "code", "tier", make([("54", 1), ("14", 3), ("15", 3), ("11", 2)], "code string, level int"), "XUN", ["jury"]).first()
    assert (r.n, r.graded, r.strict, r.lenient, r.gap, r.level, r.reach) == (6, 3, 0.333333, 0.666667, 0.333333, 0.666667, 0.666667)
    assert r.row_strict == round(4 / 7, 6) and (r.abstained, r.string_label, r.degree_line) == (1, 1, 1)


def test_nested_groups_do_not_give_small_cells_away(spark):
    people = [(k, "x" if k < 40 else "y", k % 40 < 20 or k == 20) for k in range(80)] + [(100, "z", True)] * 30
    df = spark.createDataFrame(people, "id int, cell string, inner boolean")
    got = {(r.grp, r.cell): (r.n, r.suppressed) for r in R.group_panels(df, {"all": F.lit(True), "in": F.col("inner")}, {"p": F.col("cell")}, 20, (("in", "all"),)).collect()}
    assert got["all", "x"] == (40, False) and got["in", "x"] == (None, True)  # 40 against 21: 19 stand outside
    assert got["in", "z"] == (30, False) and got["in", "y"] == (None, True)  # the next smallest goes with the only hidden one
    plain = {(r.grp, r.cell): r.n for r in R.group_panels(df, {"all": F.lit(True), "in": F.col("inner")}, {"p": F.col("cell")}, 20).collect()}
    assert plain["in", "x"] == 21


def test_stages_and_people_without_steps(spark):
    people = spark.createDataFrame([(1, 1990), (2, None), (3, 2050)], "id int, grad int")
    steps = spark.createDataFrame([(1, 10, "1995-01-01", "1999-01-01", 2, "a"), (1, 11, "1996-01-01", "2001-05-05", None, "b"), (1, 12, "1997-01-01", "2001-05-05", 1, "b")], "id int, row int, s string, e string, rank int, job string").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    got = {r.id: r for r in R.person_summary(people, steps, "id", "grad", "s", "e", "row", F.year("e") >= 2001, "rank", "job", ["job"], {"boss": 2}, [("early", 0), ("mid", 5)], 2000).collect()}
    one = got[1]
    assert (one.n_steps, one.n_employers, one.entry_year, one.has_current, one.ever_boss, one.first_job, one.current_job) == (3, 2, 1995, True, True, "a", "b")
    assert (one.career_years_entry, one.career_stage_entry, one.career_years_grad) == (5, "mid", 10)
    assert (got[2].n_steps, got[2].entry_year, got[2].has_current, got[2].first_job, got[2].career_stage_grad, got[3].career_years_grad) == (0, None, False, None, None, None)


def test_components_of_the_registered_table_by_union_find(spark, sf_dir):
    edges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for o, p in edges:
        a, b = sorted((top(o), top(p + 1000000000)))
        root[b] = a
    assert {r.node: r.component for r in registry.QUERIES["components"](spark, sf_dir).collect()} == {x: top(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
