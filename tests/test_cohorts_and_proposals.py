"""Proposals, cohorts and leaderboards by hand, and the bootstrap against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import canon, classifiers, cohorts, evaluation, proposals, statistics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vendi(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = np.linalg.eigvalsh(x.T @ x / len(x))
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def test_paired_bootstrap_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = [("a|b" if i % 2 else "c", i % 11, i, rng.normal(size=5).tolist(), rng.normal(size=3).tolist()) for i in range(80)]
    df = spark.createDataFrame(data, "g string, person long, role long, x array<double>, y array<double>")
    got = {(r.g, r.basis): r for r in statistics.paired_bootstrap(df, "g", "person", "role", ["x", "y"], 6, 4).collect()}
    md5 = lambda key, rep: hashlib.md5(f"{key}|{rep}|7".encode()).hexdigest()
    for g in ("a|b", "c"):
        mine = [r for r in data if r[0] == g]
        each = {"x": [], "y": []}
        for rep in range(1, 5):
            people = sorted({r[1] for r in mine}, key=lambda p: (md5(p, rep), p))[:6]
            chosen = [min((r for r in mine if r[1] == p), key=lambda r: (md5(r[2], rep), r[2])) for p in people]
            for basis, at in (("x", 3), ("y", 4)):
                each[basis].append(vendi(np.array([r[at] for r in chosen])))
        for basis, values in each.items():
            r = got[(g, basis)]
            assert (r.people, r.replicates) == (6, 4) and np.allclose([r["mean"], r.low, r.high], [np.mean(values), *np.percentile(values, [2.5, 97.5])], atol=2e-6)


def test_sensitivity_takes_the_smallest_pool(spark):
    data = [("a", i, i, [float(i + 1), 1.0]) for i in range(9)] + [("b", i, 100 + i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(data, "g string, person long, role long, x array<double>")
    got = rows(statistics.sensitivity(df, {"all": F.lit(True), "low": F.col("person") < 3, "none": F.lit(False)}, "g", "person", "role", ["x"], 6, 2).select("restriction", "g", "people"))
    assert got == [("all", "a", 4), ("all", "b", 4), ("low", "a", 3), ("low", "b", 3)]


def test_hybrid_codes_over_blocks_ties_and_missing_titles(spark):
    rng = np.random.default_rng(2)
    q = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for i in range(30)] + [(99, None, [1.0, 0.0, 0.0, 0.0])]
    names = [(f"c{i % 5}", rng.normal(size=4).tolist()) for i in range(40)]
    about = [(f"c{i}", rng.normal(size=4).tolist()) for i in range(6)]  # c5 has no title
    about.append(("c9", about[5][1]))  # equal to c5
    df = spark.createDataFrame(q, "id long, t array<double>, d array<double>")
    n, a = (spark.createDataFrame(x, "code string, v array<double>") for x in (names, about))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for rows_of_a_block in (1000, 7):
        got = {r.id: r for r in proposals.hybrid_codes(df, "id", "t", "d", n, a, "code", "v", F.col("id") % 3 == 0, rows_of_a_block).collect()}
        assert len(got) == 30
        for i, t, d in q[:30]:
            title = {c: max((round(float(unit(t) @ unit(v)), 9) for k, v in names if k == c), default=None) for c, _ in about}
            text = {c: round(float(unit(d) @ unit(v)), 9) for c, v in about}
            score = text if i % 3 == 0 else {c: round(title[c] + text[c], 9) for c in title if title[c] is not None}
            best = min(score, key=lambda c: (-score[c], c))
            assert got[i].code == best and got[i].title_term == title[best] and got[i].description_term == text[best]
    assert proposals.hybrid_codes(df.limit(0), "id", "t", "d", n, a, "code", "v").count() == 0


def test_nearest_by_words_needs_every_word(spark):
    q = spark.createDataFrame([(1, "Senior Data  analyst", [1.0, 0.0]), (2, "nurse", [0.0, 1.0]), (3, None, [1.0, 1.0])], "id long, name string, v array<double>")
    r = spark.createDataFrame([(10, "analyst", [0.0, 1.0]), (11, "data analyst", [1.0, 0.0]), (12, "data nurse", [0.0, 1.0]), (13, "", [1.0, 0.0]), (14, "unheard", [1.0, 0.0])], "id long, name string, v array<double>")
    assert rows(proposals.nearest_by_words(q, r, "id", "v", "name", 5)) == [(1, 10, 0.0, 2), (1, 11, 1.0, 1)]


def test_paths_break_at_unknown_years_and_hide_rare_ones(spark):
    people = [(i, y, s) for i in range(4) for y, s in ((2000, "a"), (2001, "a"), (2002, "b"), (2004, "c"))] + [(9, 2000, "a"), (9, 2001, "c"), (8, 2000, "a"), (8, 2001, None), (8, 2002, "c")]
    panel = spark.createDataFrame(people, "who long, y int, s string")
    members = panel.select("who").distinct().select("who", F.lit("g").alias("grp"), F.lit(2000).alias("anchor"))
    fans = spark.createDataFrame([("g", "c")], "grp string, state string")
    got = rows(cohorts.named_paths(members, panel, "who", "y", "s", 5, 2, 3, fans, 4, 1, 10))
    assert got == [("g", "a>b", 4, True, 1)]  # b to c and a to c lie across years without a state


def test_choices_of_members_without_rows(spark):
    members = spark.createDataFrame([("g", 1, 2000), ("h", 1, 2002), ("g", 2, 2000)], "grp string, who long, anchor int")
    done = spark.createDataFrame([(1, 2001, "x"), (1, 2005, "x"), (1, 2003, None)], "who long, y int, k string")
    got = rows(cohorts.choice_flags(members, done, "who", "y", {"early": (F.col("k") == "x", 0, 2), "ever": (F.col("k") == "x", 0, None)}))
    assert got == [("g", 1, True, True, 1, 1), ("g", 2, False, False, None, None), ("h", 1, False, True, None, 3)]


def test_leaderboard_turns_methods_to_the_anchor(spark):
    nodes = list(range(6))
    methods = {n: spark.createDataFrame([(i, float(f(i))) for i in nodes], "node long, score double") for n, f in (("down", lambda i: -i), ("flat", lambda i: 1.0), ("up", lambda i: i))}
    silver = spark.createDataFrame([(0, 3, 1), (4, 1, -1), (2, 5, -1)], "src long, dst long, truth int")
    anchor = spark.createDataFrame([(i, float(i * i)) for i in nodes], "node long, value double")
    ladders = spark.createDataFrame([(0, 1), (5, 4)], "low long, high long")
    got = {r.method: r for r in evaluation.ranking_leaderboard(methods, silver, anchor, ladders).collect()}
    for name in ("up", "down"):
        r = got[name]
        assert (r.coverage, r.accuracy, r.up_precision, r.down_precision, r.spearman, r.ladders_kept, r.ladders) == (1.0, 0.666667, 0.5, 1.0, 1.0, 1, 2)
    assert got["flat"].coverage == 0.0 and got["flat"].accuracy is None and got["flat"].ladders_kept == 0


def test_kappa_of_labels_that_never_vary(spark):
    df = spark.createDataFrame([("x", "x", 1), ("x", "x", 2)], "a string, b string, w int")
    assert rows(evaluation.kappa(df, "a", "b", F.col("w"))) == [(2, 1.0, 1.0)]


def test_threshold_falls_back_to_the_most_accurate(spark):
    sweep = spark.createDataFrame([(0.0, 1.0, 0.6), (0.1, 0.8, 0.7), (0.2, 0.5, 0.9), (0.3, 0.0, None)], "threshold double, coverage double, accuracy double")
    assert rows(statistics.recommended_threshold(sweep, 0.7)) == [(0.1, 0.8, 0.7, True)]
    assert rows(statistics.recommended_threshold(sweep, 0.95)) == [(0.2, 0.5, 0.9, False)]


def test_spectral_embedding_against_svd(spark):
    rng = np.random.default_rng(11)
    w = {(i, j): int(rng.integers(1, 30)) for i in range(14) for j in range(14) if i != j and rng.random() < 0.4}
    df = spark.createDataFrame([(i, j, x) for (i, j), x in w.items()], "src long, dst long, weight long")
    a = np.zeros((14, 14))
    for (i, j), x in w.items():
        a[i, j] = x
    norm = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1e-12)
    u, s, _ = np.linalg.svd(np.hstack([norm(a), norm(a.T)]))
    want = u[:, :3] * s[:3]
    want *= np.sign(want.sum(0))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.node: r.vector for r in classifiers.spectral_embedding(df, 3, spare=4).collect()}
    assert np.allclose([got[i] for i in range(14)], want, atol=2e-3)
    two = spark.createDataFrame([(1, 2, 5)], "src long, dst long, weight long")
    assert {r.node: len(r.vector) for r in classifiers.spectral_embedding(two, 4).collect()} == {1: 4, 2: 4}


def test_spectral_embedding_by_iteration(spark, monkeypatch):
    df = spark.createDataFrame([(i, j, 1 + (i * j) % 7) for i in range(9) for j in range(9) if i != j and (i + 2 * j) % 3], "src long, dst long, weight long")
    want = {r.node: r.vector for r in classifiers.spectral_embedding(df, 2).collect()}
    monkeypatch.setattr(classifiers, "WHOLE", 0)
    got = {r.node: r.vector for r in classifiers.spectral_embedding(df, 2, spare=6).collect()}
    assert np.allclose([got[i] for i in sorted(want)], [want[i] for i in sorted(want)], atol=2e-3)


def test_spectral_embedding_of_a_flat_spectrum(spark):
    rng, n = np.random.default_rng(5), 25
    a = np.where(np.eye(n, dtype=bool), 0, 20_000 + rng.integers(-150, 150, (n, n)))  # what many moves between all nodes look like
    df = spark.createDataFrame([(i, j, int(a[i, j])) for i in range(n) for j in range(n) if i != j], "src long, dst long, weight long")
    norm = lambda m: m / m.sum(1, keepdims=True)
    u, s, _ = np.linalg.svd(np.hstack([norm(a), norm(a.T)]))
    want = u[:, :4] * s[:4]
    want *= np.sign(want.sum(0))
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.node: r.vector for r in classifiers.spectral_embedding(df, 4).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-4)


def test_locations_of_odd_forms(spark):
    values = [("Paris, TX, United States Area",), ("tx",), ("TX",), ("Dallas Metroplex",), (None,), ("a, b",), ("Canada, ",), (",",), ("Texas Metro Area, US",)]
    df = spark.createDataFrame(values, "v string")
    known = {"united states": "US", "us": "US", "canada": "CA"}, {"texas": "TX"}
    parsed = canon.parse_location(F.col("v"), *known, "US", {"dallas": ("dallas", "TX")}, {}, ["remote"])
    got = {r.v: tuple(r)[1:] for r in df.withColumns(parsed).collect()}
    assert got["Paris, TX, United States Area"] == ("US", "TX", "paris", "city_state_country", 1.0)
    assert got["tx"][3] == "unparsed" and got["TX"] == ("US", "TX", None, "state", 1.0)
    assert got["Dallas Metroplex"] == ("US", "TX", "dallas", "metro", 0.95)
    assert got[None][3:] == ("empty", 0.0) and got["a, b"][3] == got[","][3] == "unparsed"
    assert got["Canada, "] == ("CA", None, None, "country", 1.0) and got["Texas Metro Area, US"] == ("US", "TX", None, "state_country", 1.0)
