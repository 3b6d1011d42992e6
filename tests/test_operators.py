"""Golden fixtures and closed-form cases of the operators that SQL cannot check."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions.text import fold, match_key, token_key
from wayline.operators import aggregates, canon, graphs, joins, statistics, trajectories, windows
from wayline.operators.components import connected_components
from wayline.sources import records, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_interval_steps_golden(spark):
    raw = spark.createDataFrame(
        [(1, "Jan 2018", "Mar 2019"), (2, "2018", "2019"), (3, "Feb 2020", "Present"), (4, "May 2021", "Jan 2020"), (5, "soon", "2020"), (6, None, None)],
        "id int, s string, e string",
    )
    got = {r.id: r for r in trajectories.interval_steps(raw, "s", "e", "Present", "2022-06-30").collect()}
    assert str(got[1].start_dt) == "2018-01-01" and str(got[1].end_dt) == "2019-03-31" and got[1].tenure_months == 15
    assert got[2].granularity == "year" and str(got[2].end_dt) == "2019-12-31"
    assert got[3].is_ongoing and str(got[3].end_dt) == "2022-06-30"
    assert got[4].bad_negative_duration and got[4].tenure_months is None
    assert not got[5].datable and not got[6].datable


def test_transitions_gap_and_overlap(spark):
    steps = spark.createDataFrame([("p", 1, "2018-01-01", "2018-03-31"), ("p", 2, "2018-06-01", "2019-01-31"), ("p", 3, "2018-12-01", "2019-12-31"), ("q", 4, "2018-01-01", "2018-02-28")], "who string, id int, s string, e string")
    steps = steps.withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    got = rows(trajectories.transitions(steps, "who", "id", "s", "e", []).select("from_id", "to_id", "gap_months", "overlap_months"))
    assert got == [(1, 2, 2, 0), (2, 3, 0, 2)]


def test_suppression_hides_a_second_cell(spark):
    cells = spark.createDataFrame([("a", "x", 3), ("a", "y", 30), ("a", "z", 40), ("b", "x", 3), ("b", "y", 4), ("c", "x", 50)], "g string, k string, n int")
    got = {(r.g, r.k): r.suppressed for r in aggregates.suppress(cells, ["g"], "n", 10, "k").collect()}
    assert got == {("a", "x"): True, ("a", "y"): True, ("a", "z"): False, ("b", "x"): True, ("b", "y"): True, ("c", "x"): False}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_components_send_each_link_once_and_fewer_each_round(spark, monkeypatch):
    import random

    from wayline.operators import components

    sizes, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: (out := write(df, name), name == "links" and sizes.append(out.count()))[0])
    rng = random.Random(4)
    edges = list({tuple(sorted(rng.sample(range(400), 2))) for _ in range(500)})
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert got == union_find(edges)
    assert sizes[0] == len(edges) and sizes[-1] == 0 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:]))


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.fixture(scope="module")
def ring(spark):
    e = [(0, 1, 5), (1, 2, 3), (2, 0, 1), (2, 3, 4), (3, 1, 2), (3, 3, 9), (4, 0, 2)]
    return e, spark.createDataFrame([(a, b, w, a == b) for a, b, w in e], "src long, dst long, weight long, is_self_loop boolean")


def dense(e, n=5):
    a = np.zeros((n, n))
    for i, j, w in e:
        a[i, j] += w * (i != j)
    return a


def test_pagerank_against_dense(ring):
    e, df = ring
    a = dense(e)
    p = a / a.sum(1, keepdims=True)
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.03 + 0.85 * (r @ p)
    got = dict(rows(graphs.pagerank(df, tolerance=1e-7)))
    assert np.allclose([got[i] for i in range(5)], r, atol=2e-5) and math.isclose(sum(got.values()), 1, abs_tol=1e-9)


def test_springrank_against_solve(ring):
    e, df = ring
    a = dense(e)
    left = np.diag(1 + a.sum(0) + a.sum(1)) - a - a.T
    want = np.linalg.solve(left, a.sum(0) - a.sum(1))
    got = dict(rows(graphs.springrank(df, 1.0, 1e-10)))
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-6)


def test_hits_against_power_iteration(ring):
    e, df = ring
    a = dense(e)
    h = np.ones(5)
    for _ in range(300):
        auth = a.T @ h
        auth /= auth.max()
        h = a @ auth
        h /= h.max()
    got = {r.node: (r.hub, r.authority) for r in graphs.hits(df, 1e-9, 80).collect()}
    assert np.allclose([got[i][0] for i in range(5)], h, atol=1e-4) and np.allclose([got[i][1] for i in range(5)], auth, atol=1e-4)


def test_label_propagation_finds_two_cliques(spark):
    e = [(a, b, 5) for c in (0, 10) for a in range(c, c + 4) for b in range(a + 1, c + 4)] + [(3, 10, 1)]
    df = spark.createDataFrame([(a, b, w, False) for a, b, w in e], "src long, dst long, weight long, is_self_loop boolean")
    labels = graphs.label_propagation(df)
    got = dict(rows(labels))
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[0] != got[10]
    assert graphs.modularity(df, labels).first().modularity > 0.4


def test_cox_against_direct_maximum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    t = np.ceil(rng.exponential(np.exp(-0.7 * x)) * 6)
    e = rng.random(300) < 0.8

    def slope(b):
        total = 0.0
        for at in np.unique(t[e]):
            risk, dead = t >= at, (t == at) & e
            r, m = np.exp(b * x), dead.sum()
            for k in range(m):
                s0 = r[risk].sum() - k / m * r[dead].sum()
                s1 = (r * x)[risk].sum() - k / m * (r * x)[dead].sum()
                total -= s1 / s0
            total += x[dead].sum()
        return total

    low, high = -3.0, 3.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    df = spark.createDataFrame([(float(a), bool(b), float(c)) for a, b, c in zip(t, e, x)], "t double, e boolean, x double")
    assert math.isclose(statistics.cox(df, "t", "e", ["x"])["x"], low, abs_tol=1e-6)


def test_wls_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, g, w = rng.normal(size=200), rng.integers(0, 12, 200), rng.random(200) + 0.5
    y = 2 + 3 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, x, w, g)], "y double, x double, w double, g int")
    got = {n: (b, s) for n, b, s in statistics.wls_clustered(df, "y", ["x"], "w", "g")}
    m = np.stack([np.ones(200), x], 1)
    a = m.T @ (m * w[:, None])
    beta = np.linalg.solve(a, m.T @ (w * y))
    u = m * (w * (y - m @ beta))[:, None]
    s = np.stack([u[g == k].sum(0) for k in np.unique(g)])
    cover = np.linalg.inv(a) @ (s.T @ s) @ np.linalg.inv(a) * len(s) / (len(s) - 1)
    assert np.allclose([got["intercept"][0], got["x"][0]], beta) and np.allclose([got["intercept"][1], got["x"][1]], np.sqrt(np.diag(cover)))


def test_vendi_of_orthogonal_and_equal_vectors(spark):
    eye = [("o", [float(i == j) for j in range(4)]) for i in range(4)] + [("e", [1.0, 2.0, 0.0, 0.0])] * 5
    got = {r.g: r.vendi for r in statistics.vendi(spark.createDataFrame(eye, "g string, v array<double>"), "g", "v").collect()}
    assert math.isclose(got["o"], 4, abs_tol=1e-5) and math.isclose(got["e"], 1, abs_tol=1e-5)


def test_within_spread_is_the_mean_of_pairs(spark):
    v = np.random.default_rng(0).normal(size=(6, 3))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([1 - u[i] @ u[j] for i in range(6) for j in range(i)])
    df = spark.createDataFrame([("a", r.tolist()) for r in v] + [("b", [1.0, 0.0, 0.0])], "g string, v array<double>")
    assert rows(statistics.within_spread(df, "g", "v")) == [("a", 6, round(float(want), 6))]


def test_springrank_query_solves_the_whole_trade_graph(spark, sf_dir, duck):
    from wayline.plans import registry

    a = np.zeros((25, 25))
    for i, j, w in duck.execute("SELECT c_nationkey, s_nationkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL").fetchall():
        a[i, j] = w
    out, into = a.sum(1), a.sum(0)
    live = out + into > 0
    want = np.linalg.solve(np.eye(25) + np.diag(out + into) - a - a.T, into - out)
    got = dict(rows(registry.QUERIES["springrank"](spark, sf_dir)))
    assert len(got) == live.sum() and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_loops_that_do_not_converge_fail(ring):
    for stopped in (lambda: graphs.hits(ring[1], 0.0, 1), lambda: graphs.springrank(ring[1], 1.0, 1e-9, 2)):
        with pytest.raises(RuntimeError):
            stopped()


def test_typo_clusters(spark):
    v = spark.createDataFrame([("marketing", 90), ("marketting", 3), ("markting", 1), ("accounting", 50), ("sales", 7)], "v string, n long")
    got = dict(rows(canon.typo_clusters(v, "v", "n", 2)))
    assert got["marketting"] == got["markting"] == "marketing" and got["accounting"] == "accounting" and got["sales"] == "sales"


def test_typo_clusters_read_their_source_once(spark):
    seen = spark.sparkContext.accumulator(0)
    value = F.udf(lambda v: (seen.add(1), v)[1])
    v = spark.createDataFrame([("marketing", 90), ("marketting", 3), ("sales", 7)], "v string, n long").withColumn("v", value("v"))
    assert dict(rows(canon.typo_clusters(v, "v", "n", 1))) == {"marketing": "marketing", "marketting": "marketing", "sales": "sales"}
    assert seen.value == 3


def test_match_keys_fold_accents_and_keep_symbols(spark):
    df = fold(spark.createDataFrame([("Été & C++",), ("ﬁnance",), (None,), ("",)], "v string"), "v", "f")
    got = {r.v: (r.k, r.t) for r in df.select("v", match_key(F.col("f")).alias("k"), token_key(match_key(F.col("f"))).alias("t")).collect()}
    assert got["Été & C++"] == ("ete and c++", "and c++ ete") and got["ﬁnance"][0] == "finance" and got[""][0] == ""


def test_records_skip_bad_lines(spark, tmp_path):
    spec = records.Record("r", "id", (records.Field("n", "bigint"), records.Field("city", path="home.city")), (records.Child("job", "jobs", (records.Field("title"),), (records.Child("role", "roles", (records.Field("name"),)),)), records.Child("note", "notes")))
    (tmp_path / "a.jsonl").write_text('{"id":"a","n":"1,234","home":{"city":"X"},"jobs":[{"title":"t","roles":[{"name":"r"}]}],"notes":["p","q"]}\n\n{"id":"b"\n[1]\n{"id":"c","n":true,"jobs":null}\n')
    (tmp_path / "skip.txt").write_text("{}")
    parsed = records.read_lines(spark, str(tmp_path), spec)
    assert parsed.filter("bad").count() == 2 and parsed.filter("not bad").count() == 2
    assert rows(records.parent_table(parsed, spec)) == [("a", 1234, "X"), ("c", None, None)]
    assert rows(records.child_table(parsed, spec, "job", "role")) == [("a", 0, 0, "r")]
    assert rows(records.child_table(parsed, spec, "note")) == [("a", 0, "p"), ("a", 1, "q")]


def test_sinks_replace_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.replace_table(spark.range(5).toDF("x"), path)["rows"] == 5
    assert sinks.replace_table(spark.range(3).toDF("x"), path)["rows"] == 3
    assert spark.read.parquet(path).count() == 3
    sinks.append_cache(spark.createDataFrame([("k", 1, 1)], "k string, at int, v int"), str(tmp_path / "c"))
    sinks.append_cache(spark.createDataFrame([("k", 2, 5)], "k string, at int, v int"), str(tmp_path / "c"))
    cache = spark.read.json(str(tmp_path / "c"), schema="k string, at int, v int")
    assert rows(records.latest_per_key(cache, ["k"], ["at"])) == [("k", 2, 5)]
    assert records.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_nearest_vectors_equal_brute_force(spark):
    v = np.random.default_rng(5).normal(size=(60, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r.query, r.rank): r.neighbour for r in joins.nearest_vectors(df, df, "id", "v", 3, block_rows=11).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i in range(60):
        assert [got[(i, k)] for k in (1, 2, 3)] == np.argsort(-s[i])[:3].tolist()


def test_row_order_and_partitions_do_not_matter(spark, sf_dir):
    from wayline.operators.windows import collapse_runs

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = rows(collapse_runs(events, "user_id", ["ts", "event_id"], "event_type", "error"))
    assert rows(collapse_runs(events.orderBy(F.rand(3)).repartition(7), "user_id", ["ts", "event_id"], "event_type", "error")) == one


def union_find(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def test_components_of_the_whole_table(spark, sf_dir):
    from wayline.plans import registry

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    got = dict(rows(registry.QUERIES["components"](spark, sf_dir)))
    assert got == union_find((r.l_orderkey, r.l_partkey + 1000000000) for r in lines)


@pytest.mark.parametrize("e", [[(0, 1, 1)], [(i, i + 1, 1) for i in range(9)], [(0, 1, 2), (1, 2, 3), (0, 2, 1), (5, 6, 4), (7, 6, 1), (7, 7, 3)]], ids=["edge", "path", "two"])
def test_trophic_levels_against_least_squares(spark, e):
    df = spark.createDataFrame([(a, b, w, a == b) for a, b, w in e], "src long, dst long, weight long, is_self_loop boolean")
    got = {r.node: r.level for r in graphs.trophic_levels(df, connected_components(df, "src", "dst")).collect()}
    a = dense(e, 10)
    want = np.linalg.lstsq(np.diag(a.sum(0) + a.sum(1)) - a - a.T, a.sum(0) - a.sum(1), rcond=None)[0]
    groups = union_find((x, y) for x, y, _ in e)
    for top in set(groups.values()):
        nodes = [x for x in groups if groups[x] == top]
        assert np.allclose([got[x] for x in nodes], want[nodes] - want[nodes].mean(), atol=1e-6)


def test_solvers_say_when_they_do_not_converge(ring):
    with pytest.raises(RuntimeError):
        graphs.springrank(ring[1], rounds=2)


def test_agony_rank_against_its_recurrence(ring):
    e, df = ring
    a, s = dense(e), np.zeros(5)
    for _ in range(400):
        want = (a.T @ s + a.sum(0) + a @ s - a.sum(1)) / (a.sum(0) + a.sum(1))
        s = s / 2 + want / 2
        s -= s.mean()
    got = dict(rows(graphs.agony_rank(df, tolerance=1e-9, rounds=400)))
    assert np.allclose([got[i] for i in range(5)], s, atol=1e-6)


def test_label_spread_against_dense(ring, spark):
    e, df = ring
    a = dense(e)
    w = a + a.T
    d = w.sum(1)
    w = w / np.sqrt(d[:, None] * d[None, :])
    y = np.zeros((5, 2))
    y[0, 0] = y[3, 1] = 1
    f = y.copy()
    for _ in range(400):
        f = 0.8 * w @ f + 0.2 * y
    f /= f.sum(0)
    seeds = spark.createDataFrame([(0, 0), (3, 1)], "node long, class int")
    got = {r.node: (r["class"], r.score) for r in graphs.label_spread(df, seeds, tolerance=1e-9, rounds=300).collect()}
    assert all(got[i][0] == f[i].argmax() and math.isclose(got[i][1], f[i].max(), abs_tol=1e-6) for i in range(5))


def test_oriented_scores_rise_with_the_anchor(spark):
    scores = spark.createDataFrame([(i, -float(i), 10 * i) for i in range(10)], "node int, score double, support int")
    anchor = spark.createDataFrame([(1, 1), (5, 2), (9, 4), (3, None)], "node int, rank int")
    got = {r.node: r for r in graphs.oriented_scores(scores, anchor, "node", "score", "rank", "support").collect()}
    assert all(got[i].oriented == i and math.isclose(got[i].percentile, (i + 1) / 10) for i in range(10))
    assert got[9].confidence == 1.0 and math.isclose(got[4].confidence, 40 / 81)


def test_dominance_by_share_of_the_shorter(spark):
    steps = [("p", 1, "2018-01-01", "2019-12-31"), ("p", 2, "2019-06-01", "2020-03-31"), ("p", 3, "2019-12-01", "2020-12-31"), ("p", 4, "2018-01-01", "2019-12-31"), ("q", 5, "2018-01-01", "2018-01-10")]
    df = spark.createDataFrame(steps, "who string, id int, s string, e string").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    got = {r.id: r.dominated for r in joins.dominated_intervals(df, "who", "id", "s", "e", [F.datediff("e", "s")]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_transition_types_of_known_moves(spark):
    """Rows of the published regression cases: one pair of steps per person, and what the edge must be."""
    cases = [
        ("p1", ("employee", "id:1", None, 1, None, None), ("employee", "id:1", None, 2, None, None), "2018-12-31", "2019-01-01", "promotion", "up", "lateral", 0, False),
        ("p2", ("employee", "id:1", None, None, None, None), ("self_employed", "id:2", None, None, None, None), "2018-12-31", "2019-01-01", "into_self_employment", "unknown", "into_self_employment", 0, False),
        ("p3", ("self_employed", "id:1", None, None, None, None), ("retired", None, None, None, None, None), "2018-12-31", "2019-01-01", "exit", "unknown", "exit", 0, False),
        ("p4", ("employee", "id:1", None, 2, None, None), ("employee", "id:1", None, None, None, None), "2018-12-31", "2019-01-01", "lateral", "unknown", "lateral", 0, False),
        ("p5", ("employee", "id:1", None, 2, None, None), ("employee", "id:2", None, 1, None, None), "2018-01-31", "2018-04-01", "move", "down", "employer_move", 2, True),
        ("p7", ("employee", "id:1", "43", None, 0.1, 0.9), ("employee", "id:1", "11", None, 0.9, 0.8), "2018-12-31", "2019-01-01", "lateral", "unknown", "occupation_change_up", 0, False),
        ("p8", ("employee", "id:1", "43", None, 0.5, 0.2), ("employee", "id:2", "43", None, 0.9, 0.8), "2018-12-31", "2019-01-01", "move", "unknown", "employer_move", 0, False),
        ("p9", ("employee", "nonorg:x", None, None, 0.5, 0.5), ("employee", "nonorg:x", None, None, 0.2, 0.5), "2018-12-31", "2019-01-01", "move", "unknown", "employer_move_down", 0, False),
    ]
    names = ["employment", "company", "major", "ordinal", "score", "confidence"]
    steps = [(who, k, "2017-01-01" if k == 1 else start, end if k == 1 else "2020-01-31", *x) for who, a, b, end, start, *_ in cases for k, x in ((1, a), (2, b))]
    df = spark.createDataFrame(steps, "who string, id int, s string, e string, employment string, company string, major string, ordinal int, score double, confidence double")
    df = df.withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    got = {r.who: r for r in trajectories.transition_types(trajectories.transitions(df, "who", "id", "s", "e", names), *names).collect()}
    for who, _, _, _, _, kind, direction, fused, gap, has_gap in cases:
        r = got[who]
        assert (r.kind, r.direction, r.transition_type, r.gap_months, r.has_gap) == (kind, direction, fused, gap, has_gap), who
    assert got["p3"].transition_confidence == 0.95 and math.isclose(got["p7"].transition_confidence, 0.9)


def test_running_total_and_terciles_over_many_ranges(spark):
    values = [(i * 37 % 101, f"k{i}") for i in range(101)]
    df = spark.createDataFrame(values, "n int, k string").repartition(7)
    got = {r.k: r.tercile for r in windows.terciles(df, "n", "k").collect()}
    order = [k for _, k in sorted(values, key=lambda v: (-v[0], v[1]))]
    assert [got[k] for k in order] == [1] * 34 + [2] * 34 + [3] * 33
    share = {r.k: r.s for r in windows.running_share(df, "n", "k", "s").collect()}
    sums = np.cumsum([dict((k, n) for n, k in values)[k] for k in order])
    assert np.allclose([share[k] for k in order], sums / sums[-1], atol=1e-6)
    assert windows.terciles(df.limit(0), "n", "k").count() == 0


def test_fingerprint_sees_pairs_of_equal_rows(spark):
    one = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    two = spark.createDataFrame([(1,), (3,), (3,)], "x int")
    assert aggregates.fingerprint(one).first() == aggregates.fingerprint(one.repartition(3)).first() != aggregates.fingerprint(two).first()


@pytest.mark.parametrize("distance", [1, 2])
def test_typo_clusters_against_all_pairs(spark, distance):
    import random

    from wayline.operators import canon

    rng = random.Random(distance)
    base = ["planet", "castle", "engineer", "analyst", "ab"]
    words = set(base)
    for w in base:
        for _ in range(12):
            t = list(w)
            for _ in range(rng.randint(1, 3)):
                at, do = rng.randrange(len(t)), rng.random()
                t[at : at + 1] = [] if do < 0.3 else [rng.choice("aelnt"), t[at]] if do < 0.6 else [rng.choice("aelnt")]
                t = t or ["a"]
            words.add("".join(t))
    words = sorted(words)
    df = spark.createDataFrame([(w, 1000 - i) for i, w in enumerate(words)], "w string, n int")
    block = dict(rows(df.select("w", canon.soundex_block(F.col("w")))))

    def apart(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    top = union_find((a, b) for a in words for b in words if block[a] == block[b] and apart(a, b) <= distance)
    got = dict(rows(canon.typo_clusters(df, "w", "n", distance)))
    assert {w: min(x for x in words if got[x] == got[w]) for w in words} == top


def test_vector_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([c + rng.normal(0, 0.25, (9, 6)) for c in rng.normal(size=(5, 6))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    near = np.round(u @ u.T, 9) >= 0.9
    want = union_find((i, j) for i in range(45) for j in range(45) if near[i, j])
    for size in (7, 100):
        links = joins.similar_vector_links(df, "id", "v", 0.9, block_rows=size)
        got = dict(rows(connected_components(links, "a", "b")))
        assert {i: got.get(i, i) for i in range(45)} == want


def test_a_line_is_parsed_once(spark, sf_dir):
    from wayline.plans import registry

    for name in ("flatten_parent", "flatten_child", "flatten_grandchild", "flatten_scalar_list"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, name


def test_seeded_kmeans_against_lloyd(spark):
    from wayline.operators import composites

    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(0, 0.6, (20, 3)) for c in (np.zeros(3), np.full(3, 2.0), np.array([2.0, -2.0, 0.0]))])
    centres = x[[0, 20, 40]].copy()
    for _ in range(100):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == k].mean(0) for k in range(3)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    seeds = spark.createDataFrame([(k, [float(v) for v in x[20 * k]]) for k in range(3)], "label int, v array<double>")
    got = dict(rows(composites.seeded_kmeans(df, "id", "v", seeds, "label", rounds=60)))
    assert [got[i] for i in range(60)] == near.tolist()


def test_word_neighbours_of_texts_on_many_rows(spark):
    from wayline.operators import joins

    texts = ["red hot bolt", "hot bolt red", "red bolt", "blue nut", "red hot nut", None]
    both = [(i, texts[i % 6]) for i in range(60)]
    df = spark.createDataFrame(both, "id int, name string")
    found = joins.token_neighbours(df.filter("id % 7 = 0"), df, "id", "name", 0.5, 4)
    want = set()
    for i, x in both:
        near = []
        for j, y in both:
            if i % 7 == 0 and x and y and x != y:
                a, b = set(x.split()), set(y.split())
                if len(a & b) / len(a | b) >= 0.5:
                    near.append((-len(a & b) / len(a | b), j))
        want |= {(i, j, round(-s, 6), k + 1) for k, (s, j) in enumerate(sorted(near)[:4])}
    assert {(r.id_a, r.id_b, round(r.jaccard, 6), r["rank"]) for r in found.collect()} == want
    # A text is compared once, not for each of its rows.
    assert "Aggregate [name" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ladders_of_odd_rows(spark):
    from wayline.operators import composites

    df = spark.createDataFrame([(1, "Self employed", 7), (2, None, None), (3, " ACME ", None), (4, "Twin", None), (5, "x", 9)], "k int, name string, own int")
    cross = spark.createDataFrame([("acme", 11), ("acme", 11), ("twin", 1), ("twin", 2)], "match string, id int")
    got = {r.k: (r.company, r.company_method) for r in composites.company_ladder(df, "name", "own", {"^self": "self"}, cross).collect()}
    assert got == {1: ("nonorg:self", "placeholder"), 2: (None, None), 3: ("id:11", "crosswalk"), 4: ("raw:twin", "raw"), 5: ("id:9", "id")}
    changed = df.withColumn("own", F.when(F.col("k") == 5, 8).otherwise(F.col("own")))
    assert composites.unchanged(df, df.withColumn("more", F.lit(1))).first().unchanged and not composites.unchanged(df, changed).first().unchanged
