"""The rows that operators move and read, by Spark's own counts, and odd inputs of what bounds them."""

import numpy as np
import pytest
from conftest import plain
from pyspark.sql import functions as F

from wayline.operators import company, proposals


@pytest.fixture
def rows_out(spark):
    """Collect a table; its rows, and the rows that each operator of all runs it took gave out, as (operator's metric, rows)."""

    def run(make):
        store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
        bus.waitUntilEmpty()
        before = store.executionsCount()
        found = make().collect()
        bus.waitUntilEmpty()
        counts, runs = [], store.executionsList()
        for k in range(before, runs.size()):
            seen, metrics, values = {}, runs.apply(k).metrics(), store.executionMetrics(runs.apply(k).executionId()).iterator()
            while values.hasNext():
                pair = values.next()
                seen[pair._1()] = pair._2()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and m.accumulatorId() in seen:
                    counts.append(int(seen[m.accumulatorId()].replace(",", "")))
        return found, counts

    return run


def test_nearest_by_words_joins_sets_of_words_not_pairs_of_rows(spark, rows_out):
    df = spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "old plate").otherwise("plate").alias("name"), F.array(F.col("id") + 1.0, F.lit(300.0)).alias("v"))
    found, counts = rows_out(lambda: proposals.nearest_by_words(df, df.filter("id % 3 = 0"), "id", "v", "name", 2))
    assert len(found) == 1200
    assert 600 <= max(counts) < 6_000  # 90,000 pairs of rows fit


def test_nearest_by_words_of_odd_vectors_and_text_keys(spark):
    odd = [None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1.0, 2.0, 3.0], [], [-1.0, 0.5], [1e-200, 0.0]]
    rng = np.random.default_rng(1)
    people = [(f"q{i:02}", ("b a ", "A", "c  a b", "", None)[i % 5], odd[i // 5] if i < 40 else rng.normal(size=2).tolist()) for i in range(60)]
    df = spark.createDataFrame(people, "id string, name string, v array<double>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        n, m = np.linalg.norm(a), np.linalg.norm(b)
        return None if n == 0 or m == 0 else round(float(np.dot(a, b) / n / m), 9)

    sets = {i: set((n or "").lower().split()) for i, n, _ in people}
    for k in (1, 3, 70):
        want = []
        for i, _, v in people:
            near = [(cosine(v, w), j) for j, _, w in people if sets[j] and sets[j] <= sets[i]]
            near.sort(key=lambda x: (x[0] is None, -np.inf if x[0] is not None and np.isnan(x[0]) else -(x[0] or 0.0), x[1]))
            want += [(i, j, s, r) for r, (s, j) in enumerate(near[:k], 1)]
        got = [tuple(r) for r in proposals.nearest_by_words(df, df, "id", "v", "name", k).collect()]
        assert sorted(plain(r) for r in got) == sorted(plain(r) for r in want)


def test_company_values_read_the_rows_once(spark, rows_out):
    rows = spark.range(5000).select(F.concat(F.lit("Acme "), F.col("id") % 3).alias("name"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("id"), F.col("id") % 3)).alias("own"))
    found, counts = rows_out(lambda: company.company_values(company.company_vocabulary(rows, "name", "own"), []))
    assert {(r.value, r.company, r.confidence) for r in found} == {(f"Acme {k}", f"id:id{k}", 0.9) for k in range(3)}
    assert 1 <= counts.count(5000) < 12  # the steps of one scan, as parts of a write counted again; 108 where every use read the rows


def test_hybrid_codes_send_no_query_to_blocks_without_codes(spark, rows_out):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("code"), F.array(F.col("id") + 1.0, F.lit(900.0)).alias("v"))
    codes, titles = df.filter("id < 5"), df.filter("id % 2 = 0")
    found, counts = rows_out(lambda: proposals.hybrid_codes(df, "id", "v", "v", titles, codes, "code", "v", block_rows=10))
    assert len(found) == 2000
    assert max(counts) < 20_000  # 202,000 where every block of titles counted, with codes or not
