"""Neighbours by word sets: every row of the table is a query, and sets just at the bound are found."""

from pyspark.sql import functions as F

from wayline.operators import joins
from wayline.plans import registry


def test_every_part_has_its_neighbours(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("w"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("n"))
    rows = [(r.p_partkey, r.n, set(r.w.split(" "))) for r in parts.collect()]
    want = set()
    for i, x, a in rows:
        near = sorted((-len(a & b) / len(a | b), j) for j, y, b in rows if x != y and len(a & b) / len(a | b) >= 0.5)[:3]
        want |= {(i, j, round(-s, 6), k) for k, (s, j) in enumerate(near, 1)}
    got = {tuple(r) for r in registry.QUERIES["token_jaccard_topk"](spark, sf_dir).select("p_partkey_a", "p_partkey_b", "jaccard", "rank").collect()}
    assert got == want and any(i % 20 for i, *_ in got)  # only each 20th part had any before


def test_sets_just_at_a_bound_that_binary_fractions_miss(spark):
    a = [f"a{i:02}" for i in range(20)]  # 20 x 0.55 is 11.000000000000002
    rows = [(1, " ".join(a)), (2, " ".join(a[9:])), (3, " ".join(a[10:])), *((k, " ".join(a[9:] + [f"z{k}{i}" for i in range(40)])) for k in range(4, 8))]
    df = spark.createDataFrame(rows, "id int, name string")
    got = {(r.id_a, r.id_b) for r in joins.token_neighbours(df, df, "id", "name", 0.55, 2).collect()}
    assert {(1, 2), (2, 1), (2, 3), (3, 2)} <= got and (1, 3) not in got
