"""Survival, regression, agreement and diversity statistics. Sums run in Spark; only small systems reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.windows import average_percent_rank, correlation
from wayline.sources.scratch import discard, written


def kaplan_meier(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Per group and time: at risk, events, survival."""
    per = df.groupBy(group, time).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("d"))
    w = Window.partitionBy(group).orderBy(time)
    risk = F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing))
    out = per.withColumn("at_risk", risk)
    dead = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = F.when(F.col("d") < F.col("at_risk"), F.ln(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)
    s = F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return out.select(group, time, "at_risk", F.col("d").alias("events"), s.alias("survival"))


def median_survival(km: DataFrame, group: str, time: str) -> DataFrame:
    return km.groupBy(group).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(time))).alias("median"))


def cox(df: DataFrame, time: str, event: str, covariates: list[str], rounds: int = 15) -> dict[str, float]:
    """Coefficients by Newton's method, tied times by Efron's weights; an error if they still move after ``rounds``.

    Each round is one aggregation to rows per distinct time (counts and sums, no person data), then running sums.
    """
    k = len(covariates)
    beta = np.zeros(k)
    base = written(df.select(time, F.col(event).cast("int").alias("wl_e"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates))), "cox")
    for _ in range(rounds):
        r = F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
        moments = {"s0": r} | {f"s1_{i}": r * F.col(f"x{i}") for i in range(k)} | {f"s2_{i}_{j}": r * F.col(f"x{i}") * F.col(f"x{j}") for i in range(k) for j in range(i, k)}
        died = F.col("wl_e") == 1
        aggs = [F.sum(v).alias(n) for n, v in moments.items()] + [F.sum(F.when(died, v).otherwise(0.0)).alias(f"d{n}") for n, v in moments.items()]
        aggs += [F.sum(F.when(died, F.col(f"x{i}")).otherwise(0.0)).alias(f"dx{i}") for i in range(k)] + [F.sum("wl_e").alias("m")]
        per = base.groupBy(time).agg(*aggs)
        w = Window.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct time
        risk = per.select(time, "m", *(f"dx{i}" for i in range(k)), *(f"d{n}" for n in moments), *(F.sum(n).over(w).alias(n) for n in moments)).filter("m > 0")
        step = risk.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1))).withColumn("f", F.col("l") / F.col("m"))
        at = {n: F.col(n) - F.col("f") * F.col(f"d{n}") for n in moments}
        slope = [F.sum(F.col(f"dx{i}") / F.col("m") - at[f"s1_{i}"] / at["s0"]).alias(f"g{i}") for i in range(k)]
        curve = [F.sum(at[f"s2_{i}_{j}"] / at["s0"] - at[f"s1_{i}"] * at[f"s1_{j}"] / (at["s0"] * at["s0"])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        row = step.agg(*slope, *curve).first()
        g = np.array([row[f"g{i}"] or 0.0 for i in range(k)])
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        move = np.linalg.solve(h + 1e-12 * np.eye(k), g)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            discard(base)
            return dict(zip(covariates, map(float, beta), strict=True))
    raise RuntimeError(f"coefficients still move by {np.abs(move).max()} after {rounds} rounds")


def wls_clustered(df: DataFrame, y: str, xs: list[str], weight: str, cluster: str) -> list[tuple[str, float, float]]:
    """(term, coefficient, cluster-robust error): normal equations and per-cluster scores are sums; a small solve is left."""
    names = ["intercept", *xs]
    rows = df.select(cluster, F.col(y).cast("double").alias("wl_y"), F.col(weight).cast("double").alias("wl_w"), F.lit(1.0).alias("c0"), *(F.col(x).cast("double").alias(f"c{i + 1}") for i, x in enumerate(xs)))
    k = len(names)
    sums = [F.sum(F.col("wl_w") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("wl_w") * F.col(f"c{i}") * F.col("wl_y")).alias(f"b{i}") for i in range(k)]
    total = rows.agg(*sums).first()
    a = np.array([[total[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    beta = np.linalg.solve(a, np.array([total[f"b{i}"] for i in range(k)]))
    rest = F.col("wl_y") - sum((F.lit(float(b)) * F.col(f"c{i}") for i, b in enumerate(beta)), F.lit(0.0))
    scores = rows.groupBy(cluster).agg(*(F.sum(F.col("wl_w") * F.col(f"c{i}") * rest).alias(f"u{i}") for i in range(k)))
    meat = scores.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), F.count("*").alias("g")).first()
    m = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(a)
    cover = inverse @ m @ inverse * meat["g"] / max(meat["g"] - 1, 1)
    return [(n, float(b), float(np.sqrt(max(v, 0.0)))) for n, b, v in zip(names, beta, np.diag(cover), strict=True)]


def kmeans_profiles(df: DataFrame, key: str, features: list[str], k: int, seed: int = 7) -> DataFrame:
    """Standardised k-means; one card per cluster: size and mean of every feature."""
    rows = written(df.na.drop(subset=features).select(key, *features), "features")  # every pass of the fits reads the files
    v = VectorAssembler(inputCols=features, outputCol="wl_raw").transform(rows)
    v = StandardScaler(inputCol="wl_raw", outputCol="wl_v", withMean=True).fit(v).transform(v)
    labelled = KMeans(k=k, seed=seed, featuresCol="wl_v", predictionCol="cluster").fit(v).transform(v)
    return labelled.groupBy("cluster").agg(F.count(key).alias("n"), *(F.round(F.avg(f), 6).alias(f) for f in features))


def weak_label_classifier(df: DataFrame, key: str, vector: str, label: str, weight: str, floor: float) -> DataFrame:
    """Multinomial logistic regression on labelled rows; every row's label if its probability reaches the floor."""
    v = df.withColumn("wl_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = LogisticRegression(featuresCol="wl_v", labelCol=label, weightCol=weight, maxIter=30, regParam=0.01).fit(v.filter(F.col(label).isNotNull()))
    p = vector_to_array(F.col("probability"))
    out = model.transform(v).withColumn("wl_p", F.array_max(p))
    return out.select(key, F.when(F.col("wl_p") >= floor, F.col("prediction").cast("int")).alias("predicted"), F.round("wl_p", 6).alias("confidence"))


def _elements(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("wl_i", "wl_x"))


def unit(vector: str) -> Column:
    """The vector scaled to length 1."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / length)


def within_spread(df: DataFrame, entity: str, vector: str) -> DataFrame:
    """Mean pairwise cosine distance of an entity's k unit vectors: 1 - (|sum|^2 - k) / (k (k - 1)), without pairs."""
    sums = _elements(df.withColumn("wl_u", unit(vector)), "wl_u", [entity]).groupBy(entity, "wl_i").agg(F.sum("wl_x").alias("s"), F.count("*").alias("k"))
    per = sums.groupBy(entity).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("k").alias("k")).filter("k > 1")
    return per.select(entity, "k", F.round(1 - (F.col("q") - F.col("k")) / (F.col("k") * (F.col("k") - 1)), 6).alias("spread"))


def vendi(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Effective number of vectors per group: exp of the entropy of the eigenvalues of the d x d second moments.

    The moments are a sum per group and pair of dimensions; a group's small matrix is what one task decomposes.
    """
    def partial(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                for g, part in pdf.groupby("g", sort=False):
                    x = np.stack(part["v"].to_numpy())
                    yield pd.DataFrame({"g": [g], "n": [len(x)], "m": [(x.T @ x).ravel().tolist()]})

    g_type = df.schema[group].dataType.simpleString()
    parts = df.select(F.col(group).alias("g"), unit(vector).alias("v")).mapInPandas(partial, f"g {g_type}, n long, m array<double>")

    def finish(pdf):
        import pandas as pd

        n = pdf["n"].sum()
        m = np.sum(np.stack(pdf["m"].to_numpy()), axis=0)
        side = int(round(len(m) ** 0.5))
        p = np.linalg.eigvalsh(m.reshape(side, side) / n)
        p = p[p > 1e-12]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [n], "vendi": [round(float(np.exp(-(p * np.log(p)).sum())), 6)]})

    return parts.groupBy("g").applyInPandas(finish, f"g {g_type}, n long, vendi double").withColumnRenamed("g", group)


def bootstrap_vendi(df: DataFrame, group: str, key: str, vector: str, n: int, replicates: int) -> DataFrame:
    """Vendi of ``n`` vectors per group drawn by a hash of key and replicate: mean and a 95 % interval."""
    # Keys are drawn alone (Spark keeps each task's first n before the exchange); vectors join the few that are drawn.
    rep = df.select(group, key, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    w = Window.partitionBy(group, "rep").orderBy(F.md5(F.concat_ws("|", key, "rep")), key)
    few = rep.withColumn("wl_rn", F.row_number().over(w)).filter(F.col("wl_rn") <= n).drop("wl_rn")
    drawn = few.join(df.select(group, key, vector), [group, key])
    drawn = drawn.withColumn("wl_g", F.concat_ws("|", group, "rep"))
    each = vendi(drawn, "wl_g", vector).withColumn(group, F.split_part("wl_g", F.lit("|"), F.lit(1)))
    return each.groupBy(group).agg(F.count("*").alias("replicates"), F.round(F.avg("vendi"), 6).alias("mean"), F.round(F.percentile("vendi", 0.025), 6).alias("low"), F.round(F.percentile("vendi", 0.975), 6).alias("high"))


def paired_bootstrap(df: DataFrame, group: str, person: str, role: str, bases: list[str], n: int, replicates: int, salt: str = "7") -> DataFrame:
    """Vendi of every basis over the same draws: ``n`` people of a group, one role of each; ``people``, mean and 95 % interval.

    People and roles are drawn by hashes of their keys, the replicate and the salt, so that bases share the draws and every
    run draws alike. A group of fewer than ``n`` people is drawn whole. Rows without a vector in any basis are left out.
    """
    rows = df.dropna(subset=[group, person, role, *bases])
    drawn = lambda c: F.md5(F.concat_ws("|", F.col(c).cast("string"), "rep", F.lit(salt)))
    people = rows.select(group, person).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = Window.partitionBy(group, "rep").orderBy(drawn(person), person)
    people = people.withColumn("wl_rn", F.row_number().over(w)).filter(F.col("wl_rn") <= n).drop("wl_rn")
    one = people.join(rows.select(group, person, role, *bases), [group, person]).groupBy(group, "rep", person).agg(F.min_by(F.struct(*bases), F.struct(drawn(role), F.col(role))).alias("v"))
    long = one.select(group, "rep", F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), F.col(f"v.{b}").cast("array<double>").alias("x")) for b in bases))).alias("e"))
    draws = F.struct(F.col(group).alias("g"), "rep", F.col("e.basis").alias("basis"))
    each = vendi(long.select(F.to_json(draws).alias("wl_g"), F.col("e.x").alias("x")), "wl_g", "x")
    each = each.select(F.from_json("wl_g", f"g {df.schema[group].dataType.simpleString()}, basis string").alias("k"), "n", "vendi")
    return each.groupBy(F.col("k.g").alias(group), F.col("k.basis").alias("basis")).agg(
        F.max("n").alias("people"), F.count("*").alias("replicates"), F.round(F.avg("vendi"), 6).alias("mean"), F.round(F.percentile("vendi", 0.025), 6).alias("low"), F.round(F.percentile("vendi", 0.975), 6).alias("high")
    )


def sensitivity(df: DataFrame, restrictions: dict[str, Column], group: str, person: str, role: str, bases: list[str], n: int, replicates: int) -> DataFrame:
    """``paired_bootstrap`` on the rows of each restriction, with the same number of people in every group: the smallest's, at most ``n``."""
    out = None
    for name, holds in restrictions.items():
        kept = df.filter(holds)
        least = kept.dropna(subset=[group, person, role, *bases]).groupBy(group).agg(F.count_distinct(person).alias("k")).agg(F.min("k")).first()[0] or 0
        one = paired_bootstrap(kept, group, person, role, bases, min(n, least), replicates).withColumn("restriction", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_percent_rank(average_percent_rank(df.dropna(subset=[x, y]), [], x, "wl_rx"), [], y, "wl_ry")
    return ranked.agg(F.count("*").alias("n"), F.round(correlation("wl_rx", "wl_ry"), 6).alias("spearman"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings beyond chance, from the contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    index = cells.agg(F.sum(pairs(F.col("n"))).alias("i"), F.sum("n").alias("t"))
    row = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("x"))
    col = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("y"))
    expected = F.col("x") * F.col("y") / pairs(F.col("t"))
    return index.join(row).join(col).select(F.round((F.col("i") - expected) / ((F.col("x") + F.col("y")) / 2 - expected), 6).alias("ari"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Coverage, accuracy, up and down precision of signs of a score beyond each threshold; truth is 1 or -1."""
    grid = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    call = F.when(F.col(score) > F.col("threshold"), 1).when(F.col(score) < -F.col("threshold"), -1)
    hit = grid.withColumn("call", call).groupBy("threshold").agg(
        F.count("*").alias("n"), F.count("call").alias("called"), F.count_if(F.col("call") == F.col(truth)).alias("right"),
        F.count_if(F.col("call") == 1).alias("up"), F.count_if((F.col("call") == 1) & (F.col(truth) == 1)).alias("up_right"),
        F.count_if(F.col("call") == -1).alias("down"), F.count_if((F.col("call") == -1) & (F.col(truth) == -1)).alias("down_right"),
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return hit.select("threshold", ratio("called", "n").alias("coverage"), ratio("right", "called").alias("accuracy"), ratio("up_right", "up").alias("up_precision"), ratio("down_right", "down").alias("down_precision"))


def recommended_threshold(sweep: DataFrame, target: float) -> DataFrame:
    """The least threshold whose accuracy reaches the target, else that of greatest accuracy; ``meets_target`` tells which."""
    meets = F.coalesce(F.col("accuracy") >= target, F.lit(False))
    order = F.struct((~meets).alias("m"), F.when(meets, 0.0).otherwise(-F.coalesce("accuracy", F.lit(-1.0))).alias("a"), "threshold", "coverage", "accuracy")
    return sweep.agg(F.min(order).alias("b")).select("b.threshold", "b.coverage", "b.accuracy", (~F.col("b.m")).alias("meets_target"))
