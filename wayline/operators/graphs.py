"""Weighted directed graphs as edge tables: nulls, backbones, ranks, communities.

Iterations are joins and aggregates over edges. State tables go through the shared folder every round, so lineage stays
short and a lost executor costs its own part; loops end at a tolerance that one aggregate per round measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.aggregates import top_value
from wayline.operators.windows import average_percent_rank, clip_confidence, correlation, z_scores
from wayline.sources.scratch import discard, written


def edge_table(df: DataFrame, src: Column, dst: Column, person: Column | None = None, era: Column | None = None) -> DataFrame:
    """Edges with ``weight``, distinct ``persons`` and ``is_self_loop``, per era if given."""
    keys = [src.alias("src"), dst.alias("dst")] + ([era.alias("era")] if era is not None else [])
    n = [F.count("*").alias("weight")] + ([F.count_distinct(person).alias("persons")] if person is not None else [])
    return df.filter(src.isNotNull() & dst.isNotNull()).groupBy(*keys).agg(*n).withColumn("is_self_loop", F.col("src") == F.col("dst"))


def axis_networks(moves: DataFrame, axes: dict[str, tuple[str, str]], person: str, means: dict[str, Column], modes: dict[str, str]) -> DataFrame:
    """Edges of several networks over the same moves: ``axis``, ``src``, ``dst``, ``weight``, ``persons``, ``is_self_loop``, a mean of each of ``means``, the commonest value of each of ``modes``.

    ``axes`` name the columns a move leads from and to; a move counts on the axes where it has both. Moves are read once and
    laid out by axis; persons and modes add up in two steps, so that a frequent edge is a row per person or value, not per
    move, when it is counted. Of equally common values the least is taken.
    """
    ends = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(x).cast("string").alias("src"), F.col(y).cast("string").alias("dst")) for a, (x, y) in axes.items())))
    measured = [c.cast("double").alias(f"wl_x{i}") for i, c in enumerate(means.values())]
    laid = moves.select(F.col(person).alias("wl_p"), *measured, *(F.col(c).alias(f"wl_m{i}") for i, c in enumerate(modes.values())), ends.alias("wl_e"))
    laid = laid.select("wl_e.*", *[c for c in laid.columns if c != "wl_e"]).filter("src is not null and dst is not null")
    edge = ["axis", "src", "dst"]
    each = [f(F.col(f"wl_x{i}")).alias(f"wl_{n}{i}") for i in range(len(means)) for n, f in (("s", F.sum), ("n", F.count))]
    per = laid.groupBy(*edge, "wl_p").agg(F.count("*").alias("w"), *each)
    out = per.groupBy(*edge).agg(F.sum("w").alias("weight"), F.count("wl_p").alias("persons"), *(F.try_divide(F.sum(f"wl_s{i}"), F.sum(f"wl_n{i}")).alias(n) for i, n in enumerate(means)))
    for i, n in enumerate(modes):
        out = out.join(top_value(laid, edge, f"wl_m{i}").select(*edge, F.col(f"wl_m{i}").alias(n)), edge, "left")
    return out.withColumn("is_self_loop", F.col("src") == F.col("dst"))


def axis_coverage(moves: DataFrame, axes: dict[str, tuple[str, str]]) -> DataFrame:
    """Per axis the ``moves`` in all, those ``kept`` (both ends known) and their share, counted in one pass."""
    kept = {a: F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) for a, (x, y) in axes.items()}
    one = moves.agg(F.count("*").alias("moves"), F.array(*(F.struct(F.lit(a).alias("axis"), k.alias("kept")) for a, k in kept.items())).alias("wl_a"))
    return one.select("moves", F.explode("wl_a").alias("a")).select("a.axis", "moves", "a.kept", F.round(F.coalesce(F.try_divide("a.kept", "moves"), F.lit(0.0)), 4).alias("coverage"))


def node_strengths(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per node: out and in strength and degree without self-loops, self-loop weight, net flow."""
    keys = keys or []
    out = edges.select(*keys, F.col("src").alias("node"), F.when(~F.col("is_self_loop"), F.col("weight")).alias("o"), F.lit(None).cast("long").alias("i"), F.when(F.col("is_self_loop"), F.col("weight")).alias("l"))
    into = edges.select(*keys, F.col("dst").alias("node"), F.lit(None).cast("long").alias("o"), F.when(~F.col("is_self_loop"), F.col("weight")).alias("i"), F.lit(None).cast("long").alias("l"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = out.unionByName(into).groupBy(*keys, "node").agg(total("o").alias("out_strength"), total("i").alias("in_strength"), F.count("o").alias("out_degree"), F.count("i").alias("in_degree"), total("l").alias("self_loops"))
    return s.withColumn("net_flow", F.col("in_strength") - F.col("out_strength"))


def gravity_null(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Non-loop edges with expected weight out x in / total, relative risk, z and transition probability."""
    keys = keys or []
    e = edges.filter(~F.col("is_self_loop"))
    out = e.groupBy(*keys, "src").agg(F.sum("weight").alias("wl_o"))
    into = e.groupBy(*keys, "dst").agg(F.sum("weight").alias("wl_i"))
    total = e.groupBy(*keys).agg(F.sum("weight").alias("wl_t"))
    j = e.join(out, [*keys, "src"]).join(into, [*keys, "dst"])
    j = j.join(total, keys) if keys else j.join(F.broadcast(total))
    expected = F.col("wl_o") * F.col("wl_i") / F.col("wl_t")
    return j.withColumns({"expected": expected, "rr": F.col("weight") / expected, "z": (F.col("weight") - expected) / F.sqrt(expected), "p": F.col("weight") / F.col("wl_o")}).drop("wl_o", "wl_i", "wl_t")


def disparity_backbone(edges: DataFrame, alpha: float) -> DataFrame:
    """Edges whose share of either end's strength is unlikely under a uniform split."""
    e = edges.filter(~F.col("is_self_loop"))
    out = e.groupBy("src").agg(F.sum("weight").alias("wl_so"), F.count("*").alias("wl_ko"))
    into = e.groupBy("dst").agg(F.sum("weight").alias("wl_si"), F.count("*").alias("wl_ki"))

    def chance(share: Column, degree: Column) -> Column:
        return F.when(degree > 1, F.pow(1 - share, degree - 1)).otherwise(1.0)

    j = e.join(out, "src").join(into, "dst")
    a = F.least(chance(F.col("weight") / F.col("wl_so"), F.col("wl_ko")), chance(F.col("weight") / F.col("wl_si"), F.col("wl_ki")))
    return j.withColumn("alpha", a).filter(F.col("alpha") < alpha).select("src", "dst", "weight", "alpha")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], value: str, tolerance: float, rounds: int) -> DataFrame:
    """Apply ``step`` (rows of node, value and ``was``) until no value moves by more than the tolerance; an error if one still does."""
    for _ in range(rounds):
        new = written(step(state), "state")
        moved = new.agg(F.max(F.abs(F.col(value) - F.col("was")))).first()[0] or 0.0
        state = new.drop("was")
        if moved <= tolerance:
            return state
    raise RuntimeError(f"{value} still moves by {moved} after {rounds} rounds")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, rounds: int = 200) -> DataFrame:
    """``node``, ``rank``: weighted, dangling mass spread evenly."""
    e = written(edges.filter(~F.col("is_self_loop")).select("src", "dst", "weight"), "edges")
    out = e.groupBy("src").agg(F.sum("weight").alias("s"))
    e = written(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("p")), "edges")
    nodes = _nodes(e)
    n = nodes.count()
    state = written(nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), "state")
    senders = e.select("src").distinct()

    def step(s: DataFrame) -> DataFrame:
        dangling = s.join(senders, s.node == senders.src, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        into = e.join(s, e.src == s.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("i"))
        joined = s.join(into, s.node == into.dst, "left").join(F.broadcast(dangling))
        new = (1 - damping) / n + damping * (F.coalesce("i", F.lit(0.0)) + F.col("d") / n)
        return joined.select("node", new.alias("rank"), F.col("rank").alias("was"))

    return _iterate(state, step, "rank", tolerance, rounds)


def hits(edges: DataFrame, tolerance: float = 1e-8, rounds: int = 60) -> DataFrame:
    """``node``, ``hub``, ``authority``, each scaled to a maximum of 1."""
    e = written(edges.filter(~F.col("is_self_loop")).select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    state = written(_nodes(e).select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "state")

    def scaled(df: DataFrame, c: str) -> DataFrame:
        return df.join(F.broadcast(df.agg(F.max(c).alias("wl_m")))).withColumn(c, F.coalesce(F.try_divide(c, "wl_m"), F.lit(0.0))).drop("wl_m")

    def step(s: DataFrame) -> DataFrame:
        auth = scaled(e.join(s, e.src == s.node).groupBy("dst").agg(F.sum(F.col("hub") * F.col("weight")).alias("a")), "a")
        hub = scaled(e.join(auth, "dst").groupBy("src").agg(F.sum(F.col("a") * F.col("weight")).alias("h")), "h")
        j = s.join(auth, s.node == auth.dst, "left").join(hub, s.node == hub.src, "left")
        return j.select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"), F.col("hub").alias("was"))

    return _iterate(state, step, "hub", tolerance, rounds)


def _pulls(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symmetric weights between nodes, and per node ``d`` (all weight) and ``k`` (weight in less weight out), without self-loops."""
    e = edges.filter(~F.col("is_self_loop")).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = e.select("src", "dst", "weight", F.lit(-1.0).alias("side")).union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1.0).alias("side")))
    both = written(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("side")).alias("pull")), "edges")
    return both, both.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d"), F.sum("pull").alias("k"))


def _spring_solution(edges: DataFrame, alpha: float, tolerance: float, rounds: int) -> DataFrame:
    """``node``, ``score`` of (alpha + D - A - A') s = k by conjugate gradients from zero; an error if the residual stays.

    A round is one product over the edges, written, and one aggregate of four sums; the loop ends where the residual's length
    is ``tolerance`` of the right side's. With alpha = 0 the right side sums to zero in every component, and so do the steps.
    """
    both, own = _pulls(edges)
    zero = F.lit(0.0)
    step = written(own.select("node", "d", zero.alias("score"), F.col("k").alias("r"), F.col("k").alias("p")), "step")
    state, goal = step, None
    for _ in range(rounds):
        around = both.join(state.select(F.col("node").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("p")).alias("a"))
        new = written(state.join(around, "node").withColumn("q", (F.col("d") + alpha) * F.col("p") - F.col("a")).drop("a"), "step")
        discard(step)
        step = new
        sums = step.agg(*(F.coalesce(F.sum(F.col(x) * F.col(y)), zero).alias(x + y) for x, y in (("r", "r"), ("p", "q"), ("r", "q"), ("q", "q")))).first()
        goal = tolerance**2 * sums.rr if goal is None else goal
        if sums.rr <= goal or not sums.pq:
            return step.select("node", "score")
        by = sums.rr / sums.pq
        onward = max(sums.rr - 2 * by * sums.rq + by * by * sums.qq, 0.0) / sums.rr
        r = F.col("r") - by * F.col("q")
        state = step.select("node", "d", (F.col("score") + by * F.col("p")).alias("score"), r.alias("r"), (r + onward * F.col("p")).alias("p"))
    raise RuntimeError(f"the residual is {sums.rr**0.5} after {rounds} rounds")


def springrank(edges: DataFrame, alpha: float = 1.0, tolerance: float = 1e-8, rounds: int = 200) -> DataFrame:
    """``node``, ``score`` solving (alpha + D) s = k_in - k_out + (A + A') s: a move up raises its target."""
    return _spring_solution(edges, alpha, tolerance, rounds)


def agony_rank(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """``node``, ``score``: each round a node moves to the mean of one above its sources and one below its targets."""
    e = edges.filter(~F.col("is_self_loop")).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = written(e.select("src", "dst", "weight", F.lit(-1.0).alias("side")).union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1.0).alias("side"))), "edges")
    state = written(_nodes(e).withColumn("score", F.lit(0.0)), "state")

    def step(s: DataFrame) -> DataFrame:
        want = both.join(s, both.dst == s.node).groupBy("src").agg((F.sum(F.col("weight") * (F.col("score") + F.col("side"))) / F.sum("weight")).alias("w"))
        j = s.join(want, s.node == want.src, "left").select("node", (F.col("score") / 2 + F.coalesce("w", "score") / 2).alias("score"), F.col("score").alias("was"))
        return j.join(F.broadcast(j.agg(F.avg("score").alias("m")))).select("node", (F.col("score") - F.col("m")).alias("score"), "was")

    return _iterate(state, step, "score", tolerance, rounds)


def trophic_levels(edges: DataFrame, components: DataFrame, tolerance: float = 1e-8, rounds: int = 200) -> DataFrame:
    """``node``, ``component``, ``level``: the spring solution without any pull to zero, centred in each weak component."""
    s = _spring_solution(edges, 0.0, tolerance, rounds).join(components, "node")
    means = s.groupBy("component").agg(F.avg("score").alias("m"))
    return s.join(means, "component").select("node", "component", (F.col("score") - F.col("m")).alias("level"))


def oriented_scores(scores: DataFrame, anchor: DataFrame, node: str, score: str, ordinal: str, support: str) -> DataFrame:
    """Revealed scores turned so that they rise with the anchor's ordinals: ``oriented``, its z-score, percentile and confidence.

    Confidence is the support over its 90th percentile, at most 1. A correlation of 0, or without anchors, turns nothing.
    """
    turn = scores.join(anchor.select(node, ordinal).dropna(), node).agg(correlation(score, ordinal).alias("wl_c"))
    turned = scores.join(F.broadcast(turn)).withColumn("oriented", F.when(F.col("wl_c") < 0, -F.col(score)).otherwise(F.col(score))).drop("wl_c")
    ranked = average_percent_rank(z_scores(turned, "oriented", "z"), [], "oriented", "percentile")
    return clip_confidence(ranked, support, 0.9, "confidence")


def davids_score(edges: DataFrame) -> DataFrame:
    """``node``, ``score`` = w + w2 - l - l2 from pairwise win shares; an edge src to dst is a win of dst."""
    e = edges.filter(~F.col("is_self_loop")).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("won"), F.lit(0).cast("long").alias("lost"))
    pairs = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lost").alias("won"), F.col("won").alias("lost"))).groupBy("a", "b").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    p = pairs.withColumn("p", F.col("won") / (F.col("won") + F.col("lost")))
    first = p.groupBy("a").agg(F.sum("p").alias("w"), F.sum(1 - F.col("p")).alias("l"))
    second = p.join(first.select(F.col("a").alias("b"), F.col("w").alias("wb"), F.col("l").alias("lb")), "b")
    second = second.groupBy("a").agg(F.sum(F.col("p") * F.col("wb")).alias("w2"), F.sum((1 - F.col("p")) * F.col("lb")).alias("l2"))
    return first.join(second, "a").select(F.col("a").alias("node"), (F.col("w") + F.col("w2") - F.col("l") - F.col("l2")).alias("score"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``node``, ``label``: the label of greatest weight around, the least on a tie; kept where it is among the best."""
    both = edges.filter(~F.col("is_self_loop")).select("src", "dst", "weight")
    both = written(both.union(both.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    state = written(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "state")
    for k in range(rounds):
        votes = both.join(state, both.dst == state.node).groupBy("src", "label").agg(F.sum("weight").alias("v"))
        mine = votes.join(state.select(F.col("node").alias("src"), F.col("label").alias("own")), "src")
        best = mine.groupBy("src").agg(F.min(F.struct((-F.col("v")).alias("v"), (F.col("label") != F.col("own")).alias("o"), "label")).alias("t"), F.first("own").alias("own"))
        half = F.pmod(F.xxhash64("src"), F.lit(2)) == k % 2  # half of the nodes move at a time, or labels would swap for ever
        new = written(best.select(F.col("src").alias("node"), F.when(half, F.col("t.label")).otherwise(F.col("own")).alias("label"), (F.col("t.label") != F.col("own")).alias("moved")), "state")
        state = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return state
    raise RuntimeError(f"labels still move after {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    e = edges.filter(~F.col("is_self_loop"))
    a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
    inside = e.join(a, "src").join(b, "dst")
    total = e.agg(F.sum("weight").alias("t"))
    within = inside.filter("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("w"))
    strength = inside.select(F.col("la").alias("label"), "weight").union(inside.select("lb", "weight")).groupBy("label").agg(F.sum("weight").alias("s"))
    j = strength.join(within, "label", "left").join(F.broadcast(total))
    return j.agg(F.sum(F.coalesce("w", F.lit(0)) / F.col("t") - F.pow(F.col("s") / (2 * F.col("t")), 2)).alias("modularity"), F.count("*").alias("communities"))


def label_spread(edges: DataFrame, seeds: DataFrame, alpha: float = 0.8, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``node``, ``class``, ``score`` over symmetric normalised edges, class masses evened at the end; best class per node."""
    both = edges.filter(~F.col("is_self_loop")).select("src", "dst", "weight")
    both = both.union(both.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    d = both.groupBy("src").agg(F.sum("weight").alias("d"))
    both = written(both.join(d, "src").join(d.toDF("dst", "e"), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("w")), "edges")
    start = written(seeds.select("node", "class", F.lit(1.0).alias("y")), "seeds")
    state = start.select("node", "class", F.col("y").alias("score"))
    for _ in range(rounds):
        spread = both.join(state, both.dst == state.node).groupBy(F.col("src").alias("node"), "class").agg(F.sum(F.col("w") * F.col("score")).alias("s"))
        j = spread.join(start, ["node", "class"], "full").join(state.withColumnRenamed("score", "was"), ["node", "class"], "left")
        new = written(j.select("node", "class", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))).alias("score"), F.coalesce("was", F.lit(0.0)).alias("was")), "state")
        state = new.drop("was")
        if (new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"scores still move after {rounds} rounds")
    mass = state.groupBy("class").agg(F.sum("score").alias("m"))
    even = state.join(mass, "class").withColumn("score", F.col("score") / F.col("m"))
    best = even.groupBy("node").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "class")).alias("t"))
    return best.select("node", F.col("t.class").alias("class"), (-F.col("t.s")).alias("score"))
