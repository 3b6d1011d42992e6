"""Votes, calibration, agreement, and data-quality checks as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.aggregates import top_value
from wayline.operators.windows import average_percent_rank, correlation


def vote_state(votes: DataFrame, item: str, code: str) -> DataFrame:
    """Per item: votes, distinct codes, the unanimous code, the majority code (over half), and the state."""
    per = votes.groupBy(item).agg(F.count(code).alias("votes"), F.count_distinct(code).alias("codes"))
    top = top_value(votes, [item], code).select(item, F.col(code).alias("wl_top"), "support")
    j = per.join(top, item, "left")
    one, most = F.col("codes") == 1, F.col("support") * 2 > F.col("votes")
    return j.select(
        item, "votes", "codes", F.when(one, F.col("wl_top")).alias("unanimous"), F.when(most, F.col("wl_top")).alias("majority"),
        F.when(F.col("votes") == 0, "none").when(one, "unanimous").when(most, "majority").otherwise("split").alias("state"),
    )


def hierarchical_consensus(votes: DataFrame, item: str, code: str, share: float, levels: int) -> DataFrame:
    """The deepest dotted prefix that more than ``share`` of all an item's votes support, and its depth."""
    parts = F.split(F.col(code), "\\.")
    total = votes.groupBy(item).agg(F.count("*").alias("wl_t"))
    prefixes = votes.select(item, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(levels))), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("p"))
    kept = prefixes.groupBy(item, "p").agg(F.count("*").alias("n")).join(total, item).filter(F.col("n") > share * F.col("wl_t"))
    depth = F.size(F.split("p", "\\."))
    best = kept.groupBy(item).agg(F.max(F.struct(depth.alias("d"), "n", "p")).alias("b"))
    return total.join(best, item, "left").select(item, F.col("b.p").alias("consensus"), F.coalesce("b.d", F.lit(0)).alias("depth"))


def calibration(votes: DataFrame, gold: DataFrame, item: str, juror: str, code: str, truth: str, band: str, gate: float) -> DataFrame:
    """Accuracy and coverage per juror, per agreement band and of unanimous items, with a gate."""
    known = votes.join(gold, item)
    right = (F.col(code) == F.col(truth)).cast("int")
    per_juror = known.groupBy(F.concat(F.lit("juror:"), juror).alias("slice")).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
    state = vote_state(votes, item, code).join(gold, item)
    called = F.coalesce("unanimous", "majority")
    per_state = state.groupBy(F.concat(F.lit("state:"), "state").alias("slice")).agg(F.count("*").alias("n"), F.avg((called == F.col(truth)).cast("int")).alias("accuracy"))
    per_band = state.groupBy(F.concat(F.lit("band:"), F.col(band).cast("string")).alias("slice")).agg(F.count("*").alias("n"), F.avg((called == F.col(truth)).cast("int")).alias("accuracy"))
    out = per_juror.unionByName(per_state).unionByName(per_band)
    return out.select("slice", "n", F.round("accuracy", 6).alias("accuracy"), (F.coalesce("accuracy", F.lit(0.0)) >= gate).alias("passes"))


def level_scores(df: DataFrame, predicted: str, gold: str, levels: int) -> DataFrame:
    """Precision and recall of dotted codes per level; a null or shallow prediction abstains."""
    from wayline.functions.text import truncate_code

    rows = df.withColumn("level", F.explode(F.array(*map(F.lit, range(1, levels + 1)))))
    p = F.coalesce(*(F.when(F.col("level") == k, truncate_code(F.col(predicted), k)) for k in range(1, levels + 1)))
    g = F.coalesce(*(F.when(F.col("level") == k, truncate_code(F.col(gold), k)) for k in range(1, levels + 1)))
    out = rows.withColumns({"wl_p": p, "wl_g": g}).groupBy("level").agg(F.count("wl_p").alias("predicted"), F.count("wl_g").alias("known"), F.count_if(F.col("wl_p") == F.col("wl_g")).alias("right"))
    return out.select("level", "predicted", "known", F.round(F.try_divide("right", "predicted"), 6).alias("precision"), F.round(F.try_divide("right", "known"), 6).alias("recall"))


def macro_f1(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Accuracy, coverage and the mean F1 of gold classes; a null prediction abstains."""
    cells = df.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    right = F.col(predicted) == F.col(gold)
    per_gold = cells.groupBy(gold).agg(F.sum("n").alias("g"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"))
    per_called = cells.filter(F.col(predicted).isNotNull()).groupBy(F.col(predicted).alias(gold)).agg(F.sum("n").alias("c"))
    f1 = per_gold.join(per_called, gold, "left").select((2 * F.col("tp") / (F.col("g") + F.coalesce("c", F.lit(0)))).alias("f1"))
    totals = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(predicted).isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("r"))
    return f1.agg(F.round(F.avg("f1"), 6).alias("macro_f1")).join(totals).select("macro_f1", F.round(F.col("k") / F.col("n"), 6).alias("coverage"), F.round(F.col("r") / F.col("k"), 6).alias("accuracy"))


def kappa(df: DataFrame, a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Rows with both labels, their agreement and Cohen's kappa, by rows or by weight; 1 where chance alone agrees."""
    cells = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("k"), (F.count("*") if weight is None else F.sum(weight)).alias("n"))
    rows, cols = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("ra")), cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("cb"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("e"))
    seen = cells.agg(F.sum("k").alias("rows"), F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("o"))
    po, pe = F.col("o") / F.col("n"), F.col("e") / F.col("n") / F.col("n")
    return seen.join(chance).select(F.col("rows").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).when(pe >= 1, 1.0), 6).alias("kappa"))


def disagreements(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows whose two labels are there and differ."""
    return df.filter(F.col(a) != F.col(b)).select(key, a, b)


def assignment_scores(df: DataFrame, predicted: str, primary: str, secondary: str, weight: str, strata: list[str]) -> DataFrame:
    """Per slice (all rows, and each value of the strata): coverage and accuracy, strict and lenient, by rows, by weight and of what is assigned.

    Lenient takes the secondary gold label too. A null prediction abstains: it lowers accuracy but not that of assigned rows.
    """
    slices = F.array(F.lit("all"), *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in strata))
    made, strict = F.col(predicted).isNotNull(), F.coalesce(F.col(predicted) == F.col(primary), F.lit(False))
    lenient = strict | F.coalesce(F.col(predicted) == F.col(secondary), F.lit(False))
    one, w = (lambda c: F.count_if(c)), (lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0)))
    out = df.filter(F.col(primary).isNotNull()).withColumn("slice", F.explode(slices)).groupBy("slice").agg(
        F.count("*").alias("n"), F.sum(weight).alias("wn"), *(f(c).alias(p + k) for p, f in (("", one), ("w", w)) for k, c in (("made", made), ("strict", strict), ("lenient", lenient)))
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return out.select(
        "slice", "n", ratio("made", "n").alias("coverage"), ratio("wmade", "wn").alias("coverage_weighted"), ratio("strict", "n").alias("strict"), ratio("lenient", "n").alias("lenient"),
        ratio("wstrict", "wn").alias("strict_weighted"), ratio("wlenient", "wn").alias("lenient_weighted"), ratio("strict", "made").alias("strict_assigned"), ratio("lenient", "made").alias("lenient_assigned"),
    )


def confusion(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Counts of gold labels called otherwise; an abstention is null."""
    return df.filter(F.col(gold).isNotNull() & ~F.col(gold).eqNullSafe(F.col(predicted))).groupBy(gold, predicted).agg(F.count("*").alias("n"))


def ranking_leaderboard(methods: dict[str, DataFrame], silver: DataFrame, anchor: DataFrame, ladders: DataFrame) -> DataFrame:
    """Per ranking method: coverage and accuracy of known directions, up and down precision, rank correlation with the anchor, ladders kept.

    Methods are tables of ``node`` and ``score``, turned so that they rise with the anchor (``node``, ``value``). ``silver``
    has ``src``, ``dst`` and ``truth`` (1 or -1); equal scores call no direction. ``ladders`` has ``low`` and ``high`` nodes.
    """
    scores = None
    for name, df in methods.items():
        one = df.select(F.lit(name).alias("method"), "node", F.col("score").cast("double").alias("score"))
        scores = one if scores is None else scores.union(one)
    both = scores.join(anchor.select("node", F.col("value").cast("double").alias("value")).dropna(), "node")
    turn = both.groupBy("method").agg(correlation("score", "value").alias("c"))
    scores = scores.join(turn, "method").select("method", "node", F.when(F.col("c") < 0, -F.col("score")).otherwise(F.col("score")).alias("score"))
    ranked = scores.join(anchor.select("node", "value").dropna(), "node")
    ranked = average_percent_rank(average_percent_rank(ranked, ["method"], "score", "a"), ["method"], "value", "b")
    rho = ranked.groupBy("method").agg(F.round(correlation("a", "b"), 6).alias("spearman"))
    ends = lambda df, lo, hi: df.join(scores.select("method", F.col("node").alias(lo), F.col("score").alias("wl_lo")), lo).join(scores.select("method", F.col("node").alias(hi), F.col("score").alias("wl_hi")), ["method", hi])
    call, t = F.signum(F.col("wl_hi") - F.col("wl_lo")), F.col("truth")
    calls = ends(silver, "src", "dst").groupBy("method").agg(
        F.count("*").alias("silver"), F.count_if(call != 0).alias("c"), F.count_if(call == t).alias("r"), F.count_if(call > 0).alias("u"), F.count_if((call > 0) & (t > 0)).alias("ur"),
        F.count_if(call < 0).alias("d"), F.count_if((call < 0) & (t < 0)).alias("dr"),
    )
    kept = ends(ladders, "low", "high").groupBy("method").agg(F.count_if(F.col("wl_hi") > F.col("wl_lo")).alias("ladders_kept"), F.count("*").alias("ladders"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    out = calls.select("method", "silver", ratio("c", "silver").alias("coverage"), ratio("r", "c").alias("accuracy"), ratio("ur", "u").alias("up_precision"), ratio("dr", "d").alias("down_precision"))
    return out.join(rho, "method", "left").join(kept, "method", "left")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    p = k / n
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (middle - spread) / scale, (middle + spread) / scale


def pair_scores(pairs: DataFrame, mapping: DataFrame, a: str, b: str, same: str, value: str, cluster: str) -> DataFrame:
    """Precision, recall and F1 of "same" pairs under a value mapping."""
    m = mapping.select(value, cluster)
    j = pairs.join(m.toDF(a, "wl_a"), a, "left").join(m.toDF(b, "wl_b"), b, "left").withColumn("wl_m", F.coalesce(F.col("wl_a") == F.col("wl_b"), F.lit(False)))
    c = j.agg(F.count_if(F.col("wl_m") & F.col(same)).alias("tp"), F.count_if(F.col("wl_m") & ~F.col(same)).alias("fp"), F.count_if(~F.col("wl_m") & F.col(same)).alias("fn"))
    return c.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def bias_delta(one: DataFrame, other: DataFrame, keys: list[str], value: str, bar: float) -> DataFrame:
    """A statistic under two sources side by side, its change, and whether that is material."""
    j = one.withColumnRenamed(value, "a").join(other.withColumnRenamed(value, "b"), keys, "full")
    return j.select(*keys, "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.coalesce(F.abs(F.col("b") - F.col("a")) > bar, F.lit(True)).alias("material"))


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows that break it (unknown counts as broken), in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("r")).select("r.*")


def row_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("rows_before")), after.agg(F.count("*").alias("rows_after"))
    return a.join(b).withColumn("preserved", F.col("rows_before") == F.col("rows_after"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: rows, nulls, blanks, distinct values, distinct in lower case, median length; all columns in one scan."""
    def told(c: str) -> Column:
        text = F.col(c)
        values = {
            "rows": F.count("*"), "nulls": F.count_if(text.isNull()), "blanks": F.count_if(F.trim(text) == ""),
            "distinct": F.count_distinct(text), "distinct_lower": F.count_distinct(F.lower(text)), "median_length": F.median(F.length(text)),
        }
        return F.struct(F.lit(c).alias("column"), *(v.alias(n) for n, v in values.items()))

    return df.agg(F.array(*map(told, columns)).alias("wl_p")).select(F.explode("wl_p").alias("p")).select("p.*")


def head_gate(head: DataFrame, review: DataFrame, row: str, code: str, abstain: list[str], valid: DataFrame, bar: float = 0.9) -> DataFrame:
    """One row: how far a reviewer's dotted codes agree with the head's, level by level, and whether the first level reaches the bar.

    ``abstained`` reviews (no code, or one in ``abstain``), ``invalid`` codes (not in ``valid``) and ``unmatched`` reviews,
    whose row the head does not have, are counted apart and not scored. The second level is judged where both have one and
    the first agrees. A review that does not join is a broken join: it fails the gate whatever the agreement.
    """
    said = F.nullif(F.upper(F.trim(F.col(code))), F.lit(""))
    r = review.select(F.col(row).alias("wl_row"), said.alias("wl_said")).join(valid.select(F.col(code).alias("wl_said"), F.lit(True).alias("wl_valid")).distinct(), "wl_said", "left")
    j = r.join(head.select(F.col(row).alias("wl_row"), F.col(code).alias("wl_head"), F.lit(True).alias("wl_known")), "wl_row", "left")
    known = F.col("wl_known").isNotNull()
    silent = known & (F.col("wl_said").isNull() | F.col("wl_said").isin(abstain))
    wrong = known & ~silent & F.col("wl_valid").isNull()
    scored = known & ~silent & ~wrong
    cut = lambda c, k: F.array_join(F.slice(F.split(c, "\\."), 1, k), ".")
    first = scored & (cut(F.col("wl_said"), 1) == cut(F.col("wl_head"), 1))
    deep = first & (F.size(F.split("wl_said", "\\.")) >= 2) & (F.size(F.split("wl_head", "\\.")) >= 2)
    second = deep & (cut(F.col("wl_said"), 2) == cut(F.col("wl_head"), 2))
    n = j.agg(
        F.count("*").alias("reviews"), F.count_if(~known).alias("unmatched"), F.count_if(silent).alias("abstained"), F.count_if(wrong).alias("invalid"), F.count_if(scored).alias("scored"),
        F.count_if(first).alias("f"), F.count_if(deep).alias("level2_n"), F.count_if(second).alias("s"), F.count_if(scored & (F.col("wl_said") == F.col("wl_head"))).alias("e"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    passes = (F.col("unmatched") == 0) & (F.coalesce(F.try_divide("f", "scored"), F.lit(0.0)) >= bar)
    return n.select("reviews", "unmatched", "abstained", "invalid", "scored", share("f", "scored").alias("level1"), "level2_n", share("s", "level2_n").alias("level2"), share("e", "scored").alias("exact"), passes.alias("passes"))


def gold_scores(rows: DataFrame, gold: DataFrame, text: str, line: str, source: str, code: str, tier: str, levels: DataFrame, none: str, by_text: list[str]) -> DataFrame:
    """Per tier of a fixed gold sample, how the codes that the rows carry now agree with it.

    ``gold`` has the text, its tier, ``gold_code`` and ``gold_secondary``. A text is judged by its modal row: that of the
    commonest line (the least on a tie), which is what the labeller saw. ``strict`` is the primary code, ``lenient`` either,
    ``gap`` between the two is what the gold itself leaves open, ``level`` agreement by ``levels`` (code, level); and
    ``row_strict`` weighs all rows of a text. ``reach`` is the share of the graded texts that have any code, beyond which
    recall cannot go. Gold ``none`` says that the text names nothing: a code from a source in ``by_text`` is then an error
    (``string_label``), one from elsewhere is right (``degree_line``), none is an abstention.
    """
    seen = rows.join(gold.select(text).distinct(), text).groupBy(text, line).agg(F.count("*").alias("n"), F.min(F.struct(source, code)).alias("wl_x"))
    modal = seen.groupBy(text).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(line).alias("l"), F.col("wl_x").alias("x")))["x"].alias("wl_x"))
    weighed = rows.join(gold.select(text, "gold_code"), text).groupBy(text).agg(F.count("*").alias("rows"), F.count_if(F.col(code) == F.col("gold_code")).alias("right"))
    of = levels.groupBy("code").agg(F.min("level").alias("level"))
    j = gold.join(modal, text, "left").join(weighed, text, "left").withColumns({"wl_s": F.col(f"wl_x.{source}"), "wl_c": F.col(f"wl_x.{code}")})
    j = j.join(of.toDF("wl_c", "wl_l1"), "wl_c", "left").join(of.toDF("gold_code", "wl_l2"), "gold_code", "left")
    graded = F.col("gold_code") != none
    yes = lambda c: F.count_if(graded & F.coalesce(c, F.lit(False)))
    strict, second = F.col("wl_c") == F.col("gold_code"), F.col("wl_c") == F.col("gold_secondary")
    empty, labelled = ~graded & F.col("wl_c").isNull(), ~graded & F.col("wl_c").isNotNull() & F.coalesce(F.col("wl_s").isin(by_text), F.lit(False))
    a = j.groupBy(tier).agg(
        F.count("*").alias("n"), F.count_if(graded).alias("graded"), yes(strict).alias("s"), yes(F.coalesce(strict, F.lit(False)) | F.coalesce(second, F.lit(False))).alias("l"), yes(F.col("wl_l1").eqNullSafe(F.col("wl_l2"))).alias("v"),
        yes(F.col("wl_c").isNotNull()).alias("c"), F.sum(F.when(graded, F.col("rows"))).alias("w"), F.sum(F.when(graded, F.col("right"))).alias("k"),
        F.count_if(empty).alias("abstained"), F.count_if(labelled).alias("string_label"), F.count_if(~graded & ~empty & ~labelled).alias("degree_line"),
    )
    share = lambda x, y: F.round(F.try_divide(x, y), 6)
    return a.select(tier, "n", "graded", share("s", "graded").alias("strict"), share("l", "graded").alias("lenient"), F.round(F.try_divide(F.col("l") - F.col("s"), "graded"), 6).alias("gap"), share("v", "graded").alias("level"), share("k", "w").alias("row_strict"), share("c", "graded").alias("reach"), "abstained", "string_label", "degree_line")
