"""Employers at two grains: one identity per distinct name, and one per row, each with method and confidence.

A name takes the identity of the first tier that has one: a placeholder (no employer), the id that most of its rows carry,
the id of another spelling with the same normal form, the name itself. A name that is left with itself takes that of the
most frequent name that differs from it by typing errors or word order alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import compose, fold, match_key
from wayline.operators.aggregates import top_value
from wayline.operators.spelling import token_typo_clusters
from wayline.sources.scratch import written


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def company_vocabulary(rows: DataFrame, name: str, own_id: str, support: int = 3, share: float = 0.5) -> DataFrame:
    """``value``, ``freq``, ``id_rows`` and ``modal_id``: the commonest id of a name's rows where enough of them carry one."""
    base = rows.filter(_text(name).isNotNull()).select(F.col(name).alias("value"), _text(own_id).alias("id"))
    # The rows are read once: all else follows from the counts, which are read several times.
    counts = written(base.groupBy("value", "id").agg(F.count("*").alias("n")), "company_counts")
    top = top_value(counts, ["value"], "id", F.col("n")).select("value", F.col("id").alias("top_id"), F.col("total").alias("id_rows"))
    j = counts.groupBy("value").agg(F.sum("n").alias("freq")).join(top, "value", "left").withColumn("id_rows", F.coalesce("id_rows", F.lit(0)))
    enough = (F.col("id_rows") >= support) & (F.col("id_rows") >= share * F.col("freq"))
    return j.select("value", "freq", "id_rows", F.when(enough, F.col("top_id")).alias("modal_id"))


def company_values(vocab: DataFrame, placeholders: list[tuple[str, str]], aliases: DataFrame | None = None, least: int = 4, stop: tuple[str, ...] = ()) -> DataFrame:
    """``value``, ``company``, ``method``, ``confidence`` for each row of ``company_vocabulary``.

    ``placeholders`` are (pattern on the normal form, bucket), the first that matches counts; a name of punctuation alone is
    ``none``. ``aliases`` has ``id`` and ``canonical_id``. Names with a normal form under ``least`` letters, or none (other
    scripts), never take another name's identity.
    """
    named = compose(fold(vocab, "value", "wl_folded"), "value", "wl_nfkc")
    plain = F.trim(F.regexp_replace(F.lower("wl_nfkc"), "\\s+", " "))
    v = named.withColumn("norm", match_key(F.col("wl_folded"))).withColumn("safe", F.when(F.col("norm") != "", F.col("norm")).otherwise(plain))
    bucket = F.when((F.col("norm") == "") & ~F.col("value").rlike("[\\p{L}\\p{N}]"), "none")
    for pattern, label in reversed(placeholders):
        bucket = F.when(F.col("norm").rlike(pattern), label).otherwise(bucket)
    v = v.withColumn("bucket", bucket).select("value", "freq", "modal_id", "norm", "safe", "bucket")
    first = F.min(F.struct((-F.col("freq")).alias("f"), "value", "modal_id"))
    twins = v.filter("modal_id is not null and bucket is null and norm <> ''").groupBy("norm").agg(first["modal_id"].alias("twin_id"))
    v = v.join(twins, "norm", "left").withColumn("wl_id", F.coalesce("modal_id", "twin_id"))
    if aliases is not None:
        v = v.join(aliases.select(F.col("id").alias("wl_id"), "canonical_id"), "wl_id", "left").withColumn("wl_id", F.coalesce("canonical_id", "wl_id")).drop("canonical_id")
    tagged = F.concat(F.lit("id:"), "wl_id")
    tiers = [
        (F.col("bucket").isNotNull(), F.concat(F.lit("nonorg:"), "bucket"), "placeholder", 1.0),
        (F.col("modal_id").isNotNull(), tagged, "company_id", 0.9),
        (F.col("wl_id").isNotNull(), tagged, "name_crosswalk", 0.97),
        (F.lit(True), F.concat(F.lit("raw:"), "safe"), "raw", 0.5),
    ]
    named = written(v.select("value", "freq", "norm", "safe", _first(tiers).alias("own")), "company_names")
    spelt = token_typo_clusters(named, "value", "freq", "norm", stop=stop).filter("value <> representative")
    chief = named.select(F.col("value").alias("representative"), F.col("own.company").alias("theirs"), F.col("safe").alias("their_safe"))
    j = named.join(spelt, "value", "left").join(chief, "representative", "left")
    open_ = (F.col("own.method") == "raw") & (F.length("norm") >= least) & F.col("representative").isNotNull()
    tiers = [
        (open_ & F.startswith(F.col("theirs"), F.lit("id:")), F.col("theirs"), "typo_to_id", 0.9),
        (open_, F.concat(F.lit("raw:"), "their_safe"), "typo", 0.85),
    ]
    return j.select("value", F.coalesce(_first(tiers), "own").alias("t")).select("value", "t.*")


def _first(tiers: list[tuple[Column, Column, str, float]]) -> Column:
    """Company, method and confidence of the first tier whose condition holds."""
    made = [(c, F.struct(v.alias("company"), F.lit(m).alias("method"), F.lit(s).alias("confidence"))) for c, v, m, s in tiers]
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(made), F.lit(None).cast("struct<company:string,method:string,confidence:double>"))


def company_rows(rows: DataFrame, name: str, own_id: str, values: DataFrame, slug: Column | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """The rows with ``company``, ``company_method``, ``company_confidence``: placeholder, then the row's own id, a school's page, the name's identity."""
    j = rows.join(values.select(F.col("value").alias("wl_value"), F.struct("company", "method", "confidence").alias("wl_v")), F.col(name).eqNullSafe(F.col("wl_value")), "left")
    own = _text(own_id)
    if aliases is not None:
        j = j.join(aliases.select(F.col("id").alias("wl_alias"), F.col("canonical_id").alias("wl_canonical")), own == F.col("wl_alias"), "left")
        own = F.coalesce("wl_canonical", own)
    page = F.lit(None).cast("string") if slug is None else F.nullif(F.lower(slug), F.lit(""))
    tiers = [
        (F.col("wl_v.method") == "placeholder", F.col("wl_v.company"), "placeholder", 1.0),
        (own.isNotNull(), F.concat(F.lit("id:"), own), "company_id", 1.0),
        (page.isNotNull(), F.concat(F.lit("id:"), page), "school_url", 0.98),
    ]
    found = j.withColumn("wl_t", F.coalesce(_first(tiers), "wl_v"))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("wl_t.company").alias("company"), F.col("wl_t.method").alias("company_method"), F.col("wl_t.confidence").alias("company_confidence"))
