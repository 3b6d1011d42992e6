"""Canonical values: each runs over a vocabulary of distinct values, and facts join the result back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.text import soundex_block
from wayline.operators.aggregates import top_value
from wayline.operators.components import connected_components
from wayline.sources.scratch import written

CUT_WORDS = 50_000  # of a vocabulary that a task cuts


def rule_ladder(df: DataFrame, value: str, rules: list[tuple[str, str, str, float]], name: str) -> DataFrame:
    """First rule that fits gives ``name``, ``name``_method and ``name``_confidence.

    A rule is (kind, pattern, label, confidence); kinds are exact, regex and tokens (all words present).
    """
    label, method, sure = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    low = F.lower(F.col(value))
    for kind, pattern, out, confidence in reversed(rules):
        if kind == "exact":
            fits = low == pattern
        elif kind == "regex":
            fits = low.rlike(pattern)
        else:
            fits = F.size(F.array_except(F.array(*map(F.lit, pattern.split())), F.split(low, " "))) == 0
        label, method, sure = F.when(fits, out).otherwise(label), F.when(fits, kind).otherwise(method), F.when(fits, confidence).otherwise(sure)
    return df.withColumns({name: label, f"{name}_method": method, f"{name}_confidence": sure})


def parse_title(df: DataFrame, value: str, levels: list[str], expand: dict[str, str]) -> DataFrame:
    """Words, abbreviations spelled out, split into ``levels`` (sorted) and ``base`` (sorted); ``canonical`` joins both."""
    words = F.filter(F.split(F.lower(F.col(value)), "[^a-z0-9]+"), lambda t: t != "")
    if expand:
        spelled = F.create_map(*(F.lit(x) for pair in expand.items() for x in pair))
        words = F.transform(words, lambda t: F.coalesce(spelled[t], t))
    known = F.array(*map(F.lit, levels))
    inside = F.array_sort(F.array_distinct(F.filter(words, lambda t: F.array_contains(known, t))))
    base = F.array_sort(F.array_distinct(F.filter(words, lambda t: ~F.array_contains(known, t))))
    out = df.withColumns({"levels": F.array_join(inside, ","), "base": F.array_join(base, " ")})
    return out.withColumn("canonical", F.concat(F.lit("title:"), "levels", F.lit("|"), "base"))


def max_rank(tokens: Column, ranks: dict[str, int], sep: str = ",") -> Column:
    """The highest rank among comma-joined tokens, null if none is known."""
    known = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    return F.array_max(F.transform(F.split(tokens, sep), lambda t: known[F.trim(t)]))


def lexicon_ladder(vocab: DataFrame, value: str, lexicon: DataFrame, code: str, variants: list[tuple[str, Column, Column]]) -> DataFrame:
    """Add ``code`` and ``method``: each variant (label, key of the value, key of the lexicon) in turn, ambiguous keys dropped."""
    out, found = vocab, []
    for k, (label, mine, theirs) in enumerate(variants):
        keys = lexicon.select(theirs.alias(f"wl_k{k}"), F.col(code).alias(f"wl_c{k}")).groupBy(f"wl_k{k}").agg(F.min(f"wl_c{k}").alias(f"wl_c{k}"), F.count_distinct(f"wl_c{k}").alias("wl_n"))
        out = out.withColumn(f"wl_k{k}", mine).join(keys.filter("wl_n = 1").drop("wl_n"), f"wl_k{k}", "left")
        found.append((label, F.col(f"wl_c{k}")))
    method = F.lit(None).cast("string")
    for label, c in reversed(found):
        method = F.when(c.isNotNull(), label).otherwise(method)
    return out.select(*vocab.columns, F.coalesce(*(c for _, c in found)).alias(code), method.alias("method"))


def typo_clusters(vocab: DataFrame, key: str, n: str, distance: int = 2) -> DataFrame:
    """``key`` and ``representative``: values of a phonetic block within the edit distance, linked transitively.

    The most frequent value of a cluster stands for it. Values within the distance share a text that each becomes by deleting
    at most that many characters, so values meet on those texts inside their block, and a block is never compared with itself
    as a whole. The vocabulary is written first: whatever it is counted from is read once.
    """
    vocab = written(vocab.select(key, n), "vocab")
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    left = F.array(F.col(key))
    for _ in range(distance):
        left = F.array_distinct(F.concat(left, F.flatten(F.transform(F.filter(left, lambda t: t != ""), shorter))))
    # A word becomes many pieces: small tasks, and no broadcast by the words' own size.
    cut = vocab.repartition(max(1, -(-vocab.count() // CUT_WORDS)), key).select(key, F.explode(left).alias("wl_left"), soundex_block(F.col(key)).alias("wl_b"))
    cut = cut.select(key, F.xxhash64("wl_b", "wl_left").alias("wl_piece"))
    one, other = F.col(f"a.{key}"), F.col(f"b.{key}")  # of the same rows, which are cut and sent once for both sides
    met = cut.alias("a").hint("merge").join(cut.alias("b"), F.col("a.wl_piece") == F.col("b.wl_piece")).filter(one < other)
    pairs = met.filter(F.levenshtein(one, other, distance) >= 0).select(one.alias("wl_one"), other.alias("wl_other"))
    groups = connected_components(pairs, "wl_one", "wl_other")
    member = vocab.join(groups, F.col(key) == F.col("node"), "left").withColumn("component", F.coalesce("component", key))
    best = member.groupBy("component").agg(F.min(F.struct((-F.col(n)).alias("f"), F.col(key).alias("v"))).alias("wl_t"))
    return member.join(best, "component").select(key, F.col("wl_t.v").alias("representative"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def parse_location(value: Column, countries: dict[str, str], states: dict[str, str], home: str, metros: dict[str, tuple[str, str]], cities: dict[str, tuple[str, str]], remote: list[str]) -> dict[str, Column]:
    """``country``, ``state``, ``city``, ``location_method`` and ``location_confidence`` of a place written with commas.

    Gazetteers have lower-case names: ``countries`` and the ``states`` of the ``home`` country map to codes, ``metros`` and
    ``cities`` to (city, state). One name alone is tried as city, metro, state and country in this order. Of several, the
    last may be a country, the last state before it is taken, and the first is the city if it is neither. Codes of states
    count in capitals only. A state with another country is unparsed, like what no gazetteer knows; no text is ``empty``.
    """
    text = F.regexp_replace(F.trim(value), "\\s+", " ")
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), " (metropolitan area|metro area|area|metro)$", ""))
    codes = {c: c for c in states.values()}
    state_of = lambda x: F.when(x.rlike("^[A-Z]{2}$"), _lookup(codes, x)).otherwise(_lookup(states, bare(x)))

    one = F.lower(F.get(parts, F.lit(0)))
    core = F.regexp_replace(F.regexp_replace(one, "^greater ", ""), " (metropolitan area|metro area|area|metro|metroplex)$", "")
    at_gazetteer = lambda table, key, i: _lookup({k: v[i] for k, v in table.items()}, key)
    city, metro, alone, land = at_gazetteer(cities, one, 0), at_gazetteer(metros, core, 0), state_of(F.get(parts, F.lit(0))), _lookup(countries, one)
    fields, empty = ("country", "state", "city", "method", "confidence"), F.lit(None).cast("string")
    place = lambda *v: F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(fields, v, strict=True)))
    single = (
        F.when(city.isNotNull(), place(home, at_gazetteer(cities, one, 1), city, "city_alias", 0.9))
        .when(metro.isNotNull(), place(home, at_gazetteer(metros, core, 1), metro, "metro", 0.95))
        .when(alone.isNotNull(), place(home, alone, empty, "state", 1.0))
        .when(land.isNotNull(), place(land, empty, empty, "country", 1.0))
    )
    country = _lookup(countries, bare(F.try_element_at(parts, F.lit(-1))))
    rest = F.slice(parts, F.lit(1), F.size(parts) - country.isNotNull().cast("int"))
    found = F.transform(rest, state_of)
    at = F.array_max(F.transform(found, lambda s, i: F.when(s.isNotNull(), i)))
    state, first = F.get(found, at), F.lower(F.get(rest, F.lit(0)))
    named = F.when(country.isNotNull(), "_country").otherwise("")
    method = F.concat(F.when(at > 0, "city_").otherwise(""), F.lit("state"), named)
    several = (
        F.when(state.isNotNull() & (F.coalesce(country, F.lit(home)) == home), place(home, state, F.when(at > 0, first), method, 1.0))
        .when(state.isNull() & country.isNotNull(), place(country, empty, first, F.when(first.isNotNull(), "city_country").otherwise("country"), 1.0))
    )
    none = lambda method, sure: place(empty, empty, empty, method, sure)
    known = F.when(F.size(parts) == 1, single).otherwise(several)
    result = F.when(F.coalesce(F.trim(value), F.lit("")) == "", none("empty", 0.0)).when(F.lower(text).isin(remote), none("remote", 1.0)).otherwise(F.coalesce(known, none("unparsed", 0.0)))
    return {"country": result["country"], "state": result["state"], "city": result["city"], "location_method": result["method"], "location_confidence": result["confidence"]}


def split_compound(vocab: DataFrame, value: str, minor: str = "minor") -> DataFrame:
    """The vocabulary with ``parts``: array<struct<text, role>> of a compound field, split once per distinct value."""
    import re

    cut = re.compile(r"\s*(?:;|/|,|\band\b|&|\+)\s*", re.I)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for v in b[value]:
                role, out = "major", []
                for piece in cut.split(v or ""):
                    text = piece.strip()
                    if text.lower().startswith(minor):
                        role, text = "minor", re.sub(rf"^{minor}s?\s*(?:in|:)?\s*", "", text, flags=re.I)
                    if text:
                        out.append({"text": text, "role": role})
                parts.append(out)
            yield b.assign(parts=parts)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vocab.schema), "parts array<struct<text:string,role:string>>"])
    return vocab.mapInPandas(run, schema)


def functional_vote(df: DataFrame, key: str, text: str, keywords: dict[str, list[str]], margin: int) -> DataFrame:
    """Cluster by keyword hits: the one with most, if it leads by ``margin``; else ``unresolved``."""
    words = F.split(F.lower(F.col(text)), " ")

    def counted(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda t: t.isin(known)))

    hits = [F.struct(F.lit(c).alias("cluster"), counted(ws).alias("hits")) for c, ws in keywords.items()]
    votes = df.select(key, F.explode(F.array(*hits)).alias("v")).select(key, "v.*")
    w = Window.partitionBy(key).orderBy(F.desc("hits"), "cluster")
    ranked = votes.withColumns({"rn": F.row_number().over(w), "next": F.lead("hits").over(w)}).filter("rn = 1")
    won = (F.col("hits") > 0) & (F.col("hits") - F.coalesce("next", F.lit(0)) >= margin)
    return ranked.select(key, F.when(won, F.col("cluster")).otherwise("unresolved").alias("cluster"), F.col("hits").cast("long").alias("hits"))


def evidence(df: DataFrame, key: str, person: str, name: str, text: str, most: int) -> DataFrame:
    """Per key: rows, persons, modal name, and its ``most`` most frequent texts in order."""
    base = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(person).alias("persons"))
    mode = top_value(df, [key], name).select(key, F.col(name).alias("modal_name"))
    counts = df.groupBy(key, text).agg(F.count("*").alias("wl_n"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("wl_n"), text))
    tops = counts.withColumn("wl_rn", rn).filter(F.col("wl_rn") <= most).groupBy(key)
    texts = tops.agg(F.transform(F.array_sort(F.collect_list(F.struct("wl_rn", text))), lambda x: x[text]).alias("texts"))
    return base.join(mode, key, "left").join(texts, key, "left")


def head_component(value: Column) -> Column:
    """What stands before the first separator."""
    return F.trim(F.split(F.lower(value), "[,;/(]| - ")[0])


def rating_matrix(long: DataFrame, code: str, item: str, rating: str) -> DataFrame:
    """Per code its z-scored ratings over all items in order, scaled to length 1; incomplete codes are left out."""
    cells = long.groupBy(code, item).agg(F.avg(rating).alias("wl_r"))
    moments = cells.groupBy(item).agg(F.avg("wl_r").alias("wl_m"), F.stddev_pop("wl_r").alias("wl_s"))
    scored = cells.join(moments, item).withColumn("wl_z", F.coalesce(F.try_divide(F.col("wl_r") - F.col("wl_m"), F.col("wl_s")), F.lit(0.0)))
    rows = scored.groupBy(code).agg(F.array_sort(F.collect_list(F.struct(item, "wl_z"))).alias("wl_v"), F.sum(F.col("wl_z") ** 2).alias("wl_l"))
    full = rows.join(F.broadcast(moments.agg(F.count("*").alias("wl_n")))).filter(F.size("wl_v") == F.col("wl_n"))
    return full.select(code, F.transform("wl_v", lambda x: F.round(F.coalesce(F.try_divide(x["wl_z"], F.sqrt("wl_l")), F.lit(0.0)), 6)).alias("vector"))


def backfilled_ratings(long: DataFrame, code: str, item: str, rating: str, crosswalk: DataFrame) -> DataFrame:
    """Ratings of rated codes, and for unrated codes of the ``crosswalk`` (``code``, ``parent``) the mean over the rated codes of their parent.

    ``source`` is ``own`` or the crosswalk; a parent without any rated code gives nothing.
    """
    own = long.groupBy(code, item).agg(F.avg(rating).alias(rating))
    means = own.join(crosswalk.select(code, "parent"), code).groupBy("parent", item).agg(F.avg(rating).alias(rating))
    bare = crosswalk.join(own.select(code).distinct(), code, "left_anti")
    filled = bare.join(means, "parent").select(code, item, rating, F.lit("crosswalk").alias("source"))
    return own.withColumn("source", F.lit("own")).unionByName(filled)
