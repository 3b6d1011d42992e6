"""Rules and taxonomies as tables: phrases that classify titles, tiers that find a value's code, prefixes that place a code.

A value is taken apart into what the rules' keys may be (runs of words, sets of words, prefixes of a code), and these meet
the rules in one join, so a thousand rules make no longer plan than ten, and Spark sends a small table to the tasks itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import compose, fold, match_key, token_key
from wayline.operators.facts import map_values
from wayline.operators.spelling import token_typo_clusters
from wayline.sources.scratch import written


def title_words(title: Column, short: dict[str, str], keep_at: tuple[str, ...] = ("law", "home", "large", "sea")) -> dict[str, Column]:
    """``words`` of a job title with abbreviations written out and without its employer, and ``modifiers`` from its brackets.

    ``short`` maps single words to what they stand for. What follows "at" or @ is an employer unless it begins with a word
    in ``keep_at``; dots inside initials and possessive endings fall away.
    """
    spaced = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "&", " and "), "[^\\p{L}\\p{N}+#]+", " "))
    low = F.regexp_replace(F.regexp_replace(F.lower(title), "['’]s\\b", ""), "\\b(\\p{L})\\.(?=\\p{L}\\b)", "$1")
    inside = F.transform(F.regexp_extract_all(low, F.lit("[(\\[]([^)\\]]*)[)\\]]"), F.lit(1)), spaced)
    bare = F.regexp_replace(F.regexp_replace(low, "[(\\[][^)\\]]*[)\\]]?", " "), "\\s*@.*$", "")
    held = "|".join(keep_at) or "$."
    bare = F.regexp_replace(bare, f"(?<=\\S)\\s+at\\s+(?!(?:{held})\\b|(?:{'|'.join(f'the {w}' for w in keep_at) or '$.'})\\b).*$", "")
    words = F.split(spaced(bare), " ")
    if short:
        known = F.create_map(*(F.lit(x) for pair in short.items() for x in pair))
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))
    return {"words": F.array_join(words, " "), "modifiers": F.filter(inside, lambda m: m != "")}


def phrase_hits(vocab: DataFrame, value: str, words: str, rules: DataFrame) -> DataFrame:
    """``value``, ``axis``, ``label``, ``rank`` (least), ``exact``, ``confidence`` of the rules whose phrase stands in the value's words.

    ``rules`` has ``axis``, ``rank``, ``phrase`` (words with spaces between), ``label``, ``confidence``, ``exact`` (the phrase
    must be all there is) and ``blocks``: a phrase that, where it stands, takes away the label of its axis.
    """
    longest = rules.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1  # one number
    tokens = F.split(words, " ")
    n = F.size(tokens)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.array_join(F.slice(tokens, i + 1, k), " "))))
    asked = vocab.filter(F.col(words) != "").select(value, F.col(words).alias("wl_all"), F.explode(F.array_distinct(runs)).alias("phrase"))
    met = asked.join(rules, "phrase").filter(~F.col("exact") | (F.col("phrase") == F.col("wl_all")))
    place = F.when(~F.col("blocks"), F.struct((~F.col("exact")).alias("e"), F.col("rank").alias("r"), F.col("confidence").alias("c")))
    per = met.groupBy(value, "axis", "label").agg(F.bool_or("blocks").alias("wl_b"), F.min(place).alias("wl_p"))
    return per.filter("not wl_b and wl_p is not null").select(value, "axis", "label", F.col("wl_p.r").alias("rank"), (~F.col("wl_p.e")).alias("exact"), F.col("wl_p.c").alias("confidence"))


def classify_titles(vocab: DataFrame, value: str, words: str, modifiers: str, rules: DataFrame, default_level: str = "mid", entry_level: str = "entry") -> DataFrame:
    """``value``, ``family``, ``seniority``, ``flags`` (sorted), ``confidence`` of each title of a vocabulary.

    An exact rule comes first, then the least rank. Seniority is that of the least rank too, ``default_level`` without one;
    interns are always at level intern, students at ``entry_level`` unless something else raises them. Flags are all that
    hit in the words or the modifiers, and not the family's own name; an intern outside that family is flagged. What no
    rule finds is ``unclassified`` and ``low``.
    """
    hits = phrase_hits(vocab, value, words, rules)
    more = vocab.select(value, F.explode(modifiers).alias("wl_m")).filter("wl_m <> ''").distinct()
    said = phrase_hits(more.withColumn("wl_k", F.struct(value, "wl_m")), "wl_k", "wl_m", rules.filter("axis = 'flag'")).select(F.col(f"wl_k.{value}").alias(value), "axis", "label", "rank", "exact", "confidence")
    every = hits.unionByName(said)
    best = lambda axis: F.min(F.when(F.col("axis") == axis, F.struct((~F.col("exact")).alias("e"), "rank", "label", "confidence")))
    per = every.groupBy(value).agg(best("family").alias("wl_f"), best("seniority").alias("wl_s"), F.array_sort(F.collect_set(F.when(F.col("axis") == "flag", F.col("label")))).alias("wl_flags"))
    j = vocab.select(value).distinct().join(per, value, "left")
    family, level = F.coalesce("wl_f.label", F.lit("unclassified")), F.coalesce("wl_s.label", F.lit(default_level))
    level = F.when(family == "intern", "intern").when((family == "student") & level.isin(default_level, entry_level), entry_level).otherwise(level)
    flags = F.coalesce("wl_flags", F.array().cast("array<string>"))
    flags = F.when((level == "intern") & (family != "intern"), F.array_union(flags, F.array(F.lit("intern")))).otherwise(flags)
    return j.select(value, family.alias("family"), level.alias("seniority"), F.array_sort(F.array_except(flags, F.array(family))).alias("flags"), F.coalesce("wl_f.confidence", F.lit("low")).alias("confidence"))


def normal_forms(vocab: DataFrame, value: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``norm`` (match key), ``safe`` (that, or the lower-case text of other scripts) and ``tokens`` (its words in order, once each, without ``stop``)."""
    v = compose(fold(vocab, value, "wl_folded"), value, "wl_nfkc").withColumn("norm", match_key(F.col("wl_folded")))
    kept = F.array_join(F.filter(F.split("norm", " "), lambda t: ~t.isin(list(stop))), " ") if stop else F.col("norm")
    plain = F.trim(F.regexp_replace(F.lower("wl_nfkc"), "\\s+", " "))
    return v.withColumns({"safe": F.when(F.col("norm") != "", F.col("norm")).otherwise(plain), "tokens": token_key(F.when(kept != "", kept).otherwise(F.col("norm")))}).drop("wl_folded", "wl_nfkc")


def tiered_codes(vocab: DataFrame, value: str, freq: str, tiers: list[tuple[str, float, str, DataFrame]], kind: str, raw: str, own: str | None = None, own_method: str = "own", stop: tuple[str, ...] = (), least: int = 4) -> DataFrame:
    """``value``, ``canonical_id``, ``method``, ``confidence``: the first tier that knows a value, else its likely spelling, else itself.

    A tier is (method, confidence, which of norm and tokens it asks for, table with ``key`` and ``code``); of several codes
    for a key the least counts. ``own`` is a column with the value's own code, which comes first. Ids are ``kind:code``. A
    value that no tier knows and that differs from a more frequent one by typing errors alone takes its id (``typo_to_<kind>``,
    0.9), or its name if that has none (``typo``, 0.85); under ``least`` letters, or in other scripts, it stays ``raw``, 0.5.
    """
    v = normal_forms(vocab, value, stop)
    made = [(F.col(own), own_method, 1.0)] if own else []
    for i, (method, confidence, asks, table) in enumerate(tiers):
        known = table.filter("key <> ''").groupBy("key").agg(F.min("code").alias(f"wl_c{i}")).withColumnRenamed("key", f"wl_k{i}")
        v = v.join(known, F.col(asks) == F.col(f"wl_k{i}"), "left")
        made.append((F.col(f"wl_c{i}"), method, confidence))
    itself = F.struct(F.concat(F.lit(f"{raw}:"), "safe").alias("canonical_id"), F.lit("raw").alias("method"), F.lit(0.5).alias("confidence"))
    first = reduce(lambda rest, t: F.when(t[0].isNotNull(), F.struct(F.concat(F.lit(f"{kind}:"), t[0].cast("string")).alias("canonical_id"), F.lit(t[1]).alias("method"), F.lit(t[2]).alias("confidence"))).otherwise(rest), reversed(made), itself)
    named = written(v.select(F.col(value).alias("value"), F.col(freq).alias("freq"), "norm", "safe", first.alias("t")), "tiers")
    spelt = token_typo_clusters(named, "value", "freq", "norm", stop=stop).filter("value <> representative")
    chief = named.select(F.col("value").alias("representative"), F.col("t.canonical_id").alias("theirs"), F.col("safe").alias("their_safe"))
    j = named.join(spelt, "value", "left").join(chief, "representative", "left")
    open_ = (F.col("t.method") == "raw") & (F.length("norm") >= least) & F.col("representative").isNotNull()
    coded = open_ & F.startswith(F.col("theirs"), F.lit(f"{kind}:"))
    typo = lambda i, m, c: F.struct(i.alias("canonical_id"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    found = F.when(coded, typo(F.col("theirs"), f"typo_to_{kind}", 0.9)).when(open_, typo(F.concat(F.lit(f"{raw}:"), "their_safe"), "typo", 0.85)).otherwise(F.col("t"))
    return j.select("value", found.alias("t")).select("value", "t.*")


def guarded_crosswalk(vocab: DataFrame, name: str, code: str, freq: str, share: float = 0.98, lead: int = 10) -> DataFrame:
    """``key`` (normal form) and ``code``: names whose rows all have one code, or nearly all and well ahead of the second."""
    v = normal_forms(vocab.filter(F.col(code).isNotNull()), name).filter("norm <> ''")
    per = v.groupBy("norm", code).agg(F.sum(freq).alias("n"))
    ranked = per.groupBy("norm").agg(F.sum("n").alias("t"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(code).alias("c")))), 1, 2).alias("top"))
    first, second = -F.col("top")[0]["m"], -F.get("top", F.lit(1))["m"]
    sure = second.isNull() | ((first >= share * F.col("t")) & (first - second >= lead))
    return ranked.filter(sure).select(F.col("norm").alias("key"), F.col("top")[0]["c"].alias("code"))


def degree_codes(vocab: DataFrame, value: str, abbreviations: DataFrame, rules: DataFrame, fields: DataFrame, blanks: list[str]) -> DataFrame:
    """``value``, ``canonical_id`` (level:type), ``method``, ``confidence`` of degrees, and ``field_code`` where the cell names a field.

    ``abbreviations`` has ``key`` (letters and digits alone) and ``code``; ``rules`` as for ``phrase_hits`` with axis
    ``degree``; ``fields`` has ``key`` (normal form) and ``code``. A cell in ``blanks``, or without letters, says nothing. A
    cell that is no degree but a field is blank as a degree; of one that is, what follows " in " may name a field.
    """
    v = normal_forms(vocab.select(value).distinct(), value)
    v = v.withColumns({"compact": F.regexp_replace("norm", "[^a-z0-9]", ""), "subject": F.when(F.instr("norm", " in ") > 0, F.regexp_replace("norm", "^.*? in ", ""))})
    v = v.join(abbreviations.groupBy("key").agg(F.min("code").alias("wl_abbr")), F.col("compact") == F.col("key"), "left").drop("key")
    hits = phrase_hits(v, value, "norm", rules.filter("axis = 'degree'")).groupBy(value).agg(F.min(F.struct((~F.col("exact")).alias("e"), "rank", "label"))["label"].alias("wl_rule"))
    of = fields.groupBy("key").agg(F.min("code").alias("code"))
    v = v.join(hits, value, "left").join(of.toDF("wl_n", "wl_whole"), F.col("norm") == F.col("wl_n"), "left").join(of.toDF("wl_s", "wl_part"), F.col("subject") == F.col("wl_s"), "left")
    blank = F.col("safe").isin(blanks) | ~F.col("safe").rlike("\\p{L}")
    degree = F.coalesce("wl_abbr", "wl_rule")
    swapped = degree.isNull() & F.col("wl_whole").isNotNull()
    made = lambda i, m, c: F.struct(i.alias("canonical_id"), F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    nothing = F.lit("degree_raw:__blank__")
    found = (
        F.when(blank, made(nothing, "raw", 0.5)).when(F.col("wl_abbr").isNotNull(), made(F.col("wl_abbr"), "taxonomy_abbrev", 1.0)).when(F.col("wl_rule").isNotNull(), made(F.col("wl_rule"), "taxonomy", 1.0))
        .when(swapped, made(nothing, "code_from_degree", 0.9)).otherwise(made(F.concat(F.lit("degree_raw:"), "safe"), "raw", 0.5))
    )
    field = F.when(~blank, F.when(swapped, F.col("wl_whole")).when(degree.isNotNull(), F.col("wl_part")))
    return v.select(value, found.alias("t"), field.alias("field_code")).select(value, "t.*", "field_code")


def digit_prefixes(low: str, high: str) -> list[str]:
    """The fewest prefixes that cover the codes of equal length from ``low`` to ``high``: 1200 to 1399 are 12 and 13."""
    n, at, end, out = len(low), int(low), int(high), []
    if len(high) != n or at > end:
        raise ValueError(f"no range: {low} to {high}")
    while at <= end:
        k = 0
        while k < n and at % 10 ** (k + 1) == 0 and at + 10 ** (k + 1) - 1 <= end:
            k += 1
        out.append(str(at).zfill(n)[: n - k])
        at += 10**k
    return out


def code_levels(codes: DataFrame, code: str, rules: list[tuple[str, str | None, int, str]], none: str = "Other", deepest: int = 3) -> DataFrame:
    """``code``, ``level`` (0: outside), nested flags ``within_1`` to ``within_<deepest>``, and ``grp``, by the longest rule that covers a code.

    A rule is (low, high, level, group): a prefix, or a range of prefixes of one length; level 0 takes codes out again. Dots
    are not part of a prefix; a tag before a colon is not part of a code. Level 1 lies within 2, and 2 within 3. Two rules
    of one length for the same code are an error.
    """
    table: dict[str, tuple[int, str]] = {}
    for low, high, level, group in rules:
        a, b = low.replace(".", ""), (high or low).replace(".", "")
        for p in digit_prefixes(a, b):
            if table.setdefault(p, (level, group)) != (level, group):
                raise ValueError(f"two rules for {p}")
    spark = codes.sparkSession
    trie = spark.createDataFrame([(p, *v) for p, v in table.items()], "wl_p string, level int, grp string")
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.col(code))), "^[a-z]+:", ""), "\\.", "")
    named = codes.select(code).distinct().withColumn("wl_bare", F.coalesce(bare, F.lit("")))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("wl_bare")), lambda k: F.substring(F.col("wl_bare"), F.lit(1), k))
    asked = named.filter("wl_bare <> ''").select(F.col(code).alias("wl_code"), F.explode(prefixes).alias("wl_p"))
    best = asked.join(trie, "wl_p").groupBy("wl_code").agg(F.max_by(F.struct("level", "grp"), F.length("wl_p")).alias("wl_b"))
    j = named.join(best, F.col(code).eqNullSafe(F.col("wl_code")), "left")
    level = F.coalesce("wl_b.level", F.lit(0))
    return j.select(code, level.alias("level"), *(level.between(1, k).alias(f"within_{k}") for k in range(1, deepest + 1)), F.coalesce("wl_b.grp", F.lit(none)).alias("grp"))


def functional_cluster(
    rows: DataFrame, key: str, code: str, title: str, company: str, company_id: str, description: str, employment: str, qualifiers: DataFrame, rules: DataFrame, noise: tuple[str, ...] = ("55",),
    open_types: tuple[str, ...] = ("business_owner", "self_employed"),
) -> DataFrame:
    """``key``, ``cluster``, ``method``, ``confidence`` of each row by the first evidence that tells its field of work.

    In this order: the major group of the row's own ``code`` (not one in ``noise``), 1.0; ``qualifiers`` (``value``: a title,
    ``cluster``), 0.8; a phrase in the title, 0.7; one in the name of a company without an id, 0.6; the cluster that most
    phrases of the description name, if it leads, 0.5 and 0.05 more for each further phrase up to 0.65; else what is left
    of the employment type, unspecified, 0.5. ``rules`` are as for ``phrase_hits`` with axes title, company and description.
    Titles and companies are classified once per value; descriptions row by row.
    """
    def classified(column: str, axis: str, name: str) -> DataFrame:
        values = normal_forms(rows.select(F.col(column).alias("value")).filter("value is not null").distinct(), "value")
        hits = phrase_hits(values, "value", "norm", rules.filter(F.col("axis") == axis))
        return hits.groupBy("value").agg(F.min(F.struct((~F.col("exact")).alias("e"), "rank", "label"))["label"].alias(name))

    mapped = map_values(rows, [key], {"wl_q": (title, qualifiers.select("value", F.col("cluster").alias("by_qualifier"))), "wl_t": (title, classified(title, "title", "by_title")), "wl_b": (company, classified(company, "company", "by_company"))})
    texts = normal_forms(rows.select(key, F.col(description).alias("wl_d")).filter("wl_d is not null"), "wl_d").select(key, "norm")
    said = phrase_hits(texts, key, "norm", rules.filter("axis = 'description'").withColumn("label", F.concat_ws("\x1f", "label", "phrase")))
    votes = said.groupBy(key, F.split_part("label", F.lit("\x1f"), F.lit(1)).alias("c")).agg(F.count("*").alias("n"))
    top = votes.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "c"))), 1, 2).alias("v"))
    led = top.filter(F.get("v", F.lit(1)).isNull() | (F.col("v")[0]["m"] < F.get("v", F.lit(1))["m"])).select(F.col(key).alias("wl_key"), F.col("v")[0]["c"].alias("wl_dc"), (-F.col("v")[0]["m"]).alias("wl_dn"))
    j = mapped.join(led, F.col(key) == F.col("wl_key"), "left")
    major = F.nullif(F.left(F.col(code), F.lit(2)), F.lit(""))
    nobody = F.coalesce(F.trim(F.col(company_id)), F.lit("")) == ""
    kind = F.coalesce(F.col(employment), F.lit("self_employed"))
    tiers = [
        (F.when(~major.isin(list(noise)), major), "code", F.lit(1.0)), (F.col("wl_q.by_qualifier"), "qualifier", F.lit(0.8)), (F.col("wl_t.by_title"), "title_keyword", F.lit(0.7)),
        (F.when(nobody, F.col("wl_b.by_company")), "company_brand", F.lit(0.6)), (F.col("wl_dc"), "description", F.round(F.least(F.lit(0.65), 0.45 + 0.05 * F.col("wl_dn")), 2)),
        (F.when(kind.isin(list(open_types)), F.concat(kind, F.lit("_unspecified"))).otherwise("unspecified"), "unspecified", F.lit(0.5)),
    ]
    found = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("cluster"), F.lit(m).alias("method"), s.alias("confidence"))) for c, m, s in tiers))
    return j.select(key, found.alias("t")).select(key, "t.*")
