"""Fact tables with the origin of each value: employment steps of two grains, education rows, one row per person.

Value mappings (value to canonical id, method, confidence and more) are joined together: the facts' values go out as narrow
(row, mapping, value) rows, meet all mappings in one join, and come back as one row of structs per fact. Wide rows move once,
however many mappings there are; null values, usually the most frequent, do not move at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.company import _first
from wayline.operators.windows import duplicate_flag

#: English month names as profiles write them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SCHOOL_PAGE = "/school/([^/?#]+)"


def map_values(facts: DataFrame, keys: list[str], mappings: dict[str, tuple[str, DataFrame]], prefix: str = "") -> DataFrame:
    """The facts with a struct column per mapping, named after it behind ``prefix``, null where a value has no entry; as many rows as before.

    ``keys`` tell the facts' rows apart (null counts as a value). A mapping is (column of the facts, table with ``value`` and
    result columns; columns of one name have one type in all tables); of several entries for a value the least counts. A
    null value takes the mapping's entry for null.
    """
    tables, fields = [], {}
    for name, (_, table) in mappings.items():
        fields[name] = [c for c in table.columns if c != "value"]
        tables.append(table.withColumn("value", F.col("value").cast("string")).withColumn("wl_map", F.lit(name)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    found = F.struct(*[c for c in every.columns if c not in ("value", "wl_map")])
    known = every.filter("value is not null").groupBy("wl_map", "value").agg(F.min(found).alias("wl_found"))
    row = [F.col(k).alias(f"wl_k{i}") for i, k in enumerate(keys)]
    names = [f"wl_k{i}" for i in range(len(keys))]
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("wl_map"), F.col(c).cast("string").alias("value")) for n, (c, _) in mappings.items())))
    asked = facts.select(*row, asked.alias("wl_x")).select(*names, "wl_x.*").filter("value is not null")
    back = asked.join(known, ["wl_map", "value"]).groupBy(*names).agg(*(F.max(F.when(F.col("wl_map") == n, F.col("wl_found"))).alias(f"wl_m_{n}") for n in mappings))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    out = facts.join(back, same, "left")
    of_null = every.filter("value is null").groupBy().agg(*(F.min(F.when(F.col("wl_map") == n, found)).alias(f"wl_n_{n}") for n in mappings))
    out = out.join(F.broadcast(of_null))  # one row
    picked = {n: F.when(F.col(c).isNull(), F.col(f"wl_n_{n}")).otherwise(F.col(f"wl_m_{n}")) for n, (c, _) in mappings.items()}
    narrow = {n: F.when(x.isNotNull(), F.struct(*(x[c].alias(c) for c in fields[n]))) for n, x in picked.items()}
    return out.select(*(F.col(f"`{c}`") for c in facts.columns), *(x.alias(prefix + n) for n, x in narrow.items()))


def after(identifier: Column, kind: str) -> Column:
    """What follows ``kind:`` in an id, null for other kinds."""
    return F.when(F.startswith(identifier, F.lit(f"{kind}:")), F.substring(identifier, F.lit(len(kind) + 2), F.length(identifier)))


def date_columns(prefix: str, text: Column) -> dict[str, Column]:
    """``<prefix>_year`` and ``<prefix>_month`` of dates written as ``Mon YYYY`` or ``YYYY``; other texts have neither."""
    year = F.nullif(F.regexp_extract(text, "((?:19|20)[0-9][0-9])", 1), F.lit(""))
    name = F.regexp_extract(text, f"({'|'.join(MONTHS)})", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return {f"{prefix}_year": year.cast("smallint"), f"{prefix}_month": F.nullif(month, F.lit(0)).cast("tinyint")}


def two_grains(experience: DataFrame, positions: DataFrame, parent: list[str], position: str, from_parent: list[str]) -> DataFrame:
    """``source_table`` and the rows of both grains: positions, and experiences that have none.

    ``parent`` columns name an experience in both tables; positions take the columns ``from_parent`` from it, the least
    where it stands twice. Other columns are those that both tables have.
    """
    shared = [c for c in experience.columns if c in positions.columns and c not in (*parent, *from_parent)]
    columns = [*parent, position, *from_parent, *shared]
    single = experience.join(positions.select(*parent), parent, "left_anti").withColumn(position, F.lit(None).cast(positions.schema[position].dataType))
    above = experience.groupBy(*parent).agg(F.min(F.struct(*from_parent)).alias("wl_p"))
    child = positions.select(*parent, position, *shared).join(above, parent, "left").select(*parent, position, *shared, *(F.col(f"wl_p.{c}").alias(c) for c in from_parent))
    return single.select(F.lit("experience").alias("source_table"), *columns).unionByName(child.select(F.lit("position").alias("source_table"), *columns))


def career_facts(steps: DataFrame, keys: list[str], maps: dict[str, DataFrame], overrides: DataFrame, clusters: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """One row per step of ``two_grains`` with canonical values, each with method and confidence.

    ``maps`` are tables by value: ``company`` (canonical_id, method, confidence), ``alias`` (canonical_id of a company id),
    ``title`` (canonical_id as title:seniority|role, method, confidence, employment_status, employment_solo,
    employment_owner, jury_major: the vote on the role), ``occupation`` (canonical_id as soc:code, method, confidence),
    ``family`` (family, anchor, landable) and ``place`` (country). ``overrides`` (code_override, major_override) and
    ``clusters`` (functional_cluster) have the row's keys. ``buckets`` name the employment of placeholders that differ.

    The company is a placeholder, the row's own id, a school's page, or its name's; the employment the title's status, the
    placeholder's, a solo or owner marker's, or employee; the major group that of an override, the code, the jury, or a
    family that may land where no cluster tells it. Identical steps of a person after the first are duplicates.
    """
    columns = {"company": "company", "alias": "wl_own", "title": "title", "occupation": "title", "family": "title", "place": "location"}
    raw = F.struct("company", "company_id", "title", "location")  # the mapped structs take these names
    rows = steps.withColumns({"wl_own": F.nullif(F.trim("company_id"), F.lit("")), "wl_raw": raw})
    mapped = map_values(rows, keys, {n: (columns[n], t) for n, t in maps.items()}, "wl_to_")
    m = mapped.drop("company", "title").withColumnsRenamed({f"wl_to_{n}": n for n in maps})
    for extra in (overrides, clusters):
        renamed = extra.select(*(F.col(c).alias(f"wl_j{i}" if c in keys else c) for i, c in enumerate(extra.columns)))
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"wl_j{extra.columns.index(k)}")) for k in keys))
        m = m.join(renamed, on, "left").drop(*(f"wl_j{extra.columns.index(k)}" for k in keys))
    own, page = F.coalesce("alias.canonical_id", "wl_own"), F.nullif(F.lower(F.regexp_extract("url", SCHOOL_PAGE, 1)), F.lit(""))
    placeholder = F.col("company.method") == "placeholder"
    company = F.coalesce(
        _first([
            (placeholder, F.col("company.canonical_id"), "placeholder", 1.0),
            (F.col("wl_own").isNotNull(), F.concat(F.lit("id:"), own), "company_id", 1.0),
            (page.isNotNull(), F.concat(F.lit("id:"), page), "school_url", 0.98),
        ]),
        F.struct(F.col("company.canonical_id").alias("company"), F.col("company.method").alias("method"), F.col("company.confidence").alias("confidence")),
    )
    bucket = after(F.col("company.canonical_id"), "nonorg")
    employment = _first([
        (F.col("title.employment_status").isNotNull(), F.col("title.employment_status"), "title_status", 1.0),
        (placeholder, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in buckets.items() for x in pair)), bucket), bucket) if buckets else bucket, "company_placeholder", 1.0),
        (F.coalesce("title.employment_solo", F.lit(False)), F.lit("self_employed"), "title_solo_marker", 0.95),
        (F.coalesce("title.employment_owner", F.lit(False)), F.lit("business_owner"), "title_owner_marker", 0.9),
        (F.lit(True), F.lit("employee"), "default_employee", 0.8),
    ])
    code = after(F.col("occupation.canonical_id"), "soc")
    lands = F.coalesce("family.landable", F.lit(False)) & F.col("functional_cluster").isNull()
    titled = after(F.col("title.canonical_id"), "title")
    raw = {c: f"{c}_raw" for c in ("company", "company_id", "title", "location")}
    named = m.select(
        *keys, *(F.col(f"wl_raw.{c}").alias(n) for c, n in raw.items()),
        company["company"].alias("company_canonical_id"), F.when(~F.coalesce(placeholder, F.lit(False)), after(company["company"], "id")).alias("company_id_canonical"),
        company["method"].alias("company_method"), company["confidence"].alias("company_confidence"),
        employment["company"].alias("employment_type"), employment["method"].alias("employment_type_method"), employment["confidence"].alias("employment_type_confidence"),
        F.col("title.canonical_id").alias("title_canonical_id"), F.nullif(F.split_part(titled, F.lit("|"), F.lit(1)), F.lit("")).alias("seniority_level"),
        F.when(titled.contains("|"), F.regexp_replace(titled, "^[^|]*\\|", "")).alias("role_canonical"), F.col("title.method").alias("title_method"), F.col("title.confidence").alias("title_confidence"),
        code.alias("occupation_code"), F.col("occupation.method").alias("occupation_method"), F.col("occupation.confidence").alias("occupation_confidence"),
        F.coalesce("major_override", F.left(code, F.lit(2)), "title.jury_major", F.when(lands, F.col("family.anchor"))).alias("occupation_major_pooled"),
        F.when(code.isNotNull(), "det").when(F.col("major_override").isNotNull(), "override").when(F.col("title.jury_major").isNotNull(), "jury").when(lands, "family").alias("occupation_source"),
        F.coalesce("code_override", code).alias("occupation_code_pooled"), F.when(F.col("code_override").isNotNull(), "override").when(code.isNotNull(), "det").alias("occupation_code_source"),
        F.col("family.family").alias("title_family"), "functional_cluster", F.col("place.country").alias("location_country"), "start_date", "end_date",
        *(c.alias(n) for side in ("start", "end") for n, c in date_columns(side, F.col(f"{side}_date")).items()), F.coalesce(F.trim("end_date") == "Present", F.lit(False)).alias("is_current"),
    )
    person, *rest = [k for k in keys if k != "source_table"]
    order = [F.col("source_table"), *(F.asc_nulls_first(k) for k in rest)]
    return duplicate_flag(named, [person, "company_raw", "title_raw", "start_date", "end_date"], order)


def education_facts(rows: DataFrame, keys: list[str], maps: dict[str, DataFrame], levels: dict[str, int], groups: DataFrame, last_year: int, blank: str = "field_raw:__blank__") -> DataFrame:
    """One row per education entry (school, degree, field, start_year, end_year, url) with canonical values and their origin.

    ``maps`` by value: ``school``, ``degree``, ``field`` and ``degree_field`` (a degree cell that names a field), each with
    canonical_id, method, confidence. The row's own school page beats the name's school. A field from the degree cell fills
    in where the field cell tells nothing (null or ``blank``). Codes are cut to two and four digits; ``groups`` has ``code``,
    ``group_level`` and ``field_group``. ``levels`` orders degrees. Years past ``last_year`` are in progress; identical
    entries of a person (the first key) after the first by the other keys are duplicates.
    """
    columns = {"school": "school", "degree": "degree", "field": "field", "degree_field": "degree"}
    m = map_values(rows, keys, {n: (columns[n], t) for n, t in maps.items()}, "to_")
    page = F.nullif(F.regexp_extract("url", SCHOOL_PAGE, 1), F.lit(""))
    degree, kind = F.col("to_degree.canonical_id"), F.split_part(F.col("to_degree.canonical_id"), F.lit(":"), F.lit(1))
    own, other = F.col("to_field.canonical_id"), F.col("to_degree_field.canonical_id")
    backfilled = other.isNotNull() & (own.isNull() | (own == blank))
    field = F.when(backfilled, other).otherwise(own)
    code = after(field, "cip")
    first, second = F.split_part(code, F.lit("."), F.lit(1)), F.split_part(code, F.lit("."), F.lit(2))
    level = F.try_element_at(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)), kind)
    year = lambda c: F.expr(f"try_cast({c} AS smallint)")
    shaped = m.select(
        *keys, F.col("school").alias("school_raw"), F.coalesce(F.concat(F.lit("slug:"), page), "to_school.canonical_id").alias("school_canonical_id"),
        F.coalesce(page, after(F.col("to_school.canonical_id"), "slug")).alias("school_slug"), F.when(page.isNotNull(), "slug").otherwise(F.col("to_school.method")).alias("school_method"),
        F.when(page.isNotNull(), 1.0).otherwise(F.col("to_school.confidence")).alias("school_confidence"),
        F.col("degree").alias("degree_raw"), degree.alias("degree_canonical_id"), level.cast("tinyint").alias("degree_level"),
        F.when(kind != "degree_raw", F.split_part(degree, F.lit(":"), F.lit(2))).alias("degree_type"), F.col("to_degree.method").alias("degree_method"), F.col("to_degree.confidence").alias("degree_confidence"),
        F.col("field").alias("field_raw"), field.alias("field_canonical_id"), code.alias("code"), first.alias("code2"),
        F.when(F.length(second) >= 2, F.concat(first, F.lit("."), F.left(second, F.lit(2)))).alias("code4"),
        F.when(backfilled, "code_from_degree").otherwise(F.col("to_field.method")).alias("field_method"), F.when(backfilled, 0.9).otherwise(F.col("to_field.confidence")).alias("field_confidence"),
        year("start_year").alias("start_year"), year("end_year").alias("end_year"),
    )
    known = groups.groupBy("code").agg(F.min(F.struct("group_level", "field_group")).alias("wl_g"))
    joined = shaped.join(known, "code", "left").select(*shaped.columns, F.col("wl_g.group_level").alias("group_level"), F.col("wl_g.field_group").alias("field_group"))
    joined = joined.withColumn("in_progress", F.coalesce(F.col("end_year") > last_year, F.lit(False)))
    return duplicate_flag(joined, [keys[0], "school_raw", "degree_raw", "field_raw", "start_year", "end_year"], [F.col(k) for k in keys[1:]])


def education_rollup(facts: DataFrame, person: str, idx: str, bachelor: int) -> DataFrame:
    """One row per person from the entries of ``education_facts`` that are no duplicates, in one aggregation.

    The highest degree and the last year that has it, the first year of a ``bachelor``, first and last year of any; code and
    groups of the entry with a code of the highest degree (then the latest, then the first), likewise the school; whether any
    entry, or any bachelor's, is in group 1, within 2, within 3.
    """
    level, end = F.col("degree_level"), F.col("end_year")
    order = F.struct(F.coalesce(level, F.lit(-1)).alias("l"), F.coalesce(end, F.lit(-32768)).alias("e"), (-F.col(idx)).alias("i"))
    pick = lambda has, *cs: F.max_by(F.struct(*cs), F.when(has, order))
    group = F.col("group_level")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    terminal, school = pick(F.col("code").isNotNull(), "code", "code2", "code4", "group_level", "field_group"), pick(F.col("school_slug").isNotNull(), "school_slug")
    per = facts.filter("not is_duplicate").groupBy(person).agg(
        F.count("*").alias("n_rows"), F.max("degree_level").alias("highest_level"), F.max(F.when(level.isNotNull(), F.struct(level.alias("l"), end.alias("e")))).alias("wl_h"),
        F.min(F.when(level == bachelor, end)).alias("bachelor_year"), F.min("end_year").alias("first_year"), F.max("end_year").alias("last_year"),
        F.when(F.count(F.when(F.col("code").isNotNull(), 1)) > 0, terminal).alias("wl_t"), F.when(F.count("school_slug") > 0, school).alias("wl_s"),
        any_(group == 1).alias("group1_any"), any_(group <= 2).alias("group2_any"), any_(group <= 3).alias("group3_any"), any_((group == 1) & (level == bachelor)).alias("group1_bachelor_any"),
    )
    rolled = per.select("*", F.col("wl_h.e").alias("highest_year"), "wl_t.*", F.col("wl_s.school_slug").alias("school_slug"))
    return rolled.drop("wl_h", "wl_t", "wl_s")


def institution_columns(people: DataFrame, slug: str, crosswalk: DataFrame, meta: DataFrame, unit: str, take: list[str]) -> DataFrame:
    """The rows with ``inst_<unit>`` and ``inst_<column>`` of the institution that a school's slug stands for; as many rows as before.

    ``crosswalk`` has the slug and the unit, ``meta`` one row per unit; of a slug's units the least counts. Columns of an
    earlier run are replaced.
    """
    added = [f"inst_{c}" for c in (unit, *take)]
    chosen = crosswalk.filter(F.col(slug).isNotNull()).groupBy(slug).agg(F.min(unit).alias(unit))
    rows = meta.groupBy(unit).agg(F.min(F.struct(*take)).alias("wl_m"))
    known = chosen.join(rows, unit).select(F.col(slug).alias("wl_slug"), F.col(unit).alias(added[0]), *(F.col(f"wl_m.{c}").alias(f"inst_{c}") for c in take))
    base = people.drop(*added)
    return base.join(known, F.col(slug) == F.col("wl_slug"), "left").drop("wl_slug")
