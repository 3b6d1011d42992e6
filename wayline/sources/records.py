"""Nested JSON records to a star schema, tolerant of bad lines; delimited files; keyed caches; typed empty inputs."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """An output column: its type (string, bigint, double, boolean) and the dotted path it comes from."""

    name: str
    type: str = "string"
    path: str | None = None


@dataclass(frozen=True)
class Child:
    """A list of objects (or of scalars, without ``fields``) that becomes a table, and its own lists."""

    name: str
    path: str
    fields: tuple[Field, ...] = ()
    children: tuple[Child, ...] = ()


@dataclass(frozen=True)
class Record:
    name: str
    key: str
    fields: tuple[Field, ...]
    children: tuple[Child, ...] = field(default=())


def _nest(paths: list[str], lists: list[Child]) -> T.StructType:
    """All leaves as strings, so that no odd value spoils its record."""
    heads: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        heads.setdefault(head, []).extend([rest] if rest else [])
    fields = [T.StructField(h, _nest(r, []) if r else T.StringType()) for h, r in heads.items()]
    for c in lists:
        item = _nest([f.path or f.name for f in c.fields], list(c.children)) if c.fields else T.StringType()
        fields.append(T.StructField(c.path, T.ArrayType(item)))
    return T.StructType(fields)


def schema_of(spec: Record) -> T.StructType:
    return _nest([spec.key, *(f.path or f.name for f in spec.fields)], list(spec.children))


def read_lines(spark: SparkSession, path: str, spec: Record, glob: str = "*.jsonl") -> DataFrame:
    """One row per line with ``rec`` (null if malformed or not an object), ``bad``, ``source_file`` and ``source_row``.

    Rows are numbered by block: each block of a file numbers its lines, and the counts of the blocks before it are added, so
    that a large file is not one task.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("wl_f"), F.col("_metadata.file_block_start").alias("wl_b"), F.monotonically_increasing_id().alias("wl_at")
    )
    lines = lines.filter(F.trim("value") != "")
    block = ["wl_f", "wl_b"]
    counts = lines.groupBy(*block).agg(F.count("*").alias("wl_n"))
    earlier = F.coalesce(F.sum("wl_n").over(Window.partitionBy("wl_f").orderBy("wl_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = lines.withColumn("wl_i", F.row_number().over(Window.partitionBy(*block).orderBy("wl_at")))
    numbered = inside.join(counts.select(*block, earlier.alias("wl_before")), block)
    return _parsed(numbered, spec).withColumn("source_row", (F.col("wl_i") + F.col("wl_before")).cast("int")).drop("wl_at", "wl_i", "wl_before", *block)


def parse(lines: DataFrame, value: str, spec: Record) -> DataFrame:
    """The same for JSON text in a column; blank lines are skipped."""
    return _parsed(lines.withColumnRenamed(value, "value").filter(F.trim("value") != ""), spec)


def _parsed(lines: DataFrame, spec: Record) -> DataFrame:
    schema = T.StructType([*schema_of(spec), T.StructField("_corrupt", T.StringType())])
    rec = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("*", F.explode(F.array(rec)).alias("rec"))  # a generator's row is used by name, so a line is parsed once
    bad = F.col("rec").isNull() | F.col("rec._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.withColumns({"bad": bad, "rec": F.when(~bad, F.col("rec"))}).drop("value")


def coerce(value: Column, kind: str) -> Column:
    """Text to a type or null: thousands separators fall away, a boolean is no number, structures stay JSON text."""
    text = F.trim(value)
    if kind in ("bigint", "double"):
        return F.regexp_replace(text, ",", "").try_cast(kind)
    if kind == "boolean":
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    return value


def parent_table(parsed: DataFrame, spec: Record, carry: tuple[str, ...] = ()) -> DataFrame:
    good = parsed.filter("not bad")
    return good.select(F.col(f"rec.{spec.key}").alias(spec.key), *(coerce(F.col(f"rec.{f.path or f.name}"), f.type).alias(f.name) for f in spec.fields), *carry)


def child_table(parsed: DataFrame, spec: Record, *route: str) -> DataFrame:
    """The table of a list, reached by its names from the top; the index of each list on the way is kept."""
    at = parsed.filter("not bad").select(F.col(f"rec.{spec.key}").alias(spec.key), F.col("rec").alias("wl_item"))
    level: Record | Child = spec
    kept = [spec.key]
    for name in route:
        level = next(c for c in level.children if c.name == name)
        at = at.select(*kept, F.posexplode(f"wl_item.{level.path}").alias(f"{name}_idx", "wl_item"))
        kept.append(f"{name}_idx")
    at = at.filter(F.col("wl_item").isNotNull())
    if not level.fields:
        return at.select(*kept, F.col("wl_item").alias("value"))
    return at.select(*kept, *(coerce(F.col(f"wl_item.{f.path or f.name}"), f.type).alias(f.name) for f in level.fields))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, skip_rows: int = 0) -> DataFrame:
    """Delimited text without quoting, without the first ``skip_rows`` lines and the header of each file.

    A line with another number of fields than the schema, or a field that does not fit its type, is dropped, whichever
    columns are asked for; an empty field is null, an empty line is no row.
    """
    skip = skip_rows + header
    lines = spark.read.text(path)
    if skip:
        # Only a file's first block is put in order; lines of other blocks stay where they are.
        lines = lines.select("value", F.col("_metadata.file_path").alias("wl_f"), (F.col("_metadata.file_block_start") == 0).alias("wl_first"), F.monotonically_increasing_id().alias("wl_at"))
        place = F.row_number().over(Window.partitionBy("wl_f").orderBy("wl_at"))
        lines = lines.filter("not wl_first").select("value").union(lines.filter("wl_first").withColumn("wl_n", place).filter(F.col("wl_n") > skip).select("value"))
    fields = T.StructType.fromDDL(schema)
    parts = F.split("value", re.escape(sep), -1)
    rows = lines.filter("value <> ''").select(parts.alias("wl_p")).filter(F.size("wl_p") == len(fields))
    text = [F.nullif(F.col("wl_p")[i], F.lit("")) for i in range(len(fields))]
    typed = [x.try_cast(f.dataType) for x, f in zip(text, fields, strict=True)]
    whole = reduce(lambda a, b: a & b, (t.isNotNull() | x.isNull() for t, x in zip(typed, text, strict=True)))
    return rows.filter(whole).select(*(t.alias(f.name) for t, f in zip(typed, fields, strict=True)))


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table if it is there, else, with a warning, an empty one with the declared columns; other errors stay errors."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{path} is not there; taken as empty", stacklevel=2)
        return spark.createDataFrame([], schema)


def latest_per_key(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """An append-only cache's last row per key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in at))
    return df.withColumn("wl_rn", F.row_number().over(w)).filter("wl_rn = 1").drop("wl_rn")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
