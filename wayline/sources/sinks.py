"""Sinks: whole-table replacement, manifests, tidy exports, nested reports."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str, compression: str = "zstd") -> dict:
    """Write the table as a whole beside its place, then swap it in; returns rows and seconds, counted on the way."""
    spark, seen, began = df.sparkSession, Observation(), time.time()
    new, old = f"{path}.new", f"{path}.old"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression).parquet(new)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(hadoop(old), True)
    if files.exists(at):
        files.rename(at, hadoop(old))
    files.rename(hadoop(new), at)
    files.delete(hadoop(old), True)
    return {"path": path, "rows": seen.get["rows"], "seconds": round(time.time() - began, 3)}


def write_manifest(df: DataFrame, entries: list[dict], path: str) -> None:
    """Step manifests as JSON lines."""
    df.sparkSession.createDataFrame([(json.dumps(e),) for e in entries], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tidy_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def nested_report(df: DataFrame, group: str, panel: str, rows: list[str], order: list[Column], name: str = "payload") -> DataFrame:
    """One JSON text per group: panels, each an ordered list of row objects."""
    row = F.struct(*order, *rows)
    cells = df.groupBy(group, panel).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    cells = cells.select(group, panel, F.transform("rows", lambda x: F.struct(*(x[c].alias(c) for c in rows))).alias("rows"))
    panels = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(panel, "rows"))).alias("panels"))
    return panels.select(group, F.to_json("panels").alias(name))
