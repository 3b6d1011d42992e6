"""Intermediate tables in the shared folder, which survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder of ``spark.checkpoint.dir``.

    Where that setting is absent, a local folder is set and used if Spark runs in one process (tests, one machine); a
    cluster without it is an error, for its executors would not share the folder.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wayline-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/wayline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.wayline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and that nothing will read again."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.wayline_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
