import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        at = path if path.is_file() else path / "*.parquet"
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{at}'")
    return c


def plain(value):
    """A value as comparable text, the same for both engines."""
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    def check(df, sql):
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
        mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        assert mine == theirs

    return check
