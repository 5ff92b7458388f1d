import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TALUS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='talus-test-')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def oracle_rows(sql: str, sf: str):
    """Columns and rows of DuckDB SQL over the tables of a folder."""
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        at = p if p.is_file() else f"{p}/*.parquet"
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def normal(v):
    import decimal

    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def same_rows(df, columns, rows) -> None:
    names = sorted(df.columns)
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    ours = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in rows), key=repr)
    assert ours == theirs
