import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    at = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{at}/shared")
        .config("spark.sql.warehouse.dir", f"file://{at}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    return c


def rows(df):
    """Rows of a pandas frame, columns by name, in an order that doesn't depend on the engine."""

    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, (str, bytes, bool)) or type(v).__name__ == "bool":
            return bool(v) if not isinstance(v, (str, bytes)) else v
        return round(float(v), 6)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)
