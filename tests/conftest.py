import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Rows with columns by name and floats at nine digits, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if isinstance(x, float):
            return "nan" if x != x else f"{x:.8g}"
        if isinstance(x, (list, tuple)):
            return str([one(y) for y in x])
        return f"{float(x):.8g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)
