import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    cpus = os.environ.get("TEST_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def canon(rows):
    """Rows (dicts) as a sorted list of comparable tuples."""
    return sorted(repr(tuple((k, r[k]) for k in sorted(r))) for r in rows)


@pytest.fixture(scope="session")
def same():
    """Asserts that a Spark frame and a DuckDB query hold the same rows."""

    def check(df, con, sql):
        got = [r.asDict() for r in df.collect()]
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert canon(got) == canon(dict(zip(names, r, strict=True)) for r in cur.fetchall())

    return check
