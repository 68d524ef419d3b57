import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/sf0.001/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.fixture(scope="session")
def same():
    """Compares rows of a DataFrame and of a DuckDB relation, columns by name, in any order."""

    def check(df, relation):
        rows = relation.fetchall()
        names = [x[0] for x in relation.description]
        columns = sorted(names)
        assert sorted(df.columns) == columns
        say = lambda x: round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
        got = sorted(repr([say(r[c]) for c in columns]) for r in df.collect())
        assert got == sorted(repr([say(r[names.index(c)]) for c in columns]) for r in rows)

    return check
