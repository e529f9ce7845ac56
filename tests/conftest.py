import glob

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")

    def rows(query):
        r = con.sql(query)
        names = list(r.columns)
        at = [names.index(c) for c in sorted(names)]
        return sorted(names), sorted((tuple(str(x[i]) for i in at) for x in r.fetchall()))

    return rows


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
