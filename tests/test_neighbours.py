"""Mutual information by nearest neighbours against its definition, and reads over JDBC in partitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.errors import ConfigurationError
from riskloom.operators import features as X
from riskloom.sources import tables as IO


def psi(n):
    return -0.57721566490153286 + sum(1 / j for j in range(1, n))


def by_definition(x, y, k):
    keep = np.array([v is not None and (y == v).sum() > 1 for v in y])
    x, y = np.nan_to_num(x[keep]), y[keep]
    total = 0.0
    for i in range(len(x)):
        mine = np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))
        size = len(mine) + 1
        kk = min(k, size - 1)
        r = mine[kk - 1]
        d = np.abs(x - x[i])
        m = (d < r).sum() if r > 0 else (d == 0).sum()
        total += psi(kk) - psi(size) - psi(int(m))
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize(("k", "block"), [(3, 100_000), (3, 4), (1, 7), (6, 9)])
def test_neighbour_information(spark, k, block):
    """Ties, missing values, small classes, classes of one row, and blocks little larger than the neighbourhood."""
    rng = np.random.default_rng(12)
    n = 160
    y = rng.choice(["a", "b", "c"], n).astype(object)
    y[:3], y[3], y[4] = "few", "alone", None
    x = {"near": (y == "a") * 1.5 + rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "gaps": np.where(rng.random(n) < 0.4, np.nan, np.round(rng.normal(size=n), 3)), "noise": rng.random(n)}
    df = spark.createDataFrame(pd.DataFrame(x).assign(y=y)).repartition(3)
    found = X.neighbour_information(df, "y", list(x), k, block)
    got = {r["feature"]: r["mi"] for r in found.collect()}
    for name, values in x.items():
        assert got[name] == pytest.approx(by_definition(values, y, k), abs=1e-10), name
    assert list(got.values()) == sorted(got.values(), reverse=True)


def test_digamma(spark):
    row = spark.range(1, 400).select("id", X.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-11) for r in row)


def test_neighbour_information_of_odd_tables(spark):
    empty = spark.createDataFrame([], "x double, y int")
    assert X.neighbour_information(empty, "y", ["x"]).count() == 0
    same = spark.createDataFrame([(1.0, k % 2) for k in range(10)], "x double, y int")
    assert X.neighbour_information(same, "y", ["x"]).first()["mi"] == 0


def test_jdbc_in_partitions(spark):
    """Ranges, found and given bounds, predicates; columns and filters reach the database."""
    url, driver = "jdbc:derby:memory:readers;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(1000).select(F.col("id").alias("K"), (F.col("id") % 7).cast("double").alias("X"), F.lit("t").alias("S")).write.jdbc(url, "ROWS_T", properties={"driver": driver, "createTableColumnTypes": "S varchar(4)"})
    df = IO.load_jdbc(spark, "select * from ROWS_T", url, "K", 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000 and df.agg(F.sum("K")).first()[0] == 499_500
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert max(sizes) < 300
    plan = df.where("X > 5").select("K")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(X,5.0)" in plan and "S#" not in plan
    assert IO.load_jdbc(spark, "ROWS_T", url, "K", 3, (100, 200), driver=driver).count() == 1000
    assert IO.load_jdbc(spark, "ROWS_T", url, predicates=["K < 10", "K >= 990"], driver=driver).count() == 20
    assert IO.load_sql(spark, "select K from ROWS_T where K < 5", url, driver=driver).count() == 5
    assert IO.load_jdbc(spark, "select * from ROWS_T where K < 0", url, "K", driver=driver).count() == 0
    with pytest.raises(ConfigurationError):
        IO.load_jdbc(spark, "ROWS_T", url, "K", predicates=["K < 1"], driver=driver)


def test_binary_workbooks_are_refused(spark):
    with pytest.raises(ConfigurationError):
        IO.load_data(spark, "/tmp/no.xls")
    assert math.isclose(psi(1), -0.5772156649015329)
