"""The price table in a database: an embedded one, which Spark brings along."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from stallkeeper.sources import readers
from stallkeeper.sources.schemas import PRICES


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def price_rows(n):
    day = dt.datetime(2024, 1, 1)
    rows = [(f"item {i}", i * 1.5, i, day + dt.timedelta(hours=i)) for i in range(n)]
    return [*rows, ("無價 | 火蛇", None, None, None), ("tie a", 7.5, 1, day), ("O'Neil \"x\"", 7.5, 0, day)]


def key(row):
    return row[0]


@pytest.mark.parametrize("column", ["last_updated", "price_twd", "volume"])
def test_round_trip_in_ranges(spark, url, column):
    rows, table = price_rows(200), f"t_{column}"
    readers.write_prices_jdbc(spark.createDataFrame(rows, PRICES), url, table)
    got = readers.read_prices_jdbc(spark, url, table, column, rows_a_task=60)
    assert got.rdd.getNumPartitions() == 4 and got.columns == PRICES.names
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)
    readers.write_prices_jdbc(spark.createDataFrame(rows[:3], PRICES), url, table)
    assert readers.read_prices_jdbc(spark, url, table).count() == 3


def test_database_filters_and_sorts(spark, url):
    rows = price_rows(50)
    readers.write_prices_jdbc(spark.createDataFrame(rows, PRICES), url, "pushed")
    some = readers.read_prices_jdbc(spark, url, "pushed", rows_a_task=20).filter((F.col("price_twd") > 30) & (F.col("item") != "item 40")).select("item")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(price_twd,30.0)" in plan and "*Not(EqualTo(item,item 40))" in plan and "ReadSchema: struct<item:string>" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert sorted(r.item for r in some.collect()) == sorted(r[0] for r in rows if r[1] and r[1] > 30 and r[0] != "item 40")
    best = readers.best_prices_jdbc(spark, url, "pushed", 10)
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))[:10]
    assert [tuple(r) for r in best.collect()] == want


def test_empty_and_constant_tables(spark, url):
    readers.write_prices_jdbc(spark.createDataFrame([], PRICES), url, "nothing")
    assert readers.read_prices_jdbc(spark, url, "nothing").collect() == []
    same = [(f"i{k}", 1.0, 1, None) for k in range(10)]
    readers.write_prices_jdbc(spark.createDataFrame(same, PRICES), url, "same")
    for column in ("last_updated", "price_twd"):
        assert readers.read_prices_jdbc(spark, url, "same", column, rows_a_task=2).count() == 10
