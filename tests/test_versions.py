"""The versioned price table, alone and under streams."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.sources.versioned import VersionedTable
from stallkeeper.streaming import streams

SCHEMA = "item string, price_twd double, volume long, at int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), SCHEMA, buckets=8)
    assert t.read().collect() == [] and t.version().number == 0
    base = [(f"i{k}", float(k), k, 1) for k in range(40)] + [(None, 1.0, 1, 1)]
    t.merge(frame(spark, base), ["at"])
    files = dict(t.version().live)
    assert t.merge(frame(spark, [("i3", 9.0, 9, 2), ("i3", 8.0, 8, 0), ("new", 1.0, 1, 1)]), ["at"]) == 2
    changed = {b for b, f in t.version().live.items() if files.get(b) != f}
    assert 1 <= len(changed) <= 2 and t.version().live.keys() >= files.keys()
    want = [r for r in base if r[0] != "i3"] + [("i3", 9.0, 9, 2), ("new", 1.0, 1, 1)]
    assert rows(t.read()) == sorted(want, key=str) and rows(t.read(1)) == sorted(base, key=str)
    t.merge(frame(spark, [("i3", 7.0, 7, 2), (None, 2.0, 2, 2)]), ["at"])  # an equal update wins, null is a key
    got = {r.item: r.price_twd for r in t.read().collect()}
    assert got["i3"] == 7.0 and got[None] == 2.0 and len(got) == 42
    assert t.merge(frame(spark, []), ["at"]) == 4 and t.read().count() == 42
    t.overwrite(frame(spark, [("a", 1.0, 1, 1)]), ["at"])
    assert rows(t.read()) == [("a", 1.0, 1, 1)] and t.read(1).count() == 41
    t.vacuum()
    assert t.read(1).count() == 41
    t.vacuum(0)
    assert rows(t.read()) == [("a", 1.0, 1, 1)] and len(list((tmp_path / "data").iterdir())) == 1


def test_repeated_batches_and_racing_writers(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), SCHEMA, buckets=4)
    assert t.merge(frame(spark, [("a", 1.0, 1, 1)]), ["at"], "w", 0) == 1
    assert t.merge(frame(spark, [("a", 2.0, 1, 2)]), ["at"], "w", 0) == 1 and rows(t.read()) == [("a", 1.0, 1, 1)]
    assert t.merge(frame(spark, [("a", 2.0, 1, 2)]), ["at"], "w", 1) == 2 and t.before("w", 1) == 1 and t.before("w", 2) == 2
    one = lambda k: VersionedTable(spark, str(tmp_path), SCHEMA, buckets=4).merge(frame(spark, [(f"k{k}", float(k), k, 1)]), ["at"], f"t{k}", 0)
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(one, range(4))) == [3, 4, 5, 6]
    assert rows(t.read()) == sorted([("a", 2.0, 1, 2)] + [(f"k{k}", float(k), k, 1) for k in range(4)], key=str)


ASKS = "id long, item string, ask double, posted_at timestamp"


def test_stream_sees_prices_that_change(spark, tmp_path):
    """Prices appended, then overwritten between batches of one stream; the stream goes on."""
    t = VersionedTable(spark, str(tmp_path / "prices"), SCHEMA, buckets=4)
    t.merge(frame(spark, [("a", 100.0, 60, 1)]), ["at"])
    arrive = lambda k, data: spark.createDataFrame([(i, n, a, None) for i, n, a in data], ASKS).withColumn("posted_at", F.current_timestamp()).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = lambda: streams.stream_listings(spark, str(tmp_path / "in/part=*"), T.StructType.fromDDL(ASKS))
    run = lambda: streams.run_available(stream().withColumnRenamed("item", "asked"), each=streams.priced_by(t, "asked"), path=str(tmp_path / "work"))
    read = lambda: sorted((r.id, r.price_twd) for r in run().collect())
    arrive(0, [(1, "a", 50.0), (2, "b", 50.0)])
    assert read() == [(1, 100.0)]
    t.merge(frame(spark, [("b", 200.0, 60, 2)]), ["at"])
    arrive(1, [(3, "b", 50.0)])
    assert read() == [(1, 100.0), (3, 200.0)]
    t.overwrite(frame(spark, [("b", 300.0, 60, 3)]), ["at"])
    t.vacuum(0)
    arrive(2, [(4, "a", 50.0), (5, "b", 50.0)])
    assert read() == [(1, 100.0), (3, 200.0), (5, 300.0)]


def test_deals_and_prices_of_a_repeated_batch(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "prices"), SCHEMA, buckets=4)
    t.merge(frame(spark, [("a", 100.0, 60, 1), ("b", 100.0, 60, 1)]), ["at"])
    quotes = lambda b: b.select(F.col("asked").alias("item"), F.col("ask").alias("price_twd"), F.lit(60).cast("long").alias("volume"), F.lit(2).alias("at"))
    write = streams.write_batches(None, str(tmp_path / "out"), streams.priced_deals(t, 5, 50, "asked", "scan"), streams.merging(t, ["at"], "scan", quotes))
    read = lambda: sorted((r.asked, r.ask, r.price_twd, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    first = spark.createDataFrame([("a", 50.0), ("b", 99.0)], "asked string, ask double")
    write(first, 0)
    want = [("a", 50.0, 100.0, 0)]
    assert read() == want and {r.item: r.price_twd for r in t.read().collect()} == {"a": 50.0, "b": 99.0}
    write(first, 0)  # repeated after its quotes were merged
    assert read() == want and t.version().number == 2
    write(spark.createDataFrame([("a", 40.0), ("b", 50.0)], "asked string, ask double"), 1)
    assert read() == sorted([*want, ("a", 40.0, 50.0, 1), ("b", 50.0, 99.0, 1)])


def test_no_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = streams.run_available(streams.stream_listings(spark, str(tmp_path / "in"), T.StructType.fromDDL(ASKS)))
    assert got.collect() == [] and "ask" in got.columns


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
