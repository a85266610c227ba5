"""Processed ids by run: what is seen, which segments are read, how rarely an absent id passes a filter."""

import os

import pytest
from pyspark.sql import functions as F

from stallkeeper.sources import processed
from stallkeeper.sources.processed import ProcessedIds


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def told(df):
    return sorted(r.id for r in df.collect())


def test_runs_against_sets(spark, tmp_path, monkeypatch):
    """Repeated runs, empty runs, null and empty ids, merges; every answer as with sets in Python."""
    monkeypatch.setattr(processed, "FANOUT", 3)
    store, kept = ProcessedIds(spark, str(tmp_path)), {}
    assert told(store.seen(frame(spark, ["a", None]))) == [] and told(store.ids()) == []
    asked = [str(i) for i in range(40)] + ["7", "", None]
    for run, ids in [(1, ["1", "2", "2", None, ""]), (2, ["3", "2"]), (3, []), (2, ["5", "6"]), (5, ["1", "39"]), (5, ["1", "38"])]:
        store.append(frame(spark, ids), run)
        kept[run] = {i for i in ids if i}
        assert told(store.seen(frame(spark, asked), run)) == sorted(set().union(*[v for k, v in kept.items() if k != run])), run
    assert told(store.ids(2)) == sorted(set().union(*[v for k, v in kept.items() if k != 2]))
    assert sorted((s.first, s.last) for s in store.version()[1]) == [(1, 3), (2, 2), (5, 5)]  # run 2 was repeated after it was merged
    store.vacuum(0)
    assert len(os.listdir(tmp_path / "data")) == len(store.version()[1])
    assert told(store.seen(frame(spark, asked))) == sorted(set().union(*kept.values()))


def test_reads_only_what_may_hold_an_id(spark, tmp_path):
    """The files of ids that a question reads don't grow with the runs before it."""
    store, read = ProcessedIds(spark, str(tmp_path)), []
    for run in range(1, 4):
        store.append(frame(spark, [f"{run}-{i}" for i in range(50)]), run)
        seen = store.seen(frame(spark, ["1-7", "nowhere"]))
        assert told(seen) == ["1-7"]
        read.append({f.split("/data/")[1].split("/")[0] for f in seen.inputFiles() if f"{tmp_path}/data" in f})
    assert all(r == read[0] and len(r) == 1 for r in read)
    store.append(spark.range(3), 4)  # numbers are kept as texts
    assert told(store.seen(spark.range(5))) == ["0", "1", "2"]
    assert not any("/ids/" in f for f in store.seen(frame(spark, ["new"])).inputFiles())


@pytest.mark.parametrize("most_sent", [processed.MOST_SENT, 0])
def test_rate_of_false_positives(spark, tmp_path, monkeypatch, most_sent):
    """Every id that is held passes, of 50,000 others fewer than one in 300; by broadcast and by join."""
    monkeypatch.setattr(processed, "MOST_SENT", most_sent)
    store = ProcessedIds(spark, str(tmp_path))
    held = spark.range(30_000).select(F.concat(F.lit("h"), "id").alias("id"))
    store.append(held, 1)
    segments = store.version()[1]
    assert segments[0].shards == 16
    assert store.candidates(held, segments).count() == 30_000
    others = spark.range(50_000).select(F.concat(F.lit("o"), "id").alias("id"))
    assert store.candidates(others, segments).count() < 50_000 / 300
    monkeypatch.setattr(processed, "MOST_SHARDS", 3)
    assert store.seen(held.limit(5000).unionByName(others)).count() == 5000


def test_many_ids_are_joined_whole(spark, tmp_path, monkeypatch):
    """Segments with no more ids in all than are asked for are not screened; larger ones are. Answers as with sets, repeated ids kept once."""
    monkeypatch.setattr(processed, "IDS", 4)
    store, screened, screen = ProcessedIds(spark, str(tmp_path)), [], ProcessedIds.candidates
    monkeypatch.setattr(ProcessedIds, "candidates", lambda self, ids, segments: screened.append([s.shards for s in segments]) or screen(self, ids, segments))
    store.append(frame(spark, [f"a{i}" for i in range(8)] * 2), 1)
    store.append(frame(spark, ["b0", "b1", "a7", ""]), 2)
    assert store.version()[1][0].shards == 4 and sorted(r.id for r in store._rows(store.version()[1][:1]).collect()) == sorted(f"a{i}" for i in range(8))
    asked = [f"a{i}" for i in range(4, 20)] + ["b1", "b1", None]
    assert told(store.seen(frame(spark, asked), 2)) == ["a4", "a5", "a6", "a7"] and screened == []
    assert told(store.seen(frame(spark, asked[:13] + ["b1"]))) == ["a4", "a5", "a6", "a7", "b1"] and screened == [[4]]
    assert told(store.seen(frame(spark, ["b0", "a1", "x"]))) == ["a1", "b0"] and screened[1:] == [[1, 4]]
    monkeypatch.setattr(processed, "MOST_HASHED", 0)
    assert told(store.seen(frame(spark, asked * 2))) == ["a4", "a5", "a6", "a7", "b1"] and len(screened) == 2
