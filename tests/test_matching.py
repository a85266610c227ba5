"""As-of joins, the price cascade and placed catalogues against brute force."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallkeeper.operators import feed, prices, terms
from stallkeeper.operators.asof import asof
from stallkeeper.operators.containment import shortest_holder
from stallkeeper.sources import readers
from stallkeeper.sources.processed import ProcessedIds
from stallkeeper.sources.versioned import VersionedTable


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_asof_is_brute_force(spark, parts):
    """A key with most of the rows lies in many ranges; ties in time, repeated asks and quotes, null keys and times."""
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None, f"k{rng.randrange(60)}"])
    asks = [(i if i % 9 else 0, key(), rng.choice([None, *range(0, 400, 3)])) for i in range(300)]
    quotes = [(key(), rng.choice([None, *range(0, 420, 7)]), i) for i in range(120)]
    a = spark.createDataFrame(asks, "ask long, k string, s long").withColumn("t", F.timestamp_seconds("s")).drop("s")
    q = spark.createDataFrame(quotes, "k string, s long, n long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for ttl in (None, 1, 20, 100_000):
        want = []
        for i, k, t in asks:
            met = [(s, n) for x, s, n in quotes if k is not None and x == k and None not in (s, t) and s <= t]
            if met and (ttl is None or t - max(met)[0] < ttl):
                want.append((i, k, max(met)[1]))
        got = asof(a, q, "k", "t", "at", ["n"]) if ttl is None else prices.fresh_quote(a, q, "k", "t", "at", ttl, ["n"])
        assert got.columns == ["ask", "k", "t", "n", "at"] and Counter((r.ask, r.k, r.n) for r in got.collect()) == Counter(want)
    assert asof(a.limit(0), q, "k", "t", "at").collect() == [] == asof(a, q.limit(0), "k", "t", "at").collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cascade_asks_for_misses_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "item string, price_twd double, volume long, last_updated timestamp", buckets=4)
    table.merge(spark.createDataFrame([("a", 1.0, 5), ("n", None, 5)], "item string, price_twd double, volume long").withColumn("last_updated", F.lit("2020-01-01").cast("timestamp")), ["last_updated"])
    asked = {}

    def source(name, known):
        def quotes(missed):
            asked.setdefault(name, []).append(sorted(r.item for r in missed.collect()))
            return spark.createDataFrame(known, "item string, price_twd double")  # a source may say more than it was asked

        return name, quotes

    sources = [source("first", [("b", 3.0), ("b", 2.0), ("a", 9.0), ("c", None)]), source("second", [("c", 4.0), ("b", 9.0), ("n", 7.0)]), source("third", [])]
    listings = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "b"), (6, None), (7, ""), (8, "n")], "id long, name string")
    got = sorted(map(tuple, prices.price_cascade(listings, table, sources).collect()))
    want = [(1, "a", 1.0, 5, "table"), (2, "b", 2.0, None, "first"), (3, "c", 4.0, None, "second"), (4, "d", None, None, None), (5, "b", 2.0, None, "first")]
    assert got[:5] == want and got[5][2:] == got[6][2:] == (None, None, None) and got[7] == (8, "n", 7.0, None, "second")
    assert asked == {"first": [["b", "c", "d", "n"]], "second": [["c", "d", "n"]], "third": [["d"]]}
    again = {r.id: r.source for r in prices.price_cascade(listings, table, sources).collect()}
    assert again == {1: "table", 2: "table", 3: "table", 4: None, 5: "table", 6: None, 7: None, 8: "table"} and asked["first"][1:] == [["d"]]
    assert {r.item: r.volume for r in table.read().collect()} == {"a": 5, "b": None, "c": None, "n": None}
    before = table.version().number
    prices.price_cascade(listings.filter("id = 1"), table, sources)
    assert table.version().number == before and len(asked["first"]) == 2  # nothing missed: no source is asked, nothing is written


def test_catalogues_with_places(spark, tmp_path):
    """Arrays, objects by id (of names or of objects), one entry alone, lines that aren't JSON; the last repeat of an id wins, an empty last name leaves it out."""
    files = {
        "en": json.dumps([{"id": "1", "name": "old"}, {"id": "2", "name": "Gun | Two"}, {"id": "1", "name": "Gun | One"}, {"id": 4, "name": "Gun | Four"}, {"name": "none"}]),
        "zh-CN": json.dumps({"1": "枪 | 一", "2": {"name": "枪 | 二"}, "4": "枪 | Four", "9": "x"}),
        "zh-TW": json.dumps([{"id": "1", "name": "枪 | 一"}, {"id": "2", "name": "槍 | 二"}, {"id": "2", "name": ""}, {"id": "4", "name": "枪 | Four"}]),
        "de": json.dumps({"id": "2", "name": "Zwei"}), "fr": "[{", "es": '"text"',
    }
    for lang, text in files.items():
        (tmp_path / f"lang={lang}").mkdir()
        (tmp_path / f"lang={lang}/a.json").write_text(text, encoding="utf-8")
    got = terms.translate_catalogue(readers.read_catalogue(spark, str(tmp_path)))
    assert {(r.lang, r.id, r.term, r.target) for r in got.collect()} == {
        ("zh-CN", "1", "枪 | 一", "Gun | One"), ("zh-CN", "2", "枪 | 二", "Gun | Two"), ("zh-CN", "4", "枪 | Four", "Gun | Four"),
        ("zh-TW", "1", "枪 | 一", "Gun | One"), ("zh-TW", "4", "枪 | Four", "Gun | Four"), ("de", "2", "Zwei", "Gun | Two")}
    rows = {(r.kind, r.term, r.target, r.priority) for r in terms.catalogue_terms(got, {"zh-CN": 2, "zh-TW": 3}).collect()}
    assert rows == {("full", "枪 | 一", "Gun | One", 2), ("full", "枪 | 二", "Gun | Two", 2), ("full", "枪 | Four", "Gun | Four", 2), ("full", "枪 | 一", "Gun | One", 3),
                    ("full", "枪 | Four", "Gun | Four", 3), ("pattern", "一", "One", 2), ("pattern", "二", "Two", 2), ("pattern", "一", "One", 3)}
    stored = terms.stored_terms(terms.merge_terms(terms.catalogue_terms(got, {"zh-CN": 2, "zh-TW": 3})), {2: "cn", 3: "tw"}).collect()
    assert sorted((r.kind, r.ord, r.term) for r in stored) == [("full", 0, "枪 | 一"), ("full", 1, "枪 | 二"), ("full", 2, "枪 | Four"), ("pattern", 0, "一"), ("pattern", 1, "二")]


def test_scan_of_the_sample_listings(spark, tmp_path):
    """Six listings of a feed from text to stored deal, over two runs, the second repeated: exact, fuzzy and fallback prices, no name, no price, hardly traded."""
    from stallkeeper.operators.scan import scan

    texts = [("s1", "【售】火蛇 略有磨损 算9,200 TWD"), ("s2", "賣 咆哮 久經沙場 =3000 TWD http://h.example/p/001"), ("s3", "售 暗金 火蛇 FN 賣 1000 TWD"), ("s4", "收 紅線 FT 賣 500"),
             ("s5", "沒有名字 賣 800 TWD"), ("s6", "售 龍王 FN 賣 700 TWD")]
    full = spark.createDataFrame([("火蛇", "AK-47 | Fire Serpent", 0), ("咆哮", "M4A4 | Howl", 1), ("龍王", "M4A1-S | Dragon", 2)], "term string, target string, ord int")
    patterns = spark.createDataFrame([("紅線", "Redline", 0)], "term string, target string, ord int")
    table = VersionedTable(spark, str(tmp_path / "prices"), "item string, price_twd double, volume long, last_updated timestamp", buckets=4)
    known = [("AK-47 | Fire Serpent (Minimal Wear)", 10000.0, 100), ("StatTrak™ AK-47 | Fire Serpent (Factory New)", 9999.0, 3), ("AK-47 | Redline (Field-Tested)", 3000.0, 900)]
    table.merge(spark.createDataFrame(known, "item string, price_twd double, volume long").withColumn("last_updated", F.lit("2020-01-01").cast("timestamp")), ["last_updated"])
    quotes = spark.createDataFrame([("M4A4 | Howl (Field-Tested)", 4000.0), ("x", 1.0)], "item string, price_twd double")
    run = lambda k, rows: {r.id: r for r in scan(spark.createDataFrame(rows, "id string, content string"), str(tmp_path / "scan"), k, full, patterns, table, [("second", lambda missed: quotes)]).collect()}
    first = run(1, texts[:2])
    assert (first["s1"].match_kind, first["s1"].price_twd, first["s1"].volume, round(first["s1"].profit, 6)) == ("exact", 10000.0, 100, 650.0)
    assert (first["s2"].match_kind, first["s2"].price_twd, first["s2"].volume) == ("second", 4000.0, None) and set(first) == {"s1", "s2"}
    for _ in range(2):  # the repeated run changes nothing
        second = run(2, texts)
        assert set(second) == {"s4"} and second["s4"].match_kind == "fuzzy" and second["s4"].ask == 2250.0 and second["s4"].name == "Redline (Field-Tested)"
        stored = spark.read.parquet(str(tmp_path / "scan/deals"))
        assert sorted((r.id, r.run) for r in stored.collect()) == [("s1", 1), ("s2", 1), ("s4", 2)]
        assert {r.item: r.price_twd for r in table.read().collect()} == {n: p for n, p, _ in known} | {"M4A4 | Howl (Field-Tested)": 4000.0}
        assert sorted(r.id for r in ProcessedIds(spark, str(tmp_path / "scan/processed")).ids().collect()) == ["s1", "s2", "s3", "s4", "s5", "s6"]


@pytest.mark.parametrize("most_pairs", [0, 40, 10_000_000])
def test_names_that_share_their_runs(spark, most_pairs):
    """Every name and text has the same run of five; the shortest holder is that of brute force whatever the bound."""
    rng = random.Random(9)
    texts = sorted({"aaaaa" + "".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(150)})
    names = sorted({t[i : i + rng.randrange(1, 26)] for t in texts[::3] for i in (0, 3, 9) if t[i:]} | {"aaaaaa", "b", "bbbbbbbbbbbbbbbbbbbb", "c", "aaaaac"})
    want = [(n, min((t for t in texts if n in t), key=lambda t: (len(t), t))) for n in names if any(n in t for t in texts)]
    got = shortest_holder(spark.createDataFrame([(n,) for n in names], "__a string"), spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "__b string"), most_pairs=most_pairs)
    assert sorted((r["__a"], r["__b"]) for r in got.collect()) == want


def test_split_json_in_sql(spark):
    """The table function gives what the operator gives, and keeps null and empty bodies out."""
    bodies = [(1, '{"a": 1}\n{"b": [2]} {"c"'), (2, None), (3, ""), (4, " {}"), (5, "[1] 2 x {}"), (6, '{"a": 1}')]
    df = spark.createDataFrame(bodies, "k int, body string")
    feed.register_split_json(spark)
    got = spark.sql("SELECT k, pos, obj FROM {t} t, LATERAL split_json(t.body)", t=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feed.split_json(df).select("k", "pos", "obj").collect()))
    assert got.count() == 5


def test_terms_are_compared_in_bounded_pieces(monkeypatch):
    """Hits in a text of one character, with terms longer than what is compared at once, against plain search."""
    from stallkeeper.operators import rolling

    monkeypatch.setattr(rolling, "COMPARED", 64)
    terms = ["a" * 100 + "b", "a" * 70, "é€", "aab", "ba", "a"]
    texts = ["a" * 300, "a" * 99 + "b", "xé€y", "b", None, "", "aab" * 40, "c" + "a" * 100 + "b"]
    scan = rolling.TermScan(terms)
    sizes, whole = [], scan.equal
    monkeypatch.setattr(scan, "equal", lambda data, start, term: sizes.append(int(scan.length[term].sum())) or whole(data, start, term))
    want = [next((i for i, t in enumerate(terms) if x is not None and t in x), -1) for x in texts]
    assert scan.first(pa.array(texts)).tolist() == want
    assert scan.first(pa.array(["skipped", *texts]).slice(1)).tolist() == want and max(sizes) <= 101


def test_names_are_priced_once(spark, tmp_path, monkeypatch):
    """Listings of one name ask for its price once, found or not; each listing is a deal of its own, repeated ids too."""
    from stallkeeper.operators import scan as scans

    asked, match = [], scans.match_price
    monkeypatch.setattr(scans, "match_price", lambda names, *more: asked.append(sorted(r.name for r in names.collect())) or match(names, *more))
    full = spark.createDataFrame([("紅線", "Redline", 0), ("火蛇", "Serpent", 1), ("龍王", "Dragon", 2)], "term string, target string, ord int")
    table = VersionedTable(spark, str(tmp_path / "prices"), "item string, price_twd double, volume long, last_updated timestamp", buckets=2)
    table.merge(spark.createDataFrame([("Redline (Field-Tested)", 3000.0, 90), ("Serpent (Field-Tested)", None, 90)], "item string, price_twd double, volume long").withColumn("last_updated", F.lit("2020-01-01").cast("timestamp")), ["last_updated"])
    quotes = spark.createDataFrame([("Serpent (Field-Tested)", 2000.0)], "item string, price_twd double")
    rows = [("a", "紅線 =500 TWD"), ("b", "紅線 =600 TWD"), ("b", "紅線 =700 TWD"), ("c", "火蛇 =800 TWD"), ("d", "火蛇 =900 TWD"), ("e", "龍王 =900 TWD")]
    listings = spark.createDataFrame(rows, "id string, content string")
    got = scans.scan(listings, str(tmp_path / "scan"), 1, full, full.limit(0), table, [("second", lambda missed: quotes)]).collect()
    want = [("a", 500.0, 3000.0, 90, "exact"), ("b", 600.0, 3000.0, 90, "exact"), ("b", 700.0, 3000.0, 90, "exact"), ("c", 800.0, 2000.0, None, "second"), ("d", 900.0, 2000.0, None, "second")]
    assert sorted((r.id, r.ask, r.price_twd, r.volume, r.match_kind) for r in got) == want
    assert asked == [["Dragon (Field-Tested)", "Redline (Field-Tested)", "Serpent (Field-Tested)"]]


def test_texts_are_read_once(spark):
    """The plan of named listings has each pattern of the price once."""
    from stallkeeper.operators.deals import named_listings

    full = spark.createDataFrame([("紅線", "Redline", 0)], "term string, target string, ord int")
    listings = spark.createDataFrame([("a", "紅線 =５00 TWD"), ("b", "紅線 1,200 http://h/300"), ("c", "紅線"), ("d", None)], "id string, content string")
    named = named_listings(listings, full, full.limit(0))
    assert named._jdf.queryExecution().optimizedPlan().toString().count("[0-9]{3,}") == 1
    assert sorted((r.id, r.ask, r.name) for r in named.collect()) == [("a", 500.0, "Redline (Field-Tested)"), ("b", 5400.0, "Redline (Field-Tested)")]
