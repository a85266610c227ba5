"""Operators against small brute-force versions and golden rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import money
from stallkeeper.operators import containment, deals, feed, prices, rolling, terms, tiles
from stallkeeper.operators.common import dedupe, keep_last, number_rows
from stallkeeper.sources import readers
from stallkeeper.streaming import streams

R = "image_id string, item_id int, attempt int, name string, wear string, is_checked boolean, confidence double, price double, currency string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_terms_are_brute_force(spark, monkeypatch, most):
    """One row for each text row, with repeated and null ids, at every size of the dictionary."""
    monkeypatch.setattr(containment, "MOST_BYTES", most)
    rng = random.Random(3)
    texts = [(i // 2 if i % 7 else None, "".join(rng.choice("ab中c🙂") for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (3, "ab" * 40), (3, "ab" * 40)]
    words = list({"".join(rng.choice("ab中c🙂") for _ in range(rng.randrange(1, 8))) for _ in range(40)} - {""}) + [texts[5][1][3:20], texts[9][1][2:16], "ab" * 9]
    words = [w for w in dict.fromkeys(words) if w]
    want = sorted(((i, t) for i, x in texts for t in [next((w for w in words if x and w in x), None)] if t), key=str)
    df = spark.createDataFrame(texts, "id int, text string")
    t = spark.createDataFrame([(w, w.upper(), k) for k, w in enumerate(words)] + [("", "", -1)], "term string, target string, ord int")
    assert sorted(((r.id, r.term) for r in terms.match_terms(df, t, "id", "text").collect()), key=str) == want
    found = containment.first_term(df, t, "text", ["ord"], span=9)
    assert sorted(((r.id, r.term) for r in found.collect()), key=str) == want
    full, patterns = t.filter("ord % 2 = 0"), t.filter("ord % 2 = 1")
    want = []
    for i, x in texts:
        hits = [(k % 2, k, w) for k, w in enumerate(words) if x and w in x and (k % 2 == 0 or len(w) >= 2)]
        want += [(i, "pattern" if min(hits)[0] else "full", min(hits)[2])] if hits else []
    got = terms.dictionary_lookup(df, full, patterns, "id", "text").collect()
    assert sorted(((r.id, r.mode, r.term) for r in got), key=str) == sorted(want, key=str)
    assert terms.match_terms(df, t.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("span", [1, 5, 1 << 19])
def test_term_scan(monkeypatch, span):
    """Window hashes find what a search of each text finds, whatever the lengths, shared windows, spans and slices."""
    monkeypatch.setattr(rolling, "SPAN", span)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ab中🙂") for _ in range(n))
    words = list(dict.fromkeys([letters(rng.randrange(2, 12)) for _ in range(60)] + ["x" * n for n in range(1, 40)] + ["AK-47 | Redline (" + letters(2) for _ in range(9)] + ["é"]))
    rng.shuffle(words)
    texts = [letters(rng.randrange(0, 50)) for _ in range(60)] + [None, "", "x" * 7, "yxxxy" * 3, "é", "AK-47 | Redline (ab AK-47 | Redline", "a", "\U0001f642"]
    want = [next((k for k, w in enumerate(words) if t and w in t), -1) for t in texts]
    scan = rolling.TermScan(words)
    for kind in (pa.string(), pa.large_string()):
        assert scan.first(pa.array(texts, kind)).tolist() == want
        assert scan.first(pa.array(texts, kind).slice(3, 40)).tolist() == want[3:43]
    assert rolling.TermScan([]).first(pa.array(["a", None])).tolist() == [-1, -1] and scan.first(pa.array([None], pa.string())).tolist() == [-1]


def test_merge_is_dict_update(spark):
    sources = [[("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")], [("a", "5")]]
    want = {}
    for s in sources:
        want |= dict(s)
    frames = [spark.createDataFrame([("full", k, v, p, i) for i, (k, v) in enumerate(s)], "kind string, term string, target string, priority int, pos int") for p, s in enumerate(sources)]
    got = terms.merge_terms(*frames).orderBy("first_priority", "first_pos").collect()
    assert {r.term: r.target for r in got} == want and [r.term for r in got] == list(want)


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "item string, price_twd double, last_updated int")
    new = spark.createDataFrame([("a", 9.0, 1), ("c", 3.0, 2), ("b", 5.0, 0)], base.schema)
    once = prices.upsert_prices(base, new)
    assert rows(once) == [("a", 9.0, 1), ("b", 2.0, 1), ("c", 3.0, 2)] and rows(prices.upsert_prices(once, new)) == rows(once)


def test_fuzzy_is_brute_force(spark):
    rng = random.Random(4)
    items = [("AK | FADE", 1.0, 1), ("M4 | Fade", 2.0, 2), ("AK-47 | Red%line", 3.0, 3), ("no price", None, None)] + [("".join(rng.choice("abAB c") for _ in range(rng.randrange(1, 14))), float(i), i) for i in range(60)]
    items = list({i[0]: i for i in items}.values())
    names = ["red%", "Fade", "ak", "zz", "", "_", None, "no price", "O PRICE"] + ["".join(rng.choice("abAB c") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    df, table = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(items, "item string, price_twd double, volume int")
    known, want = {i[0]: i for i in items}, []
    for n in names:
        hits = sorted((len(i[0]), i[0].lower(), i[0]) for i in items if n and n.lower() in i[0].lower())
        hit = known[n] if n in known else known[hits[0][2]] if hits else (None, None, None)
        want.append((n, *hit, "exact" if n in known else "fuzzy" if hits else "none"))
    assert rows(prices.match_price(df, table).select("name", "matched_item", "price_twd", "volume", "match_kind")) == sorted(want, key=str)


def test_guarded_price(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, None, True), (4, "x", True), (5, "a", None)], "k int, name string, checked boolean")
    table = spark.createDataFrame([("a", 5.0)], "item string, price_twd double")
    assert rows(prices.guarded_price(df, table, "name", F.col("checked")).select("k", "price_twd")) == [(1, 5.0), (2, None), (3, None), (4, None), (5, None)]


def test_money_ties(spark):
    """Half-even whole amounts, cents half up, truncation; TWD amounts stay."""
    df = spark.createDataFrame([(1.0, "RMB"), (3.0, "RMB"), (0.01, "RMB"), (1.0, "USD"), (7.25, "TWD"), (None, "RMB")], "x double, c string")
    got = df.select(*[money.to_twd(F.col("x"), F.col("c"), p).cast("double") for p in ("whole", "cents", "truncate")]).collect()
    assert list(map(tuple, got)) == [(4.0, 4.5, 4.0), (14.0, 13.5, 13.0), (0.0, 0.05, 0.0), (32.0, 32.4, 32.0), (7.25, 7.25, 7.25), (None, None, None)]


def test_sample_listings_to_deals(spark):
    """Six listings of a feed without network, from text to deal."""
    texts = [("s1", "【售】火蛇 略有磨损 算9,200 TWD"), ("s2", "賣 咆哮 久經沙場 =3000 TWD http://h.example/p/001"), ("s3", "售 暗金 火蛇 FN 賣 1000 TWD"), ("s4", "收 紅線 FT 賣 500"), ("s5", "沒有名字 賣 800 TWD"), ("s6", "售 咆哮 崭新出厂 無價")]
    listings = spark.createDataFrame(texts, "id string, content string")
    full = spark.createDataFrame([("火蛇", "AK-47 | Fire Serpent", 0), ("咆哮", "M4A4 | Howl", 1)], "term string, target string, ord int")
    patterns = spark.createDataFrame([("紅線", "Redline", 0)], "term string, target string, ord int")
    table = spark.createDataFrame([("AK-47 | Fire Serpent (Minimal Wear)", 10000.0, 100), ("M4A4 | Howl (Field-Tested)", 4000.0, 60), ("StatTrak™ AK-47 | Fire Serpent (Factory New)", 9999.0, 3), ("Redline (Field-Tested)", 3000.0, 900)],
                                  "item string, price_twd double, volume int")
    got = {r.id: r for r in deals.deals_of_texts(listings, full, patterns, table).collect()}
    assert set(got) == {"s1", "s2", "s4"}  # s3 is hardly traded, s5 has no name, s6 no price
    assert (got["s1"].name, got["s1"].ask, round(got["s1"].profit, 6)) == ("AK-47 | Fire Serpent (Minimal Wear)", 9200.0, 650.0)
    assert (got["s2"].name, got["s2"].ask, got["s4"].name, got["s4"].ask) == ("M4A4 | Howl (Field-Tested)", 3000.0, "Redline (Field-Tested)", 2250.0)


def test_prefix_match(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 50))) for _ in range(60)]
    left, right = list(enumerate(texts[:30])), list(enumerate(texts[20:]))
    start = lambda t: t[:40].strip(" ")
    want = []
    for i, a in left:
        hit = [j for j, b in right if start(a) and start(b) and (start(b)[:15] in start(a) or start(a)[:15] in start(b))]
        want += [(i, min(hit))] if hit else []
    got = feed.prefix_match(spark.createDataFrame(left, "l int, t string"), spark.createDataFrame(right, "r int, u string"), "l", "t", "r", "u")
    assert sorted(map(tuple, got.collect())) == want


def test_consensus(spark):
    def one(*readings, tau=0.7):
        made = [("i", 1, k + 1, n, "FN", c, p, 5.0, "TWD") for k, (c, p, n) in enumerate(readings)]
        return tiles.consensus(spark.createDataFrame(made, R), tau).first()

    assert one((False, 0.9, "A"))[6:] == ("FN", "TWD", True, "") or one((False, 0.9, "A")).success
    assert one((True, 0.9, "AK-47 x"), (True, 0.9, "AK-47 y")).success and one((True, 0.9, "AK-47 x"), (True, 0.9, "AK-47 y")).price == 5
    assert one((True, 0.9, "AK-47 x"), (True, 0.9, "M4A4 z")).error_msg == "Unstable name, skipped"
    assert one((False, 0.5, "A"), (False, 0.8, "A")).confidence == 0.8
    assert one((False, 0.8, "A"), (False, 0.6, "A"), tau=0.85).error_msg == "Low confidence bypass"
    r = one((True, 0.6, "A"), (False, 0.9, "A"))
    assert (r.is_checked, r.confidence, r.error_msg) == (False, 0.6, "Low confidence bypass")


def test_tiles(spark):
    got = tiles.tile_grid(spark.createDataFrame([("a", 100, 70, None, 0)], "image_id string, width int, height int, rows int, cols int")).orderBy("item_id").collect()
    assert len(got) == 21 and tuple(got[0])[2:] == (0, 0, 37, 11) and tuple(got[20])[2:] == (62, 59, 100, 70)


def test_split_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1}\n [2] {"b"'), (2, ' {"a": 1}'), (3, None), (4, "")], "k int, body string")
    assert rows(feed.split_json(df).select("k", "pos", "obj")) == [(1, 0, '{"a": 1}'), (1, 1, "[2]")]


def test_fresh_quote_is_strict(spark):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    asks = spark.createDataFrame([("x", at(900))], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    quotes = spark.createDataFrame([("x", at(600), 1), ("x", at(601), 2), ("x", at(901), 3)], "k string, q string, n int").withColumn("q", F.col("q").cast("timestamp"))
    assert [r.n for r in prices.fresh_quote(asks, quotes, "k", "t", "q").collect()] == [2]


def test_small_ones(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "n int, k string")
    assert rows(dedupe(df, ["k"], ["n"])) == [(1, "a"), (2, "b")]
    assert rows(keep_last(df, F.col("n"), 2).select("n")) == [(2,), (3,)]
    assert sorted((r.id, r.n) for r in number_rows(df, ["n"]).collect()) == [("p0", 1), ("p1", 2), ("p2", 3)]
    assert rows(deals.add_processed(spark.createDataFrame([("a",), ("",)], "id string"), spark.createDataFrame([("a",), (None,), ("b",)], "id string"))) == [("a",), ("b",)]
    empty = spark.createDataFrame([], "item string, price_twd double, volume long, last_updated timestamp")
    assert tuple(prices.price_summary(empty).first()) == (0, 0, None, "never")


def test_files(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("  '火蛇': 'Fire Serpent',\n// note\n'x': '',\n'咆哮': 'Howl'\n")
    assert rows(readers.read_quoted_pairs(spark, str(tmp_path / "pairs.txt"))) == [("咆哮", "Howl"), ("火蛇", "Fire Serpent")]
    for lang, name in (("en", "Howl"), ("zh-CN", "咆哮")):
        (tmp_path / "cat" / f"lang={lang}").mkdir(parents=True)
        (tmp_path / "cat" / f"lang={lang}" / "a.json").write_text(f'[{{"id": "1", "name": "{name}"}},\n {{"id": "2", "name": ""}}]')
    assert rows(terms.translate_catalogue(readers.read_catalogue(spark, str(tmp_path / "cat"))).select("term", "target")) == [("咆哮", "Howl")]
    both = spark.createDataFrame([("full", "a", "b", "s", 1, 1)], "kind string, term string, target string, source string, priority int, ord long")
    readers.write_terms(both, str(tmp_path / "terms"))
    assert rows(readers.read_terms(spark, str(tmp_path / "terms")).select("kind", "term")) == [("full", "a")]
    times = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-01-02 03:04",), ("x",)], "t string").select(readers.parse_timestamp(F.col("t")).cast("string"))
    assert [r[0] for r in times.collect()] == ["2024-01-02 03:04:05", "2024-01-02 03:04:00", None]


def test_stream_goes_on_after_restart(spark, tmp_path):
    schema = "id string, posted_at timestamp"

    def put(name, *items):
        spark.createDataFrame(items, "id string, posted_at string").withColumn("posted_at", F.col("posted_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    from pyspark.sql import types as T

    put("a", ("x", "2024-01-05 10:00:00"), ("y", "2024-01-05 11:00:00"), ("x", "2024-01-05 12:00:00"))
    run = lambda: streams.run_available(streams.dedupe_stream(streams.stream_listings(spark, str(tmp_path / "in" / "*"), T.StructType.fromDDL(schema)), ["id"]), path=str(tmp_path / "work"))
    assert sorted(r.id for r in run().collect()) == ["x", "y"]
    put("b", ("y", "2024-01-05 13:00:00"), ("z", "2024-01-05 14:00:00"), ("late", "2024-01-01 00:00:00"))
    assert sorted(r.id for r in run().collect()) == ["x", "y", "z"]
