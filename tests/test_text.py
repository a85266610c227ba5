"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import money as M
from stallkeeper.functions import text as X


def value(spark, fn, *args):
    row = spark.createDataFrame([args], ", ".join(f"c{i} {'double' if isinstance(a, float) else 'string'}" for i, a in enumerate(args)))
    return row.select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(("text", "wear"), [
    ("崭新出厂", "Factory New"), ("嶄新", "Factory New"), ("FN", "Factory New"), ("略有磨损", "Minimal Wear"), ("輕微磨損", "Minimal Wear"), ("久經沙場", "Field-Tested"),
    ("战痕累累", "Battle-Scarred"), ("戰痕累累", "Well-Worn"), ("破損不堪", "Battle-Scarred"), ("破损不堪", "Well-Worn"), ("戰痕", "Battle-Scarred"), ("破損", "Well-Worn"), ("略磨 0.13", "Field-Tested"),
])
def test_wear(spark, text, wear):
    assert value(spark, X.wear_to_en, text) == wear


def test_wear_default_and_narrow(spark):
    assert value(spark, X.wear_is_default, "略磨") and not value(spark, X.wear_is_default, "MW")
    assert value(spark, lambda c: X.wear_to_en(c, X.NARROW_WEAR_RULES), "崭新") == "Field-Tested"
    assert value(spark, X.wear_rank, "Well-Worn") == 4 and value(spark, X.wear_code, "AK-47 | Redline (Field-Tested)") == "FT"
    assert value(spark, X.wear_code, "Sticker") is None and value(spark, X.wear_label, "Well-Worn") == "破损不堪"


@pytest.mark.parametrize(("text", "options", "price"), [
    ("底2100*4.4=9240 去尾算9,200", {}, 9200), ("同磨底 2100*4.4=9200", {}, 9200), ("賣 21,000台幣", {}, 21000), ("AK-47 0.1637", {}, -1),
    ("賣 3200\nhttp://h.example/p/001", {}, 3200), ("賣 3200\nhttp://h.example/p/001", {"strip_urls": False}, 1), ("賣 ２１０００", {}, 21000),
    ("=9240 算5000", {"mode": "full"}, 9240), ("", {}, -1), ("9" * 30, {}, -1),
])
def test_price(spark, text, options, price):
    assert value(spark, lambda c: X.extract_price(c, **options), text) == price


@pytest.mark.parametrize(("name", "parts"), [
    ("AK-47 | Redline (Field-Tested)", ("AK-47 | Redline", "Field-Tested", "", "AK-47 | Redline")),
    ("★ StatTrak™ Karambit | Fade (Factory New)", ("Karambit | Fade", "Factory New", "🔟★", "🔟★ Karambit | Fade")),
    ("Souvenir AWP | X (Well-Worn)", ("AWP | X", "Well-Worn", "🎁", "🎁 AWP | X")),
    ("Sticker | Y", ("Sticker | Y", "", "", "Sticker | Y")),
])
def test_item_name(spark, name, parts):
    assert tuple(value(spark, X.parse_item_name, name)) == parts


def test_names(spark):
    assert value(spark, X.extract_pattern, "AWP | Asiimov ") == "Asiimov" and value(spark, X.extract_pattern, " Howl ") == "Howl"
    full = lambda t: value(spark, lambda c: X.canonical_name(c, F.lit(None).cast("string"), F.lit("Well-Worn"), F.lit(True), "full"), t)
    assert full("★ Karambit | Fade") == "★ StatTrak™ Karambit | Fade (Well-Worn)" and full("AWP | X") == "StatTrak™ AWP | X (Well-Worn)"
    made = lambda p, c: value(spark, lambda a, b: X.canonical_name(a, b, F.lit("Factory New"), F.lit(False)), p, c)
    assert made("Fade", "Talon Knife") == "★ Talon Knife | Fade (Factory New)" and made("Fade", "M4A4") == "M4A4 | Fade (Factory New)"
    assert value(spark, X.match_category, "锯齿爪刀") == "Huntsman Knife" and value(spark, lambda c: X.match_category(c, "first"), "锯齿爪刀") == "Karambit"
    assert value(spark, X.slug_v1, "★ Karambit | Doppler (Factory New)") == "karambit-doppler"
    assert value(spark, X.slug_v2, "★ StatTrak™ Karambit | Doppler (Factory New)") == "stattrak-karambit-doppler"
    assert value(spark, X.listing_side, "【售】AK") == "seller" and value(spark, X.listing_side, "收 AK") == "buyer" and value(spark, X.listing_side, "AK") is None


def test_numbers_and_json(spark):
    assert value(spark, X.safe_number, "1,234.9") == 1234 and value(spark, X.safe_number, "x") == -1
    assert value(spark, X.strip, "　 a b\n\t") == "a b"
    assert [r.k for r in value(spark, lambda c: X.parse_model_json(c, "k bigint"), '```json\n{"k": 3}\n```')] == [3]
    assert value(spark, lambda c: X.parse_model_json(c, "k bigint"), "no json") is None
    assert tuple(value(spark, X.quoted_rate, "底2100*4.4=9200")) == (2100, 4.4, 9200, 9200)
    assert not value(spark, X.valid_name, "NONE") and value(spark, X.valid_name, "AK")


def test_money(spark):
    to = lambda x, c, p: value(spark, lambda a, b: M.to_twd(a, b, p), x, c)
    assert (to(1.0, "RMB", "whole"), to(3.0, "RMB", "whole"), to(3.0, "RMB", "truncate"), to(5.0, "TWD", "whole")) == (4, 14, 13, 5)
    e = value(spark, M.economics, 1000.0, 900.0)
    assert (e.net, e.profit, round(e.margin, 3)) == (985, 85, 9.444) and value(spark, M.economics, 1.0, 0.0).margin == 0
    assert value(spark, M.fmt_money, 1234.5) == "NT$1,234" and value(spark, M.fmt_sign, -1.0) == ""


def test_every_category_word_has_a_part():
    assert all(any(p in w for p in X.CATEGORY_PARTS) for w, _ in X.CATEGORIES)
