"""Column functions over listing texts and item names: wear, price, canonical names, slugs, JSON answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wear names in order of quality, the wordings that mean them (first rule that holds wins; the same
# Simplified and Traditional wordings mean opposite wears), and the category words with their English names.
WEARS = ["Factory New", "Minimal Wear", "Field-Tested", "Well-Worn", "Battle-Scarred"]
WEAR_CODES = ["FN", "MW", "FT", "WW", "BS"]
WEAR_RULES = [
    (["崭新出厂", "嶄新出廠", "厂新", "全新", "崭新", "嶄新", "FN"], "Factory New"),
    (["略有磨损", "略有磨損", "輕微磨損", "轻微磨损", "MW"], "Minimal Wear"),
    (["久经沙场", "久經沙場", "久经", "久經", "FT"], "Field-Tested"),
    (["战痕累累"], "Battle-Scarred"),
    (["破損不堪"], "Battle-Scarred"),
    (["破损不堪"], "Well-Worn"),
    (["戰痕累累"], "Well-Worn"),
    (["戰痕", "战痕", "BS"], "Battle-Scarred"),
    (["破損", "破损", "WW"], "Well-Worn"),
]
NARROW_WEAR_RULES = [
    (["崭新出厂", "嶄新出廠", "厂新", "全新", "FN"], "Factory New"),
    (["略有磨损", "略有磨損", "輕微磨損", "MW"], "Minimal Wear"),
    *WEAR_RULES[2:],
]
WEAR_LABELS = {"Factory New": "崭新出厂", "Minimal Wear": "略有磨损", "Field-Tested": "久经沙场", "Well-Worn": "破损不堪", "Battle-Scarred": "战痕累累"}
CATEGORIES = [
    ("AK-47", "AK-47"), ("ak", "AK-47"), ("阿卡", "AK-47"), ("M4A1-S", "M4A1-S"), ("M4A4", "M4A4"), ("沙鹰", "Desert Eagle"), ("沙鷹", "Desert Eagle"),
    ("蝴蝶刀", "Butterfly Knife"), ("爪子刀", "Karambit"), ("爪刀", "Karambit"), ("刺刀", "Bayonet"), ("折刀", "Flip Knife"), ("锯齿爪刀", "Huntsman Knife"),
    ("穿肠刀", "Gut Knife"), ("猎刀", "Huntsman Knife"), ("猎杀者", "Huntsman Knife"), ("系绳者", "Talon Knife"), ("穿刺者", "Stiletto Knife"),
    ("求生匕首", "Survival Knife"), ("流浪者", "Nomad Knife"), ("骷髅匕首", "Skeleton Knife"), ("运动手套", "Sport Gloves"), ("專業手套", "Specialist Gloves"),
    ("专业手套", "Specialist Gloves"), ("驾驶手套", "Driver Gloves"), ("駕駛手套", "Driver Gloves"), ("摩托手套", "Moto Gloves"), ("手部束带", "Hand Wraps"),
    ("手部束帶", "Hand Wraps"), ("血猎手套", "Bloodhound Gloves"), ("血獵手套", "Bloodhound Gloves"), ("裹手", "Hand Wraps"), ("沙漠之鹰", "Desert Eagle"),
]
# Each category word has one of these parts: a text without any has no category, which a third of the tests tells.
CATEGORY_PARTS = ["AK-47", "ak", "阿卡", "M4A", "沙", "刀", "者", "匕首", "手套", "手部束", "裹手"]
STARRED = ["Knife", "Karambit", "Bayonet", "Gloves", "Wraps"]
WIDE_DIGITS = "０１２３４５６７８９"


def strip(c: Column) -> Column:
    """Without white space at both ends, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def first_rule(c: Column, rules: list[tuple[list[str], str]], default: str | None = None) -> Column:
    """Value of the first rule of which ``c`` contains a term."""
    out = F
    for terms, value in rules:
        out = out.when(contains_any(c, terms), F.lit(value))
    return out.otherwise(F.lit(default))


def wear_to_en(c: Column, rules=WEAR_RULES) -> Column:
    """English wear of a text, Field-Tested where nothing says one."""
    return first_rule(c, rules, "Field-Tested")


def wear_is_default(c: Column, rules=WEAR_RULES) -> Column:
    return first_rule(c, rules).isNull()


def wear_rank(c: Column) -> Column:
    """1 for the best wear up to 5; 0 for other values."""
    return F.array_position(F.array(*map(F.lit, WEARS)), c)


def wear_code(c: Column) -> Column:
    """Two-letter code of the wear a name contains, null without one."""
    named = F.regexp_extract(c, "(" + "|".join(WEARS) + ")", 1)
    return F.get(F.array(*map(F.lit, WEAR_CODES)), F.nullif(wear_rank(named), F.lit(0)).cast("int") - 1)


def map_get(pairs: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a small fixed map, else ``default``."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def wear_label(c: Column) -> Column:
    return map_get(WEAR_LABELS, c, "")


def match_category(c: Column, policy: str = "longest") -> Column:
    """Category whose word the text contains: the first in the list, or the longest word."""
    words = CATEGORIES if policy == "first" else sorted(CATEGORIES, key=lambda x: -len(x[0]))
    return F.when(contains_any(c, CATEGORY_PARTS), first_rule(c, [([w], name) for w, name in words]))


def is_starred(category: Column) -> Column:
    return F.coalesce(contains_any(category, STARRED), F.lit(False))


def plain_digits(c: Column) -> Column:
    return F.when(contains_any(c, [",", *WIDE_DIGITS]), F.translate(c, WIDE_DIGITS + ",", "0123456789")).otherwise(c)


def extract_price(c: Column, mode: str = "pattern", strip_urls: bool = True) -> Column:
    """Asking price in a text as a long, -1 without one.

    The number after 算 (mode pattern only), else after =, else the last one of three digits or more that follows no digit or dot.
    """

    def of(text: Column) -> Column:
        # the numbers of a pattern at a place, null without one: a test for the empty text would match the pattern twice
        numbers = lambda pattern, at: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(at))
        after = lambda sign, more: F.when(text.contains(sign), numbers(sign + more, 1))
        found = [after("算", r"(?:你|給|到)?\s*([0-9]+)")] * (mode == "pattern") + [after("=", r"\s*([0-9]+)"), numbers(r"(?<![0-9.])([0-9]{3,})", -1)]
        return F.coalesce(F.coalesce(*found).try_cast("long"), F.lit(-1))

    # transform over a one-element array names the cleaned text, so that it is made once
    bare = lambda text: F.when(text.contains("http"), F.regexp_replace(text, r"https?://\S+", " ")).otherwise(text) if strip_urls else text
    return F.get(F.transform(F.transform(F.transform(F.array(c), bare), plain_digits), of), 0)


def safe_number(c: Column, default: int | None = -1) -> Column:
    """Whole part of a number in text with thousands commas, ``default`` where it is none."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double").try_cast("long"), F.lit(default))


def falsy_coalesce(*cols: Column, default) -> Column:
    """First value that is neither null, zero nor empty."""
    zero = F.lit(0 if not isinstance(default, str) else "")
    return F.coalesce(*[F.nullif(c, zero) for c in cols], F.lit(default))


def parse_item_name(c: Column) -> Column:
    """Struct base, wear, prefix, display_key of a full item name; without a wear at its end the whole name is the base."""
    wear = F.regexp_extract(c, r"\((" + "|".join(WEARS) + r")\)$", 1)
    bare = strip(F.regexp_replace(c, r"\((?:" + "|".join(WEARS) + r")\)$", ""))
    prefix, base = F, F
    for start, sign in (("★ StatTrak™ ", "🔟★"), ("StatTrak™ ", "🔟"), ("Souvenir ", "🎁"), ("★ ", "★")):
        prefix = prefix.when(bare.startswith(start), F.lit(sign))
        base = base.when(bare.startswith(start), F.substring(bare, len(start) + 1, 1 << 30))
    prefix, base = prefix.otherwise(F.lit("")), base.otherwise(bare)
    worn = wear != ""
    return F.struct(F.when(worn, base).otherwise(c).alias("base"), wear.alias("wear"), F.when(worn, prefix).otherwise("").alias("prefix"),
                    F.when(worn, strip(F.concat_ws(" ", prefix, base))).otherwise(c).alias("display_key"))


def extract_pattern(c: Column) -> Column:
    """Second part between bars, trimmed; the whole trimmed name without a bar."""
    return strip(F.coalesce(F.get(F.split(c, r"\|"), F.lit(1)), c))


def is_special(c: Column) -> Column:
    return contains_any(c, ["暗金", "StatTrak"])


def canonical_name(target: Column, category: Column, wear: Column, special: Column, mode: str = "pattern") -> Column:
    """Full item name: from a full target, or from a pattern and its category."""
    if mode == "full":
        marked = F.when(target.contains("★ "), F.regexp_replace(target, r"^(.*?)★ ", "$1★ StatTrak™ ")).otherwise(F.concat(F.lit("StatTrak™ "), target))
        name = F.when(special & ~target.contains("StatTrak"), marked).otherwise(target)
    else:
        star = F.when(is_starred(category), "★ ").otherwise("")
        name = F.concat(star, F.when(special, "StatTrak™ ").otherwise(""), F.coalesce(F.concat(category, F.lit(" | ")), F.lit("")), target)
    return F.concat(name, F.lit(" ("), wear, F.lit(")"))


def slug_v1(c: Column) -> Column:
    """Lower case, joined by hyphens, without the wear at its end."""
    s = F.translate(F.lower(c), "'()", "")
    for old, new in (("★ ", ""), (" | ", "-"), (" ", "-")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, "-(fn|mw|ft|ww|bs)$", "")
    s = F.regexp_replace(s, "-(" + "|".join(w.lower().replace(" ", "-") for w in WEARS) + ")$", "")
    return F.regexp_replace(s, "^-+|-+$", "")


def slug_v2(c: Column) -> Column:
    """As the second quote source spells names: wear words dropped anywhere, doubled hyphens halved once."""
    s = c
    for old, new in (("★ ", ""), ("™", ""), (" | ", "-"), ("(", ""), (")", ""), ("'", ""), ("  ", " ")):
        s = F.replace(s, F.lit(old), F.lit(new))
    for w in WEARS:
        s = F.replace(F.replace(s, F.lit(f" {w}"), F.lit("")), F.lit(f"-{w.lower()}"), F.lit(""))
    s = strip(F.lower(s))
    return F.replace(F.replace(s, F.lit(" "), F.lit("-")), F.lit("--"), F.lit("-"))


def has_id(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def valid_name(c: Column) -> Column:
    return F.coalesce(~c.isin("", "NONE", "UNKNOWN"), F.lit(False))


def listing_side(c: Column) -> Column:
    """seller or buyer by the first letter of the text, null where it says neither."""
    start = r"^[\s\p{P}]*"
    return F.when(c.rlike(start + "[售賣出]"), "seller").when(c.rlike(start + "[收換求]"), "buyer")


def quoted_rate(c: Column, floor_to: int = 100) -> Column:
    """Struct base, rate, quoted, computed of a text such as 2100*4.4=9200; computed is rounded down to ``floor_to``."""
    part = lambda k, kind: F.nullif(F.regexp_extract(plain_digits(c), r"([0-9]+)\s*\*\s*([0-9]+(?:\.[0-9]+)?)\s*=\s*([0-9]+)", k), F.lit("")).try_cast(kind)
    value = F.floor(part(1, "double") * part(2, "double") / floor_to).cast("long") * floor_to
    return F.struct(part(1, "long").alias("base"), part(2, "double").alias("rate"), part(3, "long").alias("quoted"), value.alias("computed"))


def render_item(name: Column, wear: Column, price: Column, currency: Column, special: Column, most: int = 200) -> Column:
    """Listing text of an item read from an image."""
    full = F.concat(F.when(special, "StatTrak ").otherwise(""), name)
    return F.substring(F.concat_ws(" ", F.lit("[圖片] 售"), full, wear, F.concat(price.cast("long").cast("string"), currency)), 1, most)


def parse_model_json(c: Column, schema: str) -> Column:
    """Array of structs (``schema``: their DDL) in an answer that may be fenced and may be one object; null where it is neither."""
    kind = T.StructType.fromDDL(schema)
    body = strip(F.regexp_replace(strip(c), r"^```[a-z]*\s*|\s*```$", ""))
    many = F.from_json(body, T.ArrayType(kind))
    one = F.from_json(body, kind)
    return F.when(body.startswith("["), many).when(body.startswith("{"), F.array(one))
