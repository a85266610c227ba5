"""Schemas of the engine's tables; readers never infer."""

from __future__ import annotations


class Schema(str):
    """A schema as DDL, which every reader takes."""

    @property
    def names(self) -> list[str]:
        return [field.split()[0] for field in self.split(", ")]


def _s(**fields: str) -> Schema:
    return Schema(", ".join(f"{k} {v}" for k, v in fields.items()))


PRICES = _s(item="string", price_twd="double", volume="bigint", last_updated="timestamp")
LISTINGS = _s(id="string", author="string", content="string", link="string", currency="string", posted_at="timestamp")
ITEM = "struct<name:string,wear:string,price:double,currency:string,stattrak:boolean>"
FEED_POSTS = _s(id="string", author="string", text="string", posted_at="timestamp", images="array<string>", url="string", alt_text="string", items=f"array<{ITEM}>")
CATALOGUE = _s(id="string", name="string")
TERMS = _s(kind="string", term="string", target="string", source="string", priority="int", ord="bigint")
QUOTES = _s(item="string", source="string", source_rank="int", price_rmb="double", price_twd="double", wear="string", fetched_at="timestamp")
DEALS = _s(post_id="string", author="string", skin_name="string", link="string", market_price="double", seller_price="double", profit="double",
           profit_margin="double", volume="bigint", reason="string", risk="string", created_at="timestamp")
READINGS = _s(image_id="string", item_id="int", attempt="int", name="string", wear="string", is_checked="boolean", confidence="double", price="double", currency="string")
CANDIDATES = _s(code="string", data="struct<items:array<struct<market_hash_name:string,name:string,sell_min_price:string,sell_num:bigint,volume:bigint>>>")
USD_QUOTE = _s(ask="string", name="string")

# Items whose prices are kept in step, with their names in Chinese.
WATCHLIST = [
    ("AK-47 | Fire Serpent (Minimal Wear)", "AK-47 | 火蛇 (略有磨损)"),
    ("AK-47 | Fire Serpent (Field-Tested)", "AK-47 | 火蛇 (久经沙场)"),
    ("AWP | Asiimov (Field-Tested)", "AWP | 二西莫夫 (久经沙场)"),
    ("AWP | Asiimov (Battle-Scarred)", "AWP | 二西莫夫 (战痕累累)"),
    ("AWP | Dragon Lore (Field-Tested)", "AWP | 巨龙传说 (久经沙场)"),
    ("Desert Eagle | Blaze (Factory New)", "沙漠之鹰 | 烈焰 (崭新出厂)"),
    ("M4A4 | Howl (Field-Tested)", "M4A4 | 咆哮 (久经沙场)"),
    ("M4A1-S | Printstream (Factory New)", "M4A1 消音型 | 印花集 (崭新出厂)"),
    ("AK-47 | Redline (Field-Tested)", "AK-47 | 红线 (久经沙场)"),
    ("USP-S | Kill Confirmed (Minimal Wear)", "USP 消音版 | 击杀确认 (略有磨损)"),
    ("Glock-18 | Fade (Factory New)", "Glock-18 | 渐变之色 (崭新出厂)"),
    ("Butterfly Knife | Fade (Factory New)", "蝴蝶刀 | 渐变之色 (崭新出厂)"),
    ("Karambit | Doppler (Factory New)", "爪子刀 | 多普勒 (崭新出厂)"),
    ("M9 Bayonet | Doppler (Factory New)", "M9 刺刀 | 多普勒 (崭新出厂)"),
    ("Talon Knife | Fade (Factory New)", "折叠刀 | 渐变之色 (崭新出厂)"),
]
