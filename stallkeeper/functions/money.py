"""Column functions over money: conversion, economics, display."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# TWD for an RMB, RMB for a US dollar, share left after the market's fee.
TWD_PER_RMB, RMB_PER_USD, AFTER_FEE = 4.5, 7.2, 0.985


def to_twd(amount: Column, currency: Column, policy: str = "cents") -> Column:
    """Amount in TWD, as decimal(38,2); TWD amounts stay. ``policy``: whole (half to even), cents (half up), truncate.

    Money is counted in decimals of two places, so that a tie is a tie: 1 RMB is 4.5 TWD, 4 by the whole policy, 3 RMB are 14.
    """
    money = amount.cast("decimal(18,2)")
    rmb = F.when(currency == "USD", F.round(money * F.lit(Decimal(str(RMB_PER_USD))), 2)).otherwise(money)
    twd = rmb * F.lit(Decimal(str(TWD_PER_RMB)))
    value = {"whole": F.bround(twd, 0), "cents": F.round(twd, 2), "truncate": F.when(twd < 0, F.ceil(twd)).otherwise(F.floor(twd))}[policy]
    return F.when(currency == "TWD", money).otherwise(value).cast("decimal(38,2)")


def economics(price: Column, ask: Column, fee: float = AFTER_FEE) -> Column:
    """Struct net, profit, margin (per cent of the ask; 0 where the ask isn't positive)."""
    net = price * fee
    return F.struct(net.alias("net"), (net - ask).alias("profit"), F.when(ask > 0, (net - ask) / ask * 100).otherwise(0.0).alias("margin"))


def fmt_money(c: Column) -> Column:
    return F.concat(F.lit("NT$"), F.format_number(c, 0))


def fmt_pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def fmt_sign(c: Column) -> Column:
    return F.when(c >= 0, "+").otherwise("")


def ts_text(c: Column) -> Column:
    return F.substring(F.date_trunc("second", c).cast("string"), 1, 19)


def ts_short(c: Column) -> Column:
    """Month to minute of a timestamp's text."""
    return F.substring(ts_text(c), 6, 11)


def in_hours(ts: Column, start: str = "08:00:00", end: str = "23:00:00") -> Column:
    """Whether the time of day lies in the closed interval."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("second"), ts)
    at = lambda t: sum(int(x) * k for x, k in zip(t.split(":"), (3600, 60, 1)))
    return seconds.between(at(start), at(end))
