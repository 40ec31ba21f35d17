"""Scalar expressions: guards for undefined values, calendar phases, costs, sector ladders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def log_ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    """ln((a + eps) / (b + eps)); null where it is not defined."""
    return F.ln(F.try_divide(a + eps, b + eps))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clipped(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def neutralised(x: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def iso_weekday(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def quarter_phase(ts: Column) -> Column:
    """Place in a 91-day cycle of the year, 0 to 1: not the calendar quarter."""
    return F.pmod(F.dayofyear(ts) - 1, F.lit(91)) / 91.0


def on_circle(phase: Column, name: str) -> list[Column]:
    """sin and cos of a phase of 0 to 1."""
    turn = phase * (2 * math.pi)
    return [F.sin(turn).alias(f"{name}_sin"), F.cos(turn).alias(f"{name}_cos")]


def daily_phases(ts: Column) -> list[Column]:
    return [*on_circle(iso_weekday(ts) / 5.0, "day"), *on_circle(F.month(ts) / 12.0, "month"), *on_circle(quarter_phase(ts), "quarter")]


def minute_phases(ts: Column) -> list[Column]:
    return [*on_circle(F.minute(ts) / 60.0, "minute"), *on_circle(F.hour(ts) / 24.0, "hour"), *on_circle(F.weekday(ts) / 5.0, "day")]


# Cost rates per share, per dollar, cap; spread and slippage of an execution.
CAT_PER_SHARE = 0.0000265
SEC_PER_DOLLAR = 20.60e-6
TAF_PER_SHARE = 0.000166
TAF_CAP = 8.30


def execution_price(price: Column, side: str, spread: float, slippage: float) -> Column:
    """Half the spread and a share of the price against the trader."""
    cost = spread / 2 + price * slippage
    return price + cost if side == "buy" else price - cost


def regulatory_fees(side: str, shares: Column, notional: Column, to_the_penny: bool = True) -> Column:
    """Fees of a trade; sales also pay the SEC and TAF fees, rounded up to the penny unless to_the_penny is off."""
    up = (lambda x: F.ceil(x * 100) / 100.0) if to_the_penny else (lambda x: x)
    fee = shares * CAT_PER_SHARE
    if side == "buy":
        return fee
    return fee + up(notional * SEC_PER_DOLLAR) + F.least(up(shares * TAF_PER_SHARE), F.lit(TAF_CAP))


def softmax_weights(actions: Column, cash_logit: float = 0.0) -> Column:
    """Portfolio weights of an array of logits; what the fixed cash logit takes is left as cash."""
    top = F.greatest(F.array_max(actions), F.lit(cash_logit))
    total = F.aggregate(actions, F.exp(F.lit(cash_logit) - top), lambda a, x: a + F.exp(x - top))
    return F.transform(actions, lambda x: F.exp(x - top) / total)


# Sector names by id.
SECTORS = (
    "energy", "materials_industrial", "tech_hardware", "software_services", "healthcare", "financials",
    "real_estate", "consumer_disc", "consumer_staples", "telecom_media", "utilities", "other",
)
OTHER = 11
# The sector id of SIC codes by their first two digits, each row up to and including its first number.
SIC_UP_TO = [(9, 8), (14, 0), (17, 1), (21, 8), (27, 1), (28, 4), (29, 0), (34, 1), (36, 2), (39, 1), (47, 1), (48, 9), (49, 10),
             (59, 7), (64, 5), (65, 6), (67, 5), (72, 7), (73, 3), (79, 7), (80, 4), (89, 7)]
# Sector ids of funds, which have no SIC code of their own.
FUND_SECTORS = {
    "XLK": 2, "XLF": 5, "XLE": 0, "XLV": 4, "XLI": 1, "XLY": 7, "XLP": 8, "XLU": 10, "XLB": 1, "XLRE": 6, "XLC": 9,
    **dict.fromkeys(("SPY", "QQQ", "IWM", "MDY", "TLT", "IEF", "SHY", "LQD", "HYG", "VIXY", "VIXM", "UUP", "GLD", "USO", "EFA", "EEM", "EWJ"), OTHER),
}


def sic_sector(sic: Column) -> Column:
    """Sector id of a SIC code given as text; `other` where it is no number or beyond the table."""
    two = F.substring(sic, 1, 2).try_cast("int")
    out = F.lit(OTHER)
    for last, sector in reversed(SIC_UP_TO):
        out = F.when(two <= last, sector).otherwise(out)
    return out


def sector_name(sector: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in SECTORS]), sector + 1)


def security_sector(ticker: Column, sic: Column) -> Column:
    """Sector id: of a fund by its name, else by SIC code."""
    funds = F.create_map(*[F.lit(x) for pair in FUND_SECTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(funds, ticker), sic_sector(sic))


def sector_flags(sector: Column) -> list[Column]:
    """A 0/1 column for each sector."""
    return [(sector == k).cast("double").alias(f"sector_{name}") for k, name in enumerate(SECTORS)]
