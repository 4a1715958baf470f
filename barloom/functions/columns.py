"""Column functions of the daily panel; null is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def by_symbol():
    """Rows of a symbol in the order of dates."""
    return Window.partitionBy("symbol").orderBy("date")



def number(c: Column) -> Column:
    """A double, null where it can't be read or isn't a number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def rounded(x: Column, digits: int) -> Column:
    """x at so many digits, halves up, by plain double arithmetic, so that any engine gets the same bits."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def last_rows(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def rolling(f, x: Column, n: int, least: int) -> Column:
    """f of x over the last n rows of the symbol, null with fewer than `least` values."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, f(x).over(w))


def rolling_dollar_mean(x: Column, n: int, least: int) -> Column:
    """Mean of money over the last n rows, summed exactly as whole cents."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, F.sum(F.floor(x * 100 + 0.5)).over(w) / 100.0 / F.count(x).over(w))


def period_return(filled: Column, k: int) -> Column:
    """Return over k rows of a price that is filled forward; null where the base is null or 0."""
    return F.try_divide(filled, F.lag(filled, k).over(by_symbol())) - 1


def pct_rank(x: Column, ascending: bool = True) -> Column:
    """Rank within the date, ties averaged, over the number of values; null stays null."""
    w = Window.partitionBy("date").orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + (peers - 1) / 2.0) / F.count(x).over(Window.partitionBy("date")))


def cost_fraction(notional: Column, adv: Column, vol: Column, half_spread_bps: float = 1.5, slippage_bps: float = 1.0, impact: float = 0.1) -> Column:
    """Cost as a share of a trade's value: spread and slippage, and impact by the root of participation."""
    push = F.when((adv > 0) & (vol > 0), impact * vol * F.sqrt(F.try_divide(notional, adv))).otherwise(0.0)
    return F.when(notional > 0, (half_spread_bps + slippage_bps) / 1e4 + push).otherwise(0.0)


#: Industry code ranges and their sectors; the first that holds a code counts.
SIC_SECTORS = [
    (100, 999, "Energy"),
    (1000, 1499, "Materials"),
    (1500, 1799, "Industrials"),
    (2000, 2399, "Consumer Staples"),
    (3570, 3699, "Information Technology"),
    (3810, 3839, "Information Technology"),
    (2400, 3999, "Industrials"),
    (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"),
    (4900, 4949, "Utilities"),
    (5000, 5199, "Industrials"),
    (5200, 5999, "Consumer Discretionary"),
    (6000, 6499, "Financials"),
    (6500, 6999, "Real Estate"),
    (7000, 7299, "Consumer Discretionary"),
    (7300, 7399, "Industrials"),
    (7500, 7999, "Consumer Discretionary"),
    (8000, 8099, "Health Care"),
    (8100, 8999, "Industrials"),
    (9100, 9729, "Utilities"),
]


def code_sector(code: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Sector of the first range that holds the code, else Unknown."""
    n, out = code.try_cast("double").try_cast("int"), F.lit("Unknown")
    for lo, hi, name in reversed(ranges):
        out = F.when(n.between(lo, hi), name).otherwise(out)
    return out
