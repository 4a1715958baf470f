"""Time-series factors by symbol and their cross-sectional ranks by date: two shuffles; a date's ranks are made by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import by_symbol, period_return, rolling, rolling_dollar_mean, rounded

#: Ranks, the factor each is of, and whether more is better.
RANKS = [("r_mom_5d", "mom_5d", True), ("r_mom_21d", "mom_21d", True), ("r_rev_5d", "rev_5d", True), ("r_vol_21d", "vol_21d", False), ("r_vol_ratio", "vol_ratio", False), ("r_volume_accel", "volume_accel", True), ("r_range", "range", False)]

#: Rows of a symbol that its latest score depends on: 63 returns and the price before them.
LOOK_BACK = 64


def factors(bars: DataFrame) -> DataFrame:
    """bars with returns, volatilities, liquidity and range."""
    filled = F.last("adj_close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    df = bars.withColumn("filled", filled)
    df = df.withColumns({"ret_1d": period_return(F.col("filled"), 1), **{f"mom_{k}d": period_return(F.col("filled"), k) for k in (5, 21, 252)}})
    df = df.withColumns({"vol_21d": rolling(F.stddev_samp, F.col("ret_1d"), 21, 10), "vol_63d": rolling(F.stddev_samp, F.col("ret_1d"), 63, 20), "adv5": rolling_dollar_mean(F.col("dollar_volume"), 5, 3), "adv20": rolling_dollar_mean(F.col("dollar_volume"), 20, 10)})
    return df.withColumns({
        "rev_5d": -F.col("mom_5d"),
        "vol_ratio": F.try_divide("vol_21d", "vol_63d"),
        "volume_accel": F.try_divide("adv5", "adv20"),
        "range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
    }).drop("filled")


def averaged_ranks(x: np.ndarray, ascending: bool) -> np.ndarray:
    """pct_rank() of an array: ties averaged, over the number of values; NaN stays NaN."""
    out, there = np.full(len(x), np.nan), ~np.isnan(x)
    _, place, count = np.unique(x[there] if ascending else -x[there], return_inverse=True, return_counts=True)
    out[there] = (np.cumsum(count) - (count - 1) / 2.0)[place] / there.sum()
    return out


def _ranked(day: pa.Table) -> pa.Table:
    for name, _, up in RANKS:
        ranks = averaged_ranks(day.column(name).to_numpy(), up)
        day = day.set_column(day.schema.get_field_index(name), name, pa.array(ranks, from_pandas=True))
    return day


def scored(df: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Factors with their ranks within the date, and score: the mean of the ranks that are there.

    keep names the columns, date among them, that stay beside ranks and score; all by default. A date's rows meet once, as
    one Arrow table, where seven windows would sort them seven times.
    """
    df = df.select(*(df.columns if keep is None else keep), *(rounded(F.col(factor), 9).alias(name) for name, factor, _ in RANKS))
    df = df.groupBy("date").applyInArrow(_ranked, df.schema)
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n, _, _ in RANKS[1:]), F.coalesce(F.col(RANKS[0][0]), F.lit(0.0)))
    there = sum((F.col(n).isNotNull().cast("int") for n, _, _ in RANKS[1:]), F.col(RANKS[0][0]).isNotNull().cast("int"))
    return df.withColumn("score", F.try_divide(total, there))
