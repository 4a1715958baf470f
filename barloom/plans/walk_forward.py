"""Walk-forward folds and the replay of target weights, fold by fold.

Factors and desired weights of all dates are one DataFrame plan. Only shares, equity and the turnover cap carry state
from day to day; they are replayed in one grouped Python call for each fold, whose rows are a few months of the symbols that
have a weight in them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import compounded, drawdowns, sharpe


@dataclass(frozen=True)
class Settings:
    train_months: int = 60
    valid_months: int = 12
    test_months: int = 3
    embargo_days: int = 5
    expanding: bool = True
    warm_up: int = 252
    lag: int = 1
    horizon: int = 1
    max_weight: float = 0.05
    max_turnover: float = 0.20
    equity: float = 250_000.0
    cash_buffer: float = 0.02
    min_trade: float = 25.0
    fractional: bool = True
    participation: float = 0.05
    half_spread_bps: float = 1.5
    slippage_bps: float = 1.0
    impact: float = 0.1


def folds(days: list[pd.Timestamp], s: Settings) -> list[tuple]:
    """(fold_id, train_start, train_end, valid_start, valid_end, test_start, test_end) over sorted trading days."""
    if len(days) < s.warm_up + 252:
        return []
    out, start, goal = [], days[0], days[0] + pd.DateOffset(months=s.train_months)

    def before(t):
        i = bisect_right(days, t)
        return days[i - 1] if i else None

    def after(t):
        i = bisect_left(days, t)
        return days[i] if i < len(days) else None

    while len(out) <= 200:
        train_end = before(goal)
        valid_start = train_end is not None and after(train_end + pd.offsets.BDay(s.embargo_days + 1)) or None
        valid_end = valid_start and before(valid_start + pd.DateOffset(months=s.valid_months))
        test_start = valid_end and after(valid_end + pd.offsets.BDay(1)) or None
        test_end = test_start and before(test_start + pd.DateOffset(months=s.test_months))
        if not test_end or test_end <= test_start:
            break
        out.append((len(out), start, train_end, valid_start, valid_end, test_start, test_end))
        shift = pd.DateOffset(months=s.test_months)
        if not s.expanding:
            start = after(start + shift) or start
        goal = train_end + shift
        if test_end >= days[-1]:
            break
    return out


def fold_table(calendar: DataFrame, s: Settings) -> DataFrame:
    """Folds as a table; the calendar is a few thousand days at most."""
    rows = [(f[0], *(d.date() for d in f[1:])) for f in folds(_days(calendar), s)]
    return calendar.sparkSession.createDataFrame(rows, "fold_id int, train_start date, train_end date, valid_start date, valid_end date, test_start date, test_end date")


def tested_days(calendar: DataFrame, s: Settings) -> DataFrame:
    """fold_id, date, entry_date and exit_date of every day of a fold's test span; later dates are null past the end.

    The calendar, which folds need on the driver anyway, is read once, and plans that meet the table don't make it again.
    """
    days = _days(calendar)
    at = lambda i: days[i].date() if i < len(days) else None
    spans = ((f[0], range(bisect_left(days, f[5]), bisect_right(days, f[6]))) for f in folds(days, s))
    rows = [(k, at(i), at(i + s.lag), at(i + s.lag + s.horizon)) for k, span in spans for i in span]
    return calendar.sparkSession.createDataFrame(rows, "fold_id int, date date, entry_date date, exit_date date")


def _days(calendar: DataFrame) -> list[pd.Timestamp]:
    return sorted(pd.Timestamp(r[0]) for r in calendar.select("date").collect())


RESULT = "fold_id int, as_of_date date, entry_date date, exit_date date, positions int, turnover double, gross_exposure double, cash_weight double, portfolio_equity double, gross_return double, cost_return double, net_return double"

#: What was held on a day, for each symbol of positive weight; with its sector where the panel has one.
HELD = "held array<struct<symbol: string, weight: double, ret: double>>"
HELD_SECTOR = "held array<struct<symbol: string, weight: double, ret: double, sector: string>>"


def _replay(s: Settings):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        shares: dict[str, float] = {}
        weights: dict[str, float] = {}
        equity, rows = s.equity, []
        shown = ["symbol", "weight", "ret", *(c for c in pdf.columns if c == "sector")]
        for _, day in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True):
            ok = day[day["eligible"]]
            desired = dict(zip(ok["symbol"], ok["weight"].fillna(0.0), strict=True))
            target = _step(desired, {k: w for k, w in weights.items()}, s)
            target = {k: w for k, w in target.items() if k in desired}
            day = day[(day["entry"] > 0) & (day["exit"] > 0)]
            if not target or day.empty or pd.isna(day["entry_date"].iloc[0]) or pd.isna(day["exit_date"].iloc[0]):
                continue
            entry, exit_ = day["entry"].to_numpy(), day["exit"].to_numpy()
            adv, vol = day["adv20"].fillna(0.0).to_numpy(), day["vol_21d"].fillna(0.0).to_numpy()
            now = np.array([shares.get(k, 0.0) for k in day["symbol"]]) * entry
            raw = max(equity * (1 - s.cash_buffer), 0.0) * np.array([target.get(k, 0.0) for k in day["symbol"]])
            change, most = raw - now, adv * s.participation
            value = np.where(np.abs(change) < s.min_trade, now, np.where((adv > 0) & (np.abs(change) > most), np.maximum(now + np.sign(change) * most, 0.0), raw))
            held = value / entry
            if not s.fractional:
                held = np.floor(np.maximum(value, 0.0) / entry + 1e-12)
                value = held * entry
            traded = np.abs(value - now)
            push = np.where((adv > 0) & (vol > 0), s.impact * vol * np.sqrt(traded / np.where(adv > 0, adv, 1.0)), 0.0)
            cost = float((traded / equity * np.where(traded > 0, (s.half_spread_bps + s.slippage_bps) / 1e4 + push, 0.0)).sum())
            w, keep = value / equity, held > 1e-10
            if not (w > 0).any():
                continue
            ret = exit_ / entry - 1
            gross = float((w * ret)[w > 0].sum())
            held_now = day.assign(weight=w, ret=ret).loc[w > 0, shown].to_dict("records")
            shares = dict(zip(day["symbol"][keep], held[keep], strict=True))
            weights = dict(zip(day["symbol"][keep], w[keep], strict=True))
            turnover, exposure = float(0.5 * (traded / equity).sum()), float(w[keep].sum())
            equity *= 1 + gross - cost
            first = day.iloc[0]
            rows.append((int(first["fold_id"]), first["date"], first["entry_date"], first["exit_date"], int(keep.sum()), turnover, exposure, max(0.0, 1 - exposure), equity, gross, cost, gross - cost, held_now))
        return pd.DataFrame(rows, columns=[*(c.split()[0] for c in RESULT.split(", ")), "held"])

    return fold


def _step(desired: dict, previous: dict, s: Settings) -> dict:
    """Weights moved from previous towards desired within the turnover cap."""
    if not previous or s.max_turnover <= 0:
        return {k: w for k, w in desired.items() if w > 1e-8}
    names = desired.keys() | previous.keys()
    turn = 0.5 * sum(abs(desired.get(k, 0.0) - previous.get(k, 0.0)) for k in names)
    if turn <= s.max_turnover:
        return {k: w for k, w in desired.items() if w > 1e-8}
    part = s.max_turnover / turn
    moved = {k: min(max(previous.get(k, 0.0) + part * (desired.get(k, 0.0) - previous.get(k, 0.0)), 0.0), s.max_weight) for k in names}
    total = sum(moved.values())
    return {k: w / max(total, 1.0) for k, w in moved.items() if w / max(total, 1.0) > 1e-8}


def dated(calendar: DataFrame, lag: int = 1, horizon: int = 1) -> DataFrame:
    """date, entry_date and exit_date of every trading day; null past the end."""
    days = calendar.select("date", "idx")
    later = lambda n, name: days.select((F.col("idx") - n).alias("idx"), F.col("date").alias(name))
    return days.join(later(lag, "entry_date"), "idx", "left").join(later(lag + horizon, "exit_date"), "idx", "left").drop("idx")


def with_opens(rows: DataFrame, opens: DataFrame) -> DataFrame:
    """rows (symbol, entry_date, exit_date) with columns entry and exit: the opens (date, symbol, open) of both days."""
    for name in ("entry", "exit"):
        rows = rows.join(opens.select(F.col("date").alias(f"{name}_date"), "symbol", F.col("open").alias(name)), [f"{name}_date", "symbol"], "left")
    return rows


def opened_ahead(panel: DataFrame, calendar: DataFrame, lag: int = 1, horizon: int = 1) -> DataFrame:
    """panel (date, symbol, open, ...) with columns entry and exit: the symbol's opens so many trading days later. (date, symbol)
    is unique; one sort by symbol, and no join but that with the calendar."""
    ahead = lambda n: F.max("open").over(Window.partitionBy("symbol").orderBy("barloom_idx").rangeBetween(n, n))
    rows = panel.join(F.broadcast(calendar.select("date", F.col("idx").alias("barloom_idx"))), "date")
    return rows.withColumns({"entry": ahead(lag), "exit": ahead(lag + horizon)}).drop("barloom_idx")


def equal_weight(rows: DataFrame, s: Settings | None = None) -> DataFrame:
    """date and baseline_equal_weight: the mean open-to-open return of rows (date, entry, exit), less what stays in cash."""
    ret = F.when((F.col("entry") > 0) & (F.col("exit") > 0), F.col("exit") / F.col("entry") - 1)
    return rows.groupBy("date").agg((F.avg(ret) * (1 - (s or Settings()).cash_buffer)).alias("baseline_equal_weight"))


def walk_forward(panel: DataFrame, weights: DataFrame, calendar: DataFrame, s: Settings, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Daily results of every fold, with what was held. panel: date, symbol, adv20, vol_21d, eligible, and entry and exit, or open to
    make them of, and sector if holdings are to have it; weights: date, symbol, weight.

    Folds meet the calendar first, a row for each day of a fold's test span, so that the panel joins by equal dates only. Of
    a fold only the symbols that it gives a weight on some day are replayed: no other is ever held. The folds' weights are met
    twice; store, which writes a table and reads it again, lets Spark know their size before the panel is dealt out for them.
    """
    tested = tested_days(calendar, s)
    weights = weights.select("date", "symbol", "weight").join(F.broadcast(tested.select("date", "fold_id")), "date")
    weights = store(weights) if store else weights
    panel = panel if "entry" in panel.columns else opened_ahead(panel, calendar, s.lag, s.horizon)
    sector = [c for c in panel.columns if c == "sector"]
    rows = panel.select("date", "symbol", "adv20", "vol_21d", "eligible", "entry", "exit", *sector).join(F.broadcast(tested), "date")
    rows = rows.join(weights.where("weight > 0").select("fold_id", "symbol"), ["fold_id", "symbol"], "left_semi").join(weights, ["fold_id", "date", "symbol"], "left")
    return rows.groupBy("fold_id").applyInPandas(_replay(s), f"{RESULT}, {HELD_SECTOR if sector else HELD}")


def baselines(panel: DataFrame, calendar: DataFrame | None, top_k: int, benchmark: str, s: Settings | None = None) -> DataFrame:
    """date, baseline_spy, baseline_equal_weight and baseline_momentum: open-to-open returns, less what stays in cash.

    panel: date, symbol, open (or entry and exit), mom_252d, active. They are the return of the benchmark symbol, the mean over active names, and that
    over the top_k of all names of the day by momentum; names without both opens drop out after they are ranked.
    """
    s = s or Settings()
    order = Window.partitionBy("date").orderBy(F.col("mom_252d").desc_nulls_last(), "symbol")
    top = (F.row_number().over(order) <= top_k) & F.col("mom_252d").isNotNull()
    rows = panel if "entry" in panel.columns else opened_ahead(panel.select("date", "symbol", "open", "active", "mom_252d"), calendar, s.lag, s.horizon)
    rows = rows.withColumn("top", top).withColumn("ret", F.when((F.col("entry") > 0) & (F.col("exit") > 0), F.col("exit") / F.col("entry") - 1))
    mean = lambda which, f=F.avg: f(F.when(which, F.col("ret"))) * (1 - s.cash_buffer)
    return rows.groupBy("date").agg(mean(F.col("symbol") == benchmark, F.max).alias("baseline_spy"), mean(F.col("active")).alias("baseline_equal_weight"), mean(F.col("top")).alias("baseline_momentum"))


def summarised(results: DataFrame) -> DataFrame:
    """One row over all folds' days: counts, dates, Sharpe ratios before and after costs, turnover, drawdown and total return."""
    r = F.col("net_return")
    deepest = drawdowns(results, "net_return", [], ["fold_id", "as_of_date"]).agg(F.max("drawdown").alias("max_drawdown"))
    one = results.agg(
        F.countDistinct("fold_id").alias("num_folds"), F.count("*").alias("num_observations"), F.min("entry_date").alias("start_date"), F.max("exit_date").alias("end_date"),
        sharpe(F.col("gross_return")).alias("gross_sharpe"), sharpe(r).alias("net_sharpe"), F.avg("turnover").alias("avg_turnover"), compounded(r).alias("cumulative_net_return"),
    )
    return one.join(F.broadcast(deepest))


def _sector_pnl(results: DataFrame, sectors: DataFrame | None) -> DataFrame:
    rows = results.select(F.explode("held").alias("p")).select("p.*")
    rows = rows if sectors is None else rows.drop("sector").join(sectors.select("symbol", "sector"), "symbol", "left")
    return rows.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum(F.abs(F.col("weight") * F.col("ret"))).alias("pnl"))


def sector_shares(results: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """sector and its share of the sum of |weight * return| over all that was held; null where the sum is 0. sectors: symbol, sector;
    by default those that holdings have."""
    return _sector_pnl(results, sectors).select("sector", F.try_divide("pnl", F.sum("pnl").over(Window.partitionBy())).alias("share"))


def greatest_share(results: DataFrame, sectors: DataFrame | None = None) -> float | None:
    """The greatest of sector_shares()."""
    return _sector_pnl(results, sectors).agg(F.try_divide(F.max("pnl"), F.sum("pnl"))).first()[0]
