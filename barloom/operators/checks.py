"""Check suites: data quality of bars, and risk of trades. Each gives rows (suite, check, passed, severity, value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(one: DataFrame, suite: str, rows: list[tuple]) -> DataFrame:
    """The checks (name, passed, severity of a failure, value) of a single row; what passes has severity info, if it states none."""

    def row(name: str, ok: Column, severity: Column | str, value: Column) -> Column:
        ok = F.coalesce(ok, F.lit(False))
        sev = F.when(ok, "info").otherwise(severity) if isinstance(severity, str) else severity
        return F.struct(F.lit(suite).alias("suite"), F.lit(name).alias("check"), ok.alias("passed"), sev.alias("severity"), value.cast("double").alias("value"))

    return one.select(F.inline(F.array(*(row(*r) for r in rows))))


def bad_bar() -> Column:
    """Whether a bar's prices contradict each other; null comparisons don't count."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return F.coalesce(low > F.least(o, c), F.lit(False)) | F.coalesce(h < F.greatest(o, c), F.lit(False)) | F.coalesce(low > h, F.lit(False)) | F.coalesce(c <= 0, F.lit(False)) | F.coalesce(v < 0, F.lit(False))


def quality(bars: DataFrame, members: DataFrame, day: str, least: int, outlier: float = 0.25, jump: float = 0.5, warn: int | None = None, explained: tuple[str, ...] = ()) -> DataFrame:
    """The eight checks of the bars of `day` against what came before: two passes by symbol and a few aggregates.

    Returns of symbols named in `explained` (a split, a merger) are no outliers. Fewer than `least` symbols are critical,
    fewer than `warn` a warning. A day without bars fails ohlc_validity and adjusted_consistency.
    """
    at = F.lit(day).cast("date")
    w = Window.partitionBy("symbol").orderBy("date")
    filled = F.last("adj_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = bars.withColumn("filled", filled).withColumn("ret", F.try_divide("filled", F.lag("filled").over(w)) - 1)
    ratio = F.when((F.col("close") > 0) & (F.col("adj_close") > 0), F.col("adj_close") / F.col("close"))
    df = df.withColumn("ratio", ratio)
    df = df.withColumn("last_ratio", F.last("ratio", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    today, known = F.col("date") == at, F.col("symbol").isin(*explained) if explained else F.lit(False)
    one = df.agg(
        F.max("date").alias("latest"), F.countDistinct(F.when(today, F.col("symbol"))).alias("symbols"), F.count_if(today).alias("rows"), F.count_if(today & bad_bar()).alias("bad"),
        F.count_if(today & (F.abs("ret") > outlier) & ~known).alias("outliers"), F.count_if(today & F.col("ratio").isNotNull()).alias("ratios"), F.count_if(today & (F.abs(F.try_divide("ratio", "last_ratio") - 1) > jump)).alias("jumps"),
    )
    twice = bars.where(today).groupBy("symbol").count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("twice"))
    expected = members.where(today & F.col("active")).select("symbol").distinct()
    missing = expected.join(bars.where(today).select("symbol", F.lit(1).alias("there")).distinct(), "symbol", "left").agg(F.count("*").alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"))
    gap = F.when(F.col("latest") >= at, 0).otherwise(F.size(F.filter(F.sequence(F.col("latest") + 1, F.greatest(at, F.col("latest") + 1)), lambda d: F.weekday(d) < 5)))
    return _quality_rows(one.join(F.broadcast(twice)).join(F.broadcast(missing)).withColumn("gap", gap), at, least, warn)


def _quality_rows(one: DataFrame, at: Column, least: int, warn: int | None) -> DataFrame:
    """The eight checks from a row (latest, symbols, rows, bad, outliers, ratios, jumps, twice, expected, missing, gap)."""
    c = F.col
    return _rows(one, "quality", [
        ("freshness", c("latest") >= at, "critical", F.datediff(at, c("latest"))),
        ("completeness", c("symbols") >= least, F.when(c("symbols") < least, "critical").when(c("symbols") < (warn or least), "warning").otherwise("info"), c("symbols")),
        ("ohlc_validity", (c("rows") > 0) & (c("bad") == 0), F.when((c("rows") == 0) | (c("bad") > 10), "critical").when(c("bad") > 0, "warning").otherwise("info"), c("bad")),
        ("return_outliers", c("outliers") == 0, "warning", c("outliers")),
        ("duplicates", c("twice") == 0, "critical", c("twice")),
        ("gaps", c("missing") <= F.greatest(F.lit(0), c("expected") - least), F.when(c("missing") > F.greatest(F.lit(0), c("expected") - least), "critical").when(c("missing") > 0, "warning").otherwise("info"), c("missing")),
        ("adjusted_consistency", (c("ratios") > 0) & (c("jumps") == 0), F.when(c("ratios") == 0, "critical").when(c("jumps") > 0, "warning").otherwise("info"), c("jumps")),
        ("gap_backfill", c("gap") <= 1, F.when(c("gap") <= 1, "info").when(c("gap") <= 5, "warning").otherwise("critical"), c("gap")),
    ])


CARRIED = "symbol string, latest date, price struct<date: date, value: double>, ratio struct<date: date, value: double>"


def carried(bars: DataFrame, before: str | None = None) -> DataFrame:
    """What later checks need of bars, by symbol: the latest date, and the last price and ratio with their dates (those before
    a day, if given). Of several bars of a date, the greatest value counts."""
    past = F.lit(True) if before is None else F.col("date") < F.lit(before).cast("date")
    ratio = F.when((F.col("close") > 0) & (F.col("adj_close") > 0), F.col("adj_close") / F.col("close"))
    last = lambda value: F.max(F.when(past & value.isNotNull(), F.struct("date", value.alias("value"))))
    return bars.groupBy("symbol").agg(F.max("date").alias("latest"), last(F.col("adj_close")).alias("price"), last(ratio).alias("ratio"))


def folded(*states: DataFrame) -> DataFrame:
    """One state of several: each symbol's latest values, whatever the order in which states are folded."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("symbol").agg(*(F.max(c).alias(c) for c in ("latest", "price", "ratio")))


def quality_of_day(today: DataFrame, state: DataFrame, members: DataFrame, day: str, least: int, outlier: float = 0.25, jump: float = 0.5, warn: int | None = None, explained: tuple[str, ...] = (), session: Callable[[Column], Column] = lambda d: F.weekday(d) < 5) -> DataFrame:
    """The checks of quality(), from the bars of `day` alone and the state carried up to it: no bar before the day is read.

    Equal bars of a symbol are counted, and different ones of one day, which the duplicates check reports, follow each other
    by their values. state.latest may lie beyond the day.
    """
    at = F.lit(day).cast("date")
    own = today.where(F.col("date") == at)
    ratio = F.when((F.col("close") > 0) & (F.col("adj_close") > 0), F.col("adj_close") / F.col("close"))
    bars = own.groupBy("symbol", F.col("adj_close").alias("price"), ratio.alias("ratio"), bad_bar().alias("bad")).agg(F.count("*").alias("n"))
    by = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("price", "ratio", "n"))).alias("bars"), F.sum("n").alias("rows"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"))
    by = by.join(state.select("symbol", "price", F.col("ratio").alias("last")), "symbol", "left")
    known = F.col("symbol").isin(*explained) if explained else F.lit(False)
    away = lambda now, last: F.coalesce(F.abs(F.try_divide(now, last) - 1), F.lit(0.0))
    start = F.struct(F.col("price.value").alias("price"), F.col("last.value").alias("ratio"), F.lit(0).cast("long").alias("outliers"), F.lit(0).cast("long").alias("jumps"), F.lit(0).cast("long").alias("ratios"))

    def step(acc: Column, bar: Column) -> Column:
        price = F.coalesce(bar["price"], acc["price"])
        return F.struct(
            price.alias("price"), F.coalesce(bar["ratio"], acc["ratio"]).alias("ratio"), (acc["outliers"] + (away(price, acc["price"]) > outlier).cast("long")).alias("outliers"),
            (acc["jumps"] + (away(bar["ratio"], acc["ratio"]) > jump).cast("long")).alias("jumps"), (acc["ratios"] + F.when(bar["ratio"].isNotNull(), bar["n"]).otherwise(0)).alias("ratios"),
        )

    by = by.withColumn("run", F.aggregate("bars", start, step))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = by.agg(
        F.count("*").alias("symbols"), zero("rows").alias("rows"), zero("bad").alias("bad"), zero(F.when(~known, F.col("run.outliers"))).alias("outliers"),
        zero("run.ratios").alias("ratios"), zero("run.jumps").alias("jumps"), zero(F.when(F.col("rows") > 1, F.col("rows"))).alias("twice"),
    )
    latest = state.select("latest").unionByName(own.select(F.col("date").alias("latest"))).agg(F.max("latest").alias("latest"))
    expected = members.where((F.col("date") == at) & F.col("active")).select("symbol").distinct()
    missing = expected.join(by.select("symbol", F.lit(1).alias("there")), "symbol", "left").agg(F.count("*").alias("expected"), F.count_if(F.col("there").isNull()).alias("missing"))
    gap = F.when(F.col("latest") >= at, 0).otherwise(F.size(F.filter(F.sequence(F.col("latest") + 1, F.greatest(at, F.col("latest") + 1)), session)))
    return _quality_rows(one.join(F.broadcast(latest)).join(F.broadcast(missing)).withColumn("gap", gap), at, least, warn)


def halting(strict: bool) -> Column:
    """Whether a failed check stops an ingest: any in strict mode; else a stale or incomplete day, or a gap too long to fill."""
    lenient = F.col("check").isin("freshness", "completeness") | ((F.col("check") == "gap_backfill") & (F.col("severity") == "critical"))
    return ~F.col("passed") & (F.lit(True) if strict else lenient)


def passes(checks: DataFrame) -> DataFrame:
    """One row (passed): whether no check failed critically."""
    return checks.agg((F.count_if(~F.col("passed") & (F.col("severity") == "critical")) == 0).alias("passed"))


def notional(c=F.col) -> Column:
    """Size of an intent: its change of value, else its notional, else quantity times price, else 0."""
    return F.coalesce(F.abs(c("delta_value")), F.abs(c("notional")), F.abs(c("qty") * c("price")), F.lit(0.0))


def pre_trade(intents: DataFrame, signals: DataFrame, universe: DataFrame | None, equity: float, buying_power: float, max_turnover: float = 0.4, max_order: float = 12500.0, max_position: float = 0.05, least: int = 5, most: int = 30, latest: str | None = None, as_of: str | None = None, paused: bool = False, trading_day: bool = True) -> DataFrame:
    """The eight checks before a trade, of intents and of signals (symbol, weight).

    The signals' symbols must be in the universe (symbol); a name that is only sold need not be. Without a universe, or
    without both dates, that check passes.
    """
    e, equity = 1e-9, max(equity, 0.0)
    i = intents.withColumn("size", notional()).agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("total"), F.coalesce(F.max("size"), F.lit(0.0)).alias("largest"), F.coalesce(F.sum(F.when(F.lower("side") == "buy", F.col("size"))), F.lit(0.0)).alias("buys"))
    symbols = signals.select(F.upper("symbol").alias("symbol")).distinct()
    out = (symbols if universe is None else symbols.join(universe.select(F.upper("symbol").alias("symbol")), "symbol", "left_anti")).agg((F.lit(0) if universe is None else F.count("*")).alias("outside"))
    t = signals.agg(F.count("*").alias("n"), F.coalesce(F.max(F.coalesce("weight", F.lit(0.0))), F.lit(0.0)).alias("heaviest"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("sum"))
    c, one = F.col, i.join(F.broadcast(out)).join(F.broadcast(t))
    age = F.lit(0) if latest is None or as_of is None else F.datediff(F.lit(as_of).cast("date"), F.lit(latest).cast("date"))
    rows = [
        ("turnover", c("total") <= max_turnover * equity + e, c("total")), ("order_size", c("largest") <= min(max_order, max_position * equity) + e, c("largest")), ("universe", c("outside") == 0, c("outside")),
        ("data_age", age <= 0, age), ("positions", c("n").between(least, most) & (c("heaviest") <= max_position + e) & (c("sum") <= 1 + e), c("n")), ("buying_power", c("buys") <= buying_power + e, c("buys")),
        ("pause_switch", F.lit(not paused), F.lit(int(paused))), ("trading_day", F.lit(trading_day), F.lit(int(trading_day))),
    ]
    return _rows(one, "pre_trade", [(name, ok, "critical", v) for name, ok, v in rows])


def post_trade(fills: DataFrame, targets: DataFrame, actual: DataFrame, cash: float, equity: float, max_slip_bps: float = 100.0, max_gap: float = 0.01, min_cash: float = 0.02) -> DataFrame:
    """Fill status (symbol, status, expected, filled), slippage, weights against targets, and cash."""
    e = 1e-9
    f = fills.agg(F.count_if(F.lower("status").isin("rejected", "canceled", "expired", "suspended")).alias("failed"), F.coalesce(F.max(F.abs(F.try_divide("filled", "expected") - 1) * 1e4), F.lit(0.0)).alias("slip"))
    both = targets.select("symbol", F.col("weight").alias("t")).join(actual.select("symbol", F.col("weight").alias("a")), "symbol", "full").fillna(0.0, ["t", "a"])
    g = both.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("t"))), F.lit(0.0)).alias("gap"))
    c, one = F.col, f.join(F.broadcast(g))
    rows = [("fills", c("failed") == 0, c("failed")), ("slippage", c("slip") <= max_slip_bps + e, c("slip")), ("reconciliation", c("gap") <= max_gap + e, c("gap")), ("cash", F.lit(cash >= min_cash * equity - e), F.lit(cash))]
    return _rows(one, "post_trade", [(name, ok, "critical", v) for name, ok, v in rows])
