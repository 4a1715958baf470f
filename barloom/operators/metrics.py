"""Return statistics; rows are ordered by the given columns, within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252

#: Parts of a run whose Sharpe ratios are judged one by one.
BINS = 8


def sharpe(r: Column) -> Column:
    """Annual Sharpe ratio; 0 without deviation, null for a single value, 0 without values."""
    sd = F.stddev_samp(r)
    return F.when(F.count(r) == 0, 0.0).when(sd <= 0, 0.0).otherwise(F.try_divide(F.avg(r), sd) * F.sqrt(F.lit(float(DAYS))))


def deflated(ratio: Column, trials: int, n: Column) -> Column:
    """Sharpe ratio less what the best of many trials has by chance over n days."""
    return ratio - F.sqrt(2 * F.log(F.lit(float(max(trials, 1))))) / F.sqrt(F.greatest(n / DAYS, F.lit(1e-9)))


def compounded(r: Column) -> Column:
    return F.product(1 + F.coalesce(r, F.lit(0.0))) - 1


def drawdowns(df: DataFrame, r: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with equity, its running peak (which starts at the first equity) and drawdown."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.coalesce(r, F.lit(0.0))).over(w))
    return df.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", 1 - F.try_divide("equity", "peak"))


def bins(df: DataFrame, keys: list[str], order: list[str], n: int = BINS) -> DataFrame:
    """df with bin: its rows in order, cut at equal quantiles of their positions into at most n bins."""
    w = Window.partitionBy(*keys)
    p, count = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    q = F.least(F.lit(n), count)
    return df.withColumn("bin", F.when(count > 1, F.greatest(F.ceil(p * q / F.nullif(count - 1, F.lit(0))) - 1, F.lit(0))).otherwise(0).cast("long"))


def gates(returns: DataFrame, trials: int, overlap: float, sector_share: float | None, order: list[str]) -> DataFrame:
    """Research gates over returns (net_return, turnover, baseline_*): a row (gate, passed, metric) for each. A missing sector_share fails.

    Days, which are few, are put in order once; all figures come from one aggregation of them.
    """
    base = [c for c in returns.columns if c.startswith("baseline_")]
    days = drawdowns(bins(returns, [], order, BINS), "net_return", [], order)
    good = sum((F.coalesce((sharpe(F.when(F.col("bin") == k, F.col("net_return"))) > 0).cast("double"), F.lit(0.0)) for k in range(BINS)), F.lit(0.0))
    one = days.agg(sharpe(F.col("net_return")).alias("net"), F.count("*").alias("n"), F.avg("turnover").alias("turnover"), good.alias("good"), F.max("drawdown").alias("worst"), *(sharpe(F.col(c)).alias(c) for c in base))
    beaten = F.greatest(*(F.coalesce(F.col(c), F.lit(float("-inf"))) for c in [*base, base[0]])) if base else F.lit(float("-inf"))
    dsr = deflated(F.col("net"), trials, F.col("n"))
    rows = [
        ("deflated_sharpe", dsr > 0.5, dsr), ("subperiods", F.col("good") >= 6, F.col("good")), ("sector_share", F.lit(sector_share is not None and sector_share <= 0.4), F.lit(sector_share)),
        ("drawdown", F.col("worst") < 0.25, F.col("worst")), ("turnover", F.col("turnover") < 0.30, F.col("turnover")), ("factor_overlap", F.lit(overlap >= 0.5), F.lit(overlap)),
        ("baselines", F.col("net") > beaten, F.col("net") - beaten), ("net_sharpe", F.col("net") > 0.4, F.col("net")),
    ]
    each = F.array(*(F.struct(F.lit(name).alias("gate"), F.coalesce((F.col("n") > 0) & ok, F.lit(False)).alias("passed"), m.cast("double").alias("metric")) for name, ok, m in rows))
    return one.select(F.inline(each))


def monitored(log: DataFrame, key: str, at: str | Column, equity: str, max_drawdown: float = 0.10, max_loss: float = 0.03, least_days: int = 5) -> DataFrame:
    """Halt level of each entry of an equity log: 2 for a deep drawdown after least_days entries, 1 for a large loss, else 0."""
    w = Window.partitionBy(key).orderBy(at)
    peak = F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))
    log = log.withColumns({"drawdown": 1 - F.try_divide(F.col(equity), peak), "loss": 1 - F.try_divide(F.col(equity), F.lag(equity).over(w)), "seen": F.row_number().over(w)})
    return log.withColumn("level", F.when((F.col("drawdown") > max_drawdown) & (F.col("seen") > least_days), 2).when(F.col("loss") > max_loss, 1).otherwise(0))
