"""The daily report: signals, checks, fills and what needs attention, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(rows: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(F.array_sort(rows), 1, n), lambda r: r["symbol"]), ",")


def signal_summary(weights: DataFrame, n: int = 5) -> DataFrame:
    """date, positions, weights_sum, and the n heaviest and lightest names of the latest date; ties go by symbol."""
    last = weights.agg(F.max("date").alias("date"))
    listed = lambda sign: F.collect_list(F.struct((sign * F.col("weight")).alias("w"), F.col("symbol")))
    by = weights.join(F.broadcast(last), "date").groupBy("date").agg(F.count("*").alias("positions"), F.sum("weight").alias("weights_sum"), listed(-1).alias("down"), listed(1).alias("up"))
    return by.select("date", "positions", "weights_sum", _names(F.col("down"), n).alias(f"top_{n}"), _names(F.col("up"), n).alias(f"bottom_{n}"))


def fill_counts(fills: DataFrame) -> DataFrame:
    """Number of orders by status; a missing status counts as unknown."""
    return fills.groupBy(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status")).count()


def daily(checks: list[DataFrame], fills: DataFrame, weights: DataFrame) -> DataFrame:
    """section, item, passed and value of every check, of the fills by status and of the signals; failed suites as exceptions."""
    every = reduce(DataFrame.unionByName, checks)
    row = lambda df, section, item, passed, value: df.select(F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"), item.alias("item"), passed.alias("passed"), value.cast("double").alias("value"))
    none = F.lit(None).cast("boolean")
    signals = signal_summary(weights)
    failed = every.groupBy("suite").agg(F.count_if(~F.col("passed")).alias("n")).where("n > 0")
    parts = [
        row(every, F.col("suite"), F.col("check"), F.col("passed"), F.col("value")), row(fill_counts(fills), "fills", F.col("status"), none, F.col("count")),
        row(signals, "signals", F.lit("positions"), none, F.col("positions")), row(signals, "signals", F.lit("weights_sum"), none, F.col("weights_sum")),
        row(failed, "exceptions", F.col("suite"), F.lit(False), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
