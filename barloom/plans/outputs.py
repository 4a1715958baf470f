"""What runs leave behind, as reports: walk-forward results, signals with their hashes, daily reports, trade logs."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans import reports, signals
from barloom.sources import report


def walk(root: str, days: DataFrame, folds: DataFrame, summary: DataFrame, **meta) -> dict[str, dict]:
    """Returns by day, folds and summary, each a report under root; their manifests."""
    return {name: report.published(df, f"{root}/{name}", **meta) for name, df in (("returns", days), ("folds", folds), ("summary", summary))}


def research(root: str, gates: DataFrame, summary: DataFrame, **meta) -> dict[str, dict]:
    """Gates and the summary of a research run."""
    passed = gates.agg(F.coalesce(F.min(F.col("passed").cast("int")), F.lit(0)).alias("all")).first()["all"] == 1
    return {name: report.published(df, f"{root}/{name}", passed=passed, **meta) for name, df in (("gates", gates), ("summary", summary))}


def hashes(weights: DataFrame, settings: signals.Settings) -> dict:
    """SHA-256 of the settings, and of the settings and the model's name, made by Spark."""
    text = json.dumps(asdict(settings), sort_keys=True)
    config = F.sha2(F.lit(text), 256)
    one = weights.sparkSession.range(1).select(config.alias("config_hash"), F.sha2(F.concat(config, F.lit(f"|{signals.MODEL}")), 256).alias("model_version_hash"))
    return one.first().asDict() | {"model_name": signals.MODEL, "config": text}


def day_signals(root: str, weights: DataFrame, checks: DataFrame, settings: signals.Settings, as_of: str) -> dict[str, dict]:
    """A day's signals and the checks that they passed, both with the hashes of settings and model."""
    meta = hashes(weights, settings) | {"as_of": as_of}
    return {name: report.published(df, f"{root}/{name}", **meta) for name, df in (("signals", weights), ("checks", checks))}


def daily(root: str, parts: list[DataFrame], fills: DataFrame, weights: DataFrame, asked: str | None = None) -> dict:
    """The daily report, under the date it speaks of: the one asked for, or the latest with signals before it."""
    latest = weights if asked is None else weights.where(F.col("date") <= F.lit(asked).cast("date"))
    day = latest.agg(F.max("date")).first()[0]
    rows = reports.daily(parts, fills, latest.where(F.col("date") == F.lit(day)))
    return report.published(rows, f"{root}/daily", asked=asked, date=day)


def trade_log(root: str, intents: DataFrame, pre: DataFrame, post: DataFrame, equity: float, peak: float, as_of: str, paused: bool = False) -> dict[str, dict]:
    """Intents, checks before and after, and the state of equity, which further runs add to."""
    peak = max(peak, equity)
    state = intents.sparkSession.createDataFrame([(as_of, float(equity), float(peak), 1 - equity / peak if peak > 0 else 0.0, paused)], "as_of string, equity double, peak double, drawdown double, paused boolean")
    plain = {"intents": intents, "checks": pre.unionByName(post)}
    return {name: report.published(df, f"{root}/{name}", as_of=as_of) for name, df in plain.items()} | {"equity": report.published(state, f"{root}/equity", append=True, as_of=as_of)}
