"""python -m barloom JOB --root WORKSPACE ...: runs a job of barloom.plans.jobs and prints its summary as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom.plans import jobs, signals, walk_forward
from barloom.sources import settings, vendor
from barloom.sources.session import ship_package


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom", description=__doc__)
    p.add_argument("--root", required=True, help="workspace: a folder that driver and executors share")
    sub = p.add_subparsers(dest="job", required=True)

    def job(name: str, *options: tuple[str, dict]):
        own = sub.add_parser(name)
        for option, kind in options:
            own.add_argument(option, **kind)

    span = (("--start-date", {"default": "2000-01-03"}), ("--end-date", {"required": True}), ("--calendar", {"choices": list(jobs.CALENDARS), "default": "exchange"}))
    config = ("--config", {"help": "JSON file with the settings of signals"})
    least = ("--least", {"type": int, "default": 480, "help": "least symbols of a day"})
    job("membership", ("--constituents", {"required": True, "help": "Parquet table of intervals"}), ("--mapping", {}), *span)
    job("membership-approx", ("--snapshot", {"required": True, "help": "Parquet or CSV list of constituents"}), *span)
    job("backfill", ("--url", {"required": True, "help": "address with {key}"}), ("--batch", {"type": int, "default": 500}), ("--max-symbols", {"type": int, "default": 0}))
    job("ingest", ("--date", {"required": True}), ("--bars", {"required": True, "help": "table of the day's bars"}), ("--mode", {"choices": ["strict", "lenient"], "default": "strict"}), ("--calendar", {"choices": list(jobs.CALENDARS), "default": "weekday"}), least)
    job("coverage")
    job("signals", ("--as-of", {}), ("--history-window-days", {"type": int}), config, least)
    job("research", ("--benchmark", {"required": True}), ("--n-trials", {"type": int, "default": 500}), config)
    job("trade", ("--as-of", {"required": True}), ("--positions", {"required": True}), ("--equity", {"type": float, "required": True}), ("--buying-power", {"type": float, "required": True}), ("--min-trade", {"type": float, "default": 25.0}))
    job("halt", ("--level", {"type": int, "choices": [1, 2, 3], "required": True}), ("--reason", {"default": "by hand"}))
    job("monitor", ("--equity", {"type": float, "required": True}), ("--max-drawdown", {"type": float, "default": 0.10}), ("--max-loss", {"type": float, "default": 0.03}), ("--grace-days", {"type": int, "default": 5}))
    job("report", ("--report-date", {}))
    return p


def _table(spark: SparkSession, path: str):
    return spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.parquet(path)


def _signal_settings(spark: SparkSession, path: str | None, **own) -> signals.Settings:
    text = "{}" if path is None else spark.read.text(path, wholetext=True).first()[0]
    row = settings.signal_settings(spark.createDataFrame([("", text)], "name string, body string"), "name", "body").first().asDict()
    return jobs.as_settings(row | {k: v for k, v in own.items() if v is not None})


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    ws = jobs.Workspace(spark, a.root.rstrip("/"))
    if a.job == "membership":
        return jobs.build_membership(ws, _table(spark, a.constituents), a.start_date, a.end_date, a.mapping and _table(spark, a.mapping), a.calendar)
    if a.job == "membership-approx":
        return jobs.build_membership_approx(ws, _table(spark, a.snapshot), F.monotonically_increasing_id(), a.start_date, a.end_date, a.calendar)
    if a.job == "backfill":
        spark.dataSource.register(vendor.HttpJson)

        def source(keys):
            listed = ",".join(r["key"] for r in keys.collect())  # a batch of keys
            return spark.read.format("http_json").option("url", a.url).option("keys", listed).load()

        return jobs.backfill_history(ws, [source], a.batch, a.max_symbols)
    if a.job == "ingest":
        from barloom.sources import panel

        return jobs.ingest_day(ws, a.date, panel.conform(_table(spark, a.bars), panel.BARS), mode=a.mode, calendar=a.calendar, least=a.least)
    if a.job == "coverage":
        return jobs.coverage(ws)
    if a.job == "signals":
        return jobs.generate_signals(ws, a.as_of, _signal_settings(spark, a.config, history_days=a.history_window_days), a.least)
    if a.job == "research":
        return jobs.research(ws, walk_forward.Settings(), _signal_settings(spark, a.config), a.benchmark, a.n_trials)
    if a.job == "trade":
        return jobs.trade_once(ws, a.as_of, _table(spark, a.positions), a.equity, a.buying_power, a.min_trade)
    if a.job == "halt":
        return jobs.halt(ws, a.level, a.reason)
    if a.job == "monitor":
        return jobs.monitor(ws, a.equity, a.max_drawdown, a.max_loss, a.grace_days)
    return jobs.daily_report(ws, a.report_date)


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    print(json.dumps(run(spark, a), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
