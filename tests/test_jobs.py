import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from barloom import __main__ as cli
from barloom.plans import ingest, jobs, signals
from barloom.sources import panel, report

DAYS = [d for d in (dt.date(2023, 1, 2) + dt.timedelta(i) for i in range(120)) if d.weekday() < 5]
SYMBOLS = [f"S{i}" for i in range(12)]


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    rng, rows = random.Random(1), []
    for s in SYMBOLS:
        price = 50.0
        for d in DAYS:
            price *= 1 + rng.uniform(-0.02, 0.02)
            rows.append((d, s, price, price * 1.01, price * 0.99, price, price, 1000.0, price * 1000))
    path = str(tmp_path_factory.mktemp("jobs") / "history")
    spark.createDataFrame(rows, panel.BARS).write.parquet(path)
    return spark.read.parquet(path)


def test_a_workspace_from_membership_to_report(spark, history, tmp_path, capsys):
    ws = jobs.Workspace(spark, str(tmp_path / "ws"))
    call = lambda *args: (cli.main(["--root", ws.root, *args]), json.loads(capsys.readouterr().out))[1]
    start, last = str(DAYS[0]), str(DAYS[-1])
    intervals = spark.createDataFrame([(s.lower(), None, None, f"sec{i % 3}", i) for i, s in enumerate(SYMBOLS)], "code string, start_date date, end_date date, sector string, permno long")
    intervals.write.parquet(str(tmp_path / "c"))
    with pytest.raises(ingest.Halted):
        jobs.build_membership(ws, intervals.limit(0), start, last)
    made = call("membership", "--constituents", str(tmp_path / "c"), "--start-date", start, "--end-date", last, "--calendar", "weekday")
    assert (made["unique_symbols"], made["min_members"], made["max_members"], made["membership_rows"]) == (12, 12, 12, 12 * len(DAYS))
    assert jobs.member_summary(ws.members(), start, str(DAYS[4]))["membership_rows"] == 60

    body = F.to_json(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "open", "high", "low", "close", F.col("adj_close").alias("adjusted_close"), "volume")))
    known = history.where(F.col("date") < F.lit(DAYS[-1])).groupBy(F.col("symbol").alias("key")).agg(body.alias("body")).withColumn("error", F.lit(None).cast("string"))
    done = jobs.backfill_history(ws, [lambda keys: known.join(keys, "key", "left_semi")], 5)
    assert (done["symbols_with_data"], done["rows"]) == (12, 12 * (len(DAYS) - 1))

    history.where(F.col("date") == F.lit(DAYS[-1])).write.parquet(str(tmp_path / "new"))
    done = call("ingest", "--date", last, "--bars", str(tmp_path / "new"), "--least", "10")
    assert done["new_rows"] == 12 and done["total_rows"] == 12 * len(DAYS) and report.manifest(ws.out("ingest"))["meta"]["new_rows"] == 12
    assert call("coverage")["rows"] == len(DAYS)

    (tmp_path / "config.json").write_text(json.dumps({"portfolio": {"top_k": 6, "max_weight_per_name": 0.2, "min_avg_daily_volume_usd": 1}}))
    said = call("signals", "--config", str(tmp_path / "config.json"), "--least", "10")
    weights = report.read(spark, f"{ws.out('signals')}/signals").collect()
    assert said["as_of"] == last and said["positions"] == len(weights) == 6 and abs(sum(r["weight"] for r in weights) - 1) < 1e-9
    with pytest.raises(ingest.Halted, match="completeness"):
        jobs.generate_signals(ws, last, signals.Settings(), least=100)

    spark.createDataFrame([("S0", 100.0, 2.0, 50.0)], "symbol string, market_value double, qty double, current_price double").write.parquet(str(tmp_path / "p"))
    trade = ("trade", "--as-of", last, "--positions", str(tmp_path / "p"), "--equity", "10000", "--buying-power", "20000")
    first = call(*trade)
    assert first["intents"] >= 6 and "pause_switch" not in first["failed"] and "trading_day" not in first["failed"]
    call("halt", "--level", "1", "--reason", "test")
    assert "pause_switch" in call(*trade)["failed"]
    jobs.release(ws, "pause")
    assert "pause_switch" not in call(*trade)["failed"]
    daily = call("report", "--report-date", "2030-01-01")
    assert daily["meta"]["date"] == last
    daily = call("report", "--report-date", last)
    assert {r["section"] for r in report.read(spark, f"{ws.out('daily')}").collect()} >= {"quality", "pre_trade", "signals", "fills"}


def test_monitor_halts_as_its_thresholds_say(spark, tmp_path):
    ws = jobs.Workspace(spark, str(tmp_path))
    got = [jobs.monitor(ws, e)["trigger"] for e in (100.0, 99.0, 95.0, 94.0, 93.0, 92.0, 89.5)]
    assert got == [None, None, "daily_loss", None, None, None, "drawdown"]
    assert ws.flagged("pause") and ws.flagged("close") and not ws.flagged("lockout")
    assert report.read(spark, ws.out("equity")).count() == 7
    with pytest.raises(ValueError):
        jobs.monitor(ws, 0.0)


def test_latest_signals_coerce(spark):
    rows = spark.createDataFrame([("2024-01-02", "a", "0.5"), ("2024-01-03", "b", "x"), ("2024-01-03", "c", "0.25"), ("2024-01-03", "d", "-1"), ("bad", "e", "1"), ("2024-01-03", "f", None)], "date string, symbol string, weight string")
    assert [(r["symbol"], r["weight"]) for r in jobs.latest_signals(rows).collect()] == [("C", 0.25)]
    assert sorted(r["symbol"] for r in jobs.latest_signals(rows.drop("date")).collect()) == ["A", "C", "E"]


def test_orchestrator_runs_the_stages_of_a_mode(spark, tmp_path):
    ws, did = jobs.Workspace(spark, str(tmp_path)), []
    steps = {n: (lambda n=n: did.append(n)) for n in ("ingest", "signals", "factor_mining", "research", "trade", "report")}
    jobs.orchestrate(ws, "research", "2024-01-02", steps, f"{tmp_path}/1", mining=True)
    jobs.orchestrate(ws, "paper", "2024-01-02", steps | {"trade": lambda: 1 / 0}, f"{tmp_path}/2")
    said = jobs.orchestrate(ws, "paper", "2024-01-02", steps, f"{tmp_path}/3", resume=f"{tmp_path}/2")
    assert did == ["ingest", "signals", "factor_mining", "research", "report", "ingest", "signals", "trade", "report"]
    assert [s["status"] for s in said] == ["skipped_resume", "skipped_resume", "success", "success"]
    with pytest.raises(ValueError, match="no step"):
        jobs.orchestrate(ws, "live", "2024-01-02", {}, f"{tmp_path}/4")
