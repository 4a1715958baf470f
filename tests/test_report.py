import json
import pathlib

import pytest
from pyspark.sql import functions as F

from barloom.plans import outputs, signals
from barloom.sources import report


def left(path):
    return sorted(p.name for p in pathlib.Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_rows_and_manifest_come_into_sight_together(spark, tmp_path):
    path = f"{tmp_path}/r"
    df = spark.createDataFrame([(i, f"s{i}", None if i % 2 else i / 4) for i in range(50)], "a long, b string, c double").withColumn("d", F.lit("2024-01-02").cast("date")).repartition(4)
    said = report.published(df, path, run="one")
    assert said["rows"] == 50 and said["meta"]["run"] == "one" and said["meta"]["content_sha256"] == report.table_digest(df).first()["sha256"]
    assert sorted(map(tuple, report.read(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert report.table_digest(report.read(spark, path)).first()["sha256"] == said["meta"]["content_sha256"]
    again = report.published(df.where("a < 5"), path, append=True)
    assert again["rows"] == 55 and report.read(spark, path).count() == 55
    assert report.published(df.limit(0), path)["files"] == [] and report.read(spark, path).count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/r"
    report.published(spark.range(10), path)
    before, rows = left(path), [r[0] for r in report.read(spark, path).collect()]
    spark.dataSource.register(report.Report)
    bad = spark.range(1000).repartition(4).withColumn("x", F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("report").mode("overwrite").option("path", path).save()
    assert left(path) == before and [r[0] for r in report.read(spark, path).collect()] == rows
    with pytest.raises(FileNotFoundError):
        report.read(spark, f"{tmp_path}/none")


def test_digest_tells_tables_apart_but_not_orders(spark):
    of = lambda rows: report.table_digest(spark.createDataFrame(rows, "a string, b string")).first()["sha256"]
    rows = [("x", "y"), ("x", None), ("", "xy")]
    assert of(rows) == of(rows[::-1]) != of([*rows, rows[0]]) != of([*rows, rows[1]])
    assert len({of([r]) for r in [("x", "y"), ("xy", ""), ("", "xy"), ("y", "x")]}) == 4


def test_runs_are_written_and_read_back(spark, tmp_path):
    days = spark.createDataFrame([(f, i, 0.001 * i) for f in (0, 1) for i in range(5)], "fold_id int, day int, net_return double")
    folds = days.groupBy("fold_id").agg(F.count("*").alias("n"))
    said = outputs.walk(f"{tmp_path}/walk", days, folds, folds.limit(1), run=7)
    assert {k: v["rows"] for k, v in said.items()} == {"returns": 10, "folds": 2, "summary": 1} and said["folds"]["meta"]["run"] == 7
    checks = spark.createDataFrame([("quality", "freshness", True, "info", 0.0)], "suite string, check string, passed boolean, severity string, value double")
    weights = spark.createDataFrame([("2024-01-02", "A", 0.5), ("2024-01-03", "B", 0.25)], "date string, symbol string, weight double").withColumn("date", F.to_date("date"))
    made = outputs.day_signals(f"{tmp_path}/signals", weights, checks, signals.Settings(), "2024-01-03")
    assert made["signals"]["meta"]["config_hash"] == signals.metadata("2024-01-03", signals.Settings(), "", checks)["config_hash"]
    assert made["signals"]["meta"]["model_version_hash"] == signals.metadata("2024-01-03", signals.Settings(), "", checks)["model_version_hash"]
    assert report.read(spark, f"{tmp_path}/signals/signals").count() == 2
    fills = spark.createDataFrame([("filled",), (None,)], "status string")
    for asked, day, total in ((None, "2024-01-03", 0.25), ("2024-01-02", "2024-01-02", 0.5), ("2030-01-01", "2024-01-03", 0.25)):
        daily = outputs.daily(f"{tmp_path}/daily", [checks], fills, weights, asked)
        assert daily["meta"]["date"] == day
        assert {r["item"]: r["value"] for r in report.read(spark, f"{tmp_path}/daily/daily").collect()}["weights_sum"] == total
    intents = spark.createDataFrame([("A", "buy", 10.0)], "symbol string, side string, notional double")
    for equity in (100.0, 80.0):
        outputs.trade_log(f"{tmp_path}/log", intents, checks, checks, equity, 100.0, "2024-01-03")
    assert sorted(r["drawdown"] for r in report.read(spark, f"{tmp_path}/log/equity").collect()) == pytest.approx([0.0, 0.2])
    gates = outputs.research(f"{tmp_path}/gates", checks.select("check", "passed"), folds)
    assert gates["gates"]["meta"]["passed"] is True and json.dumps(gates)
