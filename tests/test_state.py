import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.plans import backfill, expressions
from barloom.sources import files, panel, settings, vendor, warehouse


def test_scan_of_blocks_equals_the_recursive_mean(spark):
    rng, rows = random.Random(3), []
    for s in "ABC":
        day = dt.date(2015, 1, 1)
        for k in range(900):
            day += dt.timedelta(rng.choice([1, 1, 3, 200 if k == 400 else 1]))
            gone = rng.random() < 0.2 or (s == "B" and k < 40) or (s == "C" and 300 < k < 700)
            rows.append((day, s, None if gone else rng.uniform(-5, 50), k))
    rows += [(dt.date(2015, 1, d), "D", None, d) for d in range(1, 9)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, barloom_block int")
    out = expressions.smoothed(df, "x", "y", 2 / 11)
    assert out.columns == [*df.columns, "y"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas().sort_values(["symbol", "date"])
    want = df.toPandas().sort_values(["symbol", "date"]).groupby("symbol")["x"].transform(lambda x: x.ewm(span=10, adjust=False).mean())
    np.testing.assert_allclose(got["y"].to_numpy(float), want.to_numpy(float), rtol=1e-12)
    assert expressions.smoothed(df.limit(0), "x", "y", 0.5).count() == 0
    plan = expressions.evaluated(panel.bars(spark, "/root/testdata/sf0.001"), "EMA($close, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def answers(*symbols):
    return {s: json.dumps([{"date": f"2024-01-0{d}", "close": d, "adjusted_close": d, "volume": 1} for d in (2, 3)]) for s in symbols}


def test_a_killed_run_asks_only_for_the_rest(spark, tmp_path):
    root, calls = str(tmp_path / "b"), []
    keys = [f"S{i:02}" for i in range(40)]
    wanted = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")

    def source(name, known, fail_at=None, errors=()):
        def ask(asked):
            own = sorted(r["key"] for r in asked.collect())
            calls.append((name, own))
            if fail_at is not None and len(calls) == fail_at:
                raise ConnectionError
            rows = [(k, known.get(k, "[]"), None) if k not in errors else (k, None, "busy") for k in own]
            return spark.createDataFrame(rows, "key string, body string, error string")

        return ask

    one, two = answers(*keys[:30]), answers(*keys[20:38])
    with pytest.raises(ConnectionError):
        backfill.fetched(root, wanted, [source("one", one, 3), source("two", two)], 10)
    done = {k for _, asked in calls[:2] for k in asked}
    assert len(calls) == 3 and done == {r["key"] for r in backfill.landed(spark, root).collect()}
    calls.clear()
    got = {r["key"]: r["source"] for r in backfill.fetched(root, wanted, [source("one", one, errors=("S39",)), source("two", two)], 10).collect()}
    again = [k for name, asked in calls if name == "one" for k in asked]
    assert sorted(again) == sorted(set(keys) - done) and len(again) == len(set(again))
    assert sorted(k for name, asked in calls if name == "two" for k in asked) == keys[30:]
    assert got == {**dict.fromkeys(keys[:30], 0), **dict.fromkeys(keys[30:38], 1)}
    calls.clear()
    backfill.fetched(root, wanted, [source("one", one), source("two", two)], 10)
    assert calls == [("one", ["S39"])]  # what failed before; all else has landed, be it empty
    bars = backfill.bars(backfill.fetched(root, wanted, [], 10))
    said = backfill.summary(wanted.where("key is not null"), bars).first()
    assert (said["symbols_requested"], said["symbols_with_data"], said["rows"], said["symbols_without_data_sample"]) == (40, 38, 76, ["S38", "S39"])


def test_one_file_of_a_thousand_is_read(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for i in range(1000):
        (folder / f"trade_once_{i:04}.json").write_text(json.dumps({"n": i}))
    (folder / "zz_other.json").write_text("{}")
    found = files.listed(spark, str(folder), "trade_once_*.json")
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split("\n")[0] and found.count() == 1000
    rows = files.latest_json(spark, str(folder), "trade_once_*.json", "n long")
    assert [r["n"] for r in rows.collect()] == [999] and len(rows.inputFiles()) == 1
    (folder / "trade_once_1000.json").write_text("no json")
    assert files.latest_json(spark, str(folder), "trade_once_*.json", "n long").count() == 0
    (folder / "trade_once_0500.json").touch()
    assert files.latest(spark, str(folder), "trade_once_*.json", by="name").endswith("trade_once_1000.json")
    assert files.latest(spark, str(folder), "none*") is None and files.latest(spark, str(tmp_path / "gone")) is None
    assert files.latest_json(spark, str(tmp_path / "gone"), "*", "n long").count() == 0


def test_settings_of_any_shape(spark):
    texts = [None, "", "{", "[]", "3", "{}", '{"portfolio": 5, "signals": {"topk": 7}}', '{"portfolio": {"top_k": "x"}, "signals": {"topk": 8}}', '{"risk": {"max_turnover_daily": 0.5}}']
    got = settings.signal_settings(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id").collect()
    assert [r["valid"] for r in got] == [False] * 5 + [True] * 4
    assert [r["top_k"] for r in got] == [30] * 6 + [7, 8, 30] and got[8]["max_turnover"] == 0.5 and got[0]["long_only"] is True
    rows = spark.createDataFrame([("crsp", False, True), ("EODHD ", True, False), (None, True, True), ("auto", True, False), ("auto", False, True), ("x", False, False)], "a string, w boolean, v boolean")
    picked = [tuple(r[0]) for r in rows.select(settings.chosen_source(F.col("a"), F.col("w"), F.col("v"))).collect()]
    assert [p[:2] for p in picked] == [(None, None), (None, None), ("crsp", "eodhd"), ("crsp", None), ("eodhd", None), (None, None)]
    assert [p[2] is None for p in picked] == [False, False, True, True, True, False]


def test_tables_are_scanned_under_their_schema(spark, tmp_path):
    rows = pd.DataFrame({"date": ["2024-01-02", "bad"], "symbol": ["a", "b"], "close": [1.5, 2.0]})
    rows.to_csv(tmp_path / "x.csv", index=False)
    schema = "date string, symbol string, close string"
    got = panel.scan(spark, str(tmp_path / "x.csv"), spark.createDataFrame([], schema).schema)
    assert [tuple(r)[:2] for r in panel.conform(got, panel.BARS).select("symbol", "close").collect()] == [("A", 1.5)]
    got.write.parquet(str(tmp_path / "y.parquet"))
    assert panel.scan(spark, str(tmp_path / "y.parquet"), got.schema).count() == 2
    assert panel.scan(spark, str(tmp_path / "none.parquet"), got.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        panel.scan(spark, str(tmp_path / "none.parquet"), got.schema, required=True)


def test_warehouse_tables_over_jdbc(spark):
    url = "jdbc:derby:memory:barloom;create=true"
    link = spark._jvm.java.sql.DriverManager.getConnection(url)
    done = link.createStatement()
    done.execute("create table daily (permno bigint, price double)")
    done.execute("insert into daily values " + ", ".join(f"({i}, {i / 2})" for i in range(100)))
    link.close()
    whole = warehouse.table(spark, url, "daily")
    parts = warehouse.table(spark, url, "daily", "PERMNO", (0, 100), 4)
    assert whole.count() == parts.count() == 100 and parts.rdd.getNumPartitions() == 4
    assert parts.where("PERMNO in (3, 5)").agg(F.sum("PRICE")).first()[0] == 4.0
    names = spark.createDataFrame([("crsp", "dsf", "PERMNO"), ("crsp", "dsf", "prc"), ("crsp", "other", "x"), ("crsp", "sp500_list", "permno")], "library string, table string, column string")
    assert warehouse.found(names, warehouse.DAILY) == ("crsp", "dsf", {"permno", "prc"})
    assert warehouse.found(names, [("a", "b")], like="sp500.*list")[1] == "sp500_list" and warehouse.found(names, [("a", "b")]) is None


def test_symbols_as_vendors_list_them(spark):
    rows = spark.createDataFrame([(" aapl",), ("brk.b",), (None,)], "s string")
    assert [r[0] for r in rows.select(vendor.listing(F.col("s"))).collect()] == ["AAPL.US", "BRK.B", None]


def test_names_written_as_missing(spark):
    rows = spark.createDataFrame([("nan",), (" none ",), (None,), ("",), (" abc ",)], "t string")
    assert [r[0] for r in rows.select(warehouse.symbol_or(F.col("t"), F.lit("x"))).collect()] == ["X", "X", "X", "X", "ABC"]
