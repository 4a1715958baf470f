import datetime as dt
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import checks
from barloom.plans import chain, expressions, ingest, mining, signals
from barloom.sources import html, panel, vendor, warehouse
from barloom.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["signal_summary", "fill_counts", "vendor_history", "mined_expressions", "live_upsert", "live_monitor", "warehouse_history", "warehouse_constituents", "html_tables", "members_list", "asof_after", "ingest_gated", "daily_report"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda x: sorted(str([None if pd.isna(v) else round(v, 8) if isinstance(v, float) else str(v) for v in r]) for r in x[sorted(x.columns)].itertuples(index=False))
    assert len(got) and text(got) == text(want)


def test_daily_report(spark):
    rows = entry.queries()["daily_report"](spark, DATA).collect()
    assert {"quality", "pre_trade", "post_trade", "fills", "signals"} <= {r["section"] for r in rows}
    assert {r["item"] for r in rows if r["section"] == "exceptions"} == {r["section"] for r in rows if r["passed"] is False and r["section"] != "exceptions"}


def test_streams_keep_state_over_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4), 7, "a", v) for i, v in enumerate([0.0, 50.0, -40.0, 1.0, 1.0, 1.0, -150.0, None])]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    events = live.stream(spark, str(tmp_path), "events", files_per_batch=1)
    whole = spark.createDataFrame(rows, schema).toPandas()
    got = {r["event_id"]: r["level"] for r in live.run_to_end(live.monitor_stream(events), "append").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 2, 7: 2}
    bars = {str(r["date"]): (r["high"], r["low"], r["n"]) for r in live.latest(live.run_to_end(live.live_bars(events)), ["date", "symbol"]).collect()}
    assert bars == {"2024-01-01": (50.0, -40.0, 4), "2024-01-02": (1.0, -150.0, 4)} and len(whole) == 8
    once = live.run_to_end(live.unrepeated(events.unionByName(events)), "append")
    assert once.count() == 8


@pytest.mark.parametrize("name", ["live_upsert", "live_monitor"])
def test_many_files_in_any_order(spark, tmp_path, name):
    rng, rows = random.Random(2), []
    for i in rng.sample(range(600), 600):
        rows.append((i, dt.datetime(2024, 1, 1 + rng.randrange(30), rng.randrange(24)), rng.randrange(3), rng.choice("ab"), round(rng.uniform(-90, 90), 2)))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    text = lambda x: sorted(str([round(v, 8) if isinstance(v, float) else str(v) for v in r]) for r in x[sorted(x.columns)].itertuples(index=False))
    assert len(got) and text(got) == text(want)


class Answers(BaseHTTPRequestHandler):
    busy = 2

    def do_GET(self):  # noqa: N802
        if self.path.endswith("GONE"):
            self.send_response(404)
            self.end_headers()
            return
        if type(self).busy:
            type(self).busy -= 1
            self.send_response(503)
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps([{"date": "2024-01-02", "open": 1, "close": "2.5", "adjusted_close": 2, "volume": 10}, {"date": "bad", "close": 1}]).encode())

    def log_message(self, *_):
        pass


def test_http_source_retries_and_reports_errors(spark):
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(vendor.HttpJson)
    raw = spark.read.format("http_json").option("url", f"http://127.0.0.1:{server.server_port}/{{key}}").option("keys", "aapl,GONE").option("tasks", "2").load().persist()
    assert {r["key"]: (r["body"] is None, r["error"] is None) for r in raw.collect()} == {"aapl": (False, True), "GONE": (True, False)}
    bars = vendor.history(raw).collect()
    assert [(r["symbol"], str(r["date"]), r["close"], r["adj_close"], r["dollar_volume"]) for r in bars] == [("AAPL", "2024-01-02", 2.5, 2.0, 25.0)]
    server.shutdown()


def test_pace_and_failover(spark):
    now, slept = [0.0], []
    pace = vendor.Pace(2, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(5):
        pace.wait()
    assert slept == [60.0, 60.0]
    good, empty = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int")

    def broken():
        raise OSError("down")

    assert vendor.first_filled([broken, lambda: empty, lambda: good]).count() == 1
    assert vendor.first_filled([broken, lambda: empty]).count() == 0
    with pytest.raises(OSError):
        vendor.first_filled([broken])


def test_other_answers(spark):
    of = lambda key, x: spark.createDataFrame([(key, json.dumps(x)), ("none", None), ("broken", "{")], "key string, body string")
    day = {"code": "msft", "date": "2024-01-02", "close": "3", "adjusted_close": 3, "volume": 2}
    assert [(r["symbol"], r["dollar_volume"]) for r in vendor.bulk_day(of("US", [day])).collect()] == [("MSFT", 6.0)]
    assert [tuple(r) for r in vendor.splits(of("a", [{"date": "2024-01-02", "split": "2/1"}])).collect()] == [("A", dt.date(2024, 1, 2), "2/1")]
    assert [r["value"] for r in vendor.dividends(of("a", [{"date": "2024-01-02", "value": "0.5"}, {"date": "x", "value": "1"}])).collect()] == [0.5]
    assert [r["symbol"] for r in vendor.listed_symbols(of("US", [{"Code": "x", "Name": "X"}, {"Name": "Y"}])).collect()] == ["X"]
    one = {"Code": "aapl", "Name": "Apple", "StartDate": "2020-01-01", "EndDate": None, "IsActiveNow": 1}
    for body in ({"Components": {"0": one}}, {"HistoricalTickerComponents": [one]}, [one]):
        assert [(r["code"], str(r["start_date"]), r["end_date"], r["active"]) for r in vendor.members(of("idx", body)).collect()] == [("AAPL", "2020-01-01", None, True)]


def test_mining(spark):
    def read(*answers):
        rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)]
        df = spark.createDataFrame(rows, "k int, body string").select("k", mining.candidates(F.col("body")).alias("c"))
        return [r["c"] for r in df.orderBy("k").collect()]

    fenced = {"choices": [{"message": {"content": [{"type": "text", "text": "Here:\n```json\n{\"factors\": [{\"expr\": \"RANK($close)\"}, \"RANK( $close)\"]}\n```"}]}}], "usage": {"total_tokens": 40}}
    said = lambda text: {"choices": [{"message": {"content": text}}]}
    lines = "1. RANK($close)\n- ABS($volume)\n\n2) * LOG($open)"
    assert read(fenced, lines, said(lines), None, {"choices": []}, "", "[1]", {"factors": [{"name": "x"}, {"formula": " a "}, " ", "b"]}, said('{"factors": ["c"]}')) == [
        ["RANK($close)", "RANK( $close)"], ["RANK($close)", "ABS($volume)", "LOG($open)"], ["RANK($close)", "ABS($volume)", "LOG($open)"], [], [], [], ["[1]"], ["a", "b"], ["c"],
    ]
    calls = []

    def call(model, prompt):
        calls.append(model)
        if model == "a":
            raise OSError("down")
        return fenced

    got = mining.mine(spark, ["x", "y"], ["a", "b"], call, goal=2)
    assert calls == ["a", "b"] and got.valid == ["RANK($close)", "RANK( $close)"] and got.invalid == 0 and got.spent["tokens"] == 40 + 512
    assert mining.mine(spark, ["x"] * 9, ["b"], lambda *_: "FOO($close)").halted == "100% of the expressions are invalid"
    assert mining.mine(spark, ["x"] * 9, ["a"], call, mining.Budget(failures=2)).halted
    assert len(mining.prompts_for(10, 4, ["u", "v"], "p")) == 3


def test_verdicts_by_column_and_by_text(spark):
    several = ["RANK($close)", " TS_MEAN( $close,\n 5) ", "", "FOO($x) + rank($y)", "((1)", "1)(", "(" * 11 + "1" + ")" * 11, "import os", "ema($x, 3)", "if (x)", "field_a(1)", "A" * 501, "Eval(1)", "ts_covariance(1)"]
    rows = spark.createDataFrame(list(enumerate(several)), "k int, e string").select("k", expressions.verdict(F.col("e")).alias("v")).orderBy("k").collect()
    for text, r in zip(several, rows, strict=True):
        want = expressions.sanitized(text)
        assert (r["v"]["valid"], r["v"]["cleaned"], tuple(r["v"]["errors"])) == (want.valid, want.cleaned, want.errors), text


def test_tables_in_pages(spark):
    page = "<table><tr><th>a<th>b<tr><td>1<td>x<br>y<table><tr><td>Symbol</td><td>Sector</td></tr><tr><td> A&amp;B </td></tr><tr></tr></table>z</td></tr></table>"
    assert html.tables_of(page) == [[["a", "b"], ["1", "x yz"]], [["Symbol", "Sector"], ["A&B"]]] and html.tables_of(None) == []
    rows = html.scan(spark.createDataFrame([(1, page), (2, "<p>none"), (3, None)], "k int, body string"), "k", "body", [("Symbol",), ("GICS Sector", "Sector")]).collect()
    assert [tuple(r) for r in rows] == [(1, "A&B", None)] and rows[0].asDict().keys() == {"k", "Symbol", "GICS Sector"}


def test_warehouse_tables_are_found(spark):
    catalog = spark.createDataFrame([("crsp", "dsf", "PERMNO"), ("crsp", "dsf", "prc"), ("crsp", "sp500_members", "permno"), ("x", "dsf_v2", "permno")], "library string, table string, column string")
    assert warehouse.found(catalog, warehouse.DAILY) == ("crsp", "dsf", {"permno", "prc"}) and warehouse.found(catalog, warehouse.NAMES) is None
    assert warehouse.found(catalog, warehouse.MEMBERS, "(?i)(sp500|s&p).*(list|const|member)")[1] == "sp500_members"
    daily = spark.createDataFrame([(1, "2024-01-02", 1.0, 2.0, 1.0, -4.0, 10.0, 2.0), (1, "2024-01-03", 1.0, 2.0, 1.0, 4.0, None, 0.0), (2, "2024-01-02", 1.0, 2.0, 1.0, None, 1.0, None)], "permno long, date string, open double, high double, low double, price double, volume double, factor double")
    names = spark.createDataFrame([(1, " ab ", dt.date(2024, 1, 1), dt.date(2024, 1, 2)), (1, " ", dt.date(2024, 1, 3), None)], "permno long, name string, start date, end date")
    rows = {(str(r["date"]), r["symbol"]): (r["close"], r["adj_close"]) for r in warehouse.history(daily, names, "2024-01-01", fallback=F.lit("q")).collect()}
    assert rows == {("2024-01-02", "AB"): (4.0, 2.0), ("2024-01-03", "Q"): (4.0, 4.0), ("2024-01-02", "Q"): (None, None)}
    assert warehouse.history(daily, names, "2024-01-01", symbols=["ab"]).count() == 1


def test_ingest_halts_and_publishes(spark, tmp_path):
    day = lambda d: dt.date(2026, 2, d)
    rows = [(day(d), s, p, p + 1, p - 1, p, p, 10.0, 10 * p) for d in (16, 17, 18, 19, 20) for s, p in (("A", 100.0), ("B", 200.0))]
    bars = spark.createDataFrame(rows, panel.BARS)
    members = spark.createDataFrame([(r[0], r[1], True) for r in rows], "date date, symbol string, active boolean")
    old, new = bars.where("date <= '2026-02-17'"), bars.where("date = '2026-02-20'").unionByName(bars.where("date = '2026-02-20' and symbol = 'A'").withColumn("symbol", F.lit("Z")))
    fetch = lambda days: bars.where(F.col("date").cast("string").isin(days))
    assert ingest.missing_days(old, "2026-02-20") == ["2026-02-18", "2026-02-19"] and ingest.missing_days(old.limit(0), "2026-02-20") == []
    said = ingest.ingest("in", f"{tmp_path}/out", old, members, "2026-02-20", new, fetch=fetch, least=2)
    assert (said["total_rows"], said["total_symbols"], said["new_rows"], said["backfilled_days"]) == (10, 2, 2, 2)
    for options, why in (({"least": 3}, "completeness"), ({"most_days": 2, "least": 2}, "missing")):
        with pytest.raises(ingest.Halted, match=why):
            ingest.ingest("in", f"{tmp_path}/none", old, members, "2026-02-20", new, fetch=fetch, **options)
    with pytest.raises(ingest.Halted, match="no members"):
        ingest.ingested(bars, members, "2026-02-23", new, least=2)
    assert not (tmp_path / "none").exists()


def test_signals_of_a_day(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), s, p, p, p, p + d * k, p + d * k, 1e6, 1e8) for d in range(80) for k, (s, p) in enumerate([("A", 100.0), ("B", 100.0), ("C", 100.0)])]
    bars = spark.createDataFrame(rows, panel.BARS)
    members = spark.createDataFrame([(rows[-1][0], s, True) for s in "AB"], "date date, symbol string, active boolean")
    sectors = spark.createDataFrame([("A", "x")], "symbol string, sector string")
    s = signals.Settings(top_k=2, max_weight=0.5, max_sector_weight=None, min_adv=1.0)
    got = {r["symbol"]: r["weight"] for r in signals.generate(bars, members, sectors, None, s).collect()}
    assert got == {"A": 0.5, "B": 0.5}
    previous = spark.createDataFrame([("c", 1.0)], "symbol string, weight double")
    moved = {r["symbol"]: r["weight"] for r in signals.generate(bars, members, sectors, "2024-03-20", s, previous).collect()}
    assert moved == pytest.approx({"A": 0.1, "B": 0.1})
    one = signals.metadata("2024-03-20", s, "out", checks.quality(bars, members, "2024-03-20", 2))
    assert len(one["config_hash"]) == 64 and len(one["quality"]) == 8 and one["config_hash"] != signals.metadata("2024-03-20", signals.Settings(), "out", checks.quality(bars, members, "2024-03-20", 2))["config_hash"]


def test_chain_goes_on_where_it_failed(spark, tmp_path):
    did, bad = [], [True]

    def second():
        did.append("b")
        if bad[0]:
            raise ValueError("no data")

    stages = [("a", lambda: did.append("a")), ("b", second), ("c", lambda: did.append("c"))]
    assert [x["status"] for x in chain.run(spark, stages, f"{tmp_path}/1")] == ["success", "failed"]
    bad[0] = False
    assert [x["status"] for x in chain.run(spark, stages, f"{tmp_path}/2", resume=f"{tmp_path}/1")] == ["skipped_resume", "success", "success"]
    assert did == ["a", "b", "b", "c"] and chain.run(spark, stages, f"{tmp_path}/3", resume=f"{tmp_path}/2") and len(did) == 4
