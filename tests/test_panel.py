import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions.columns import SIC_SECTORS, code_sector, pct_rank, period_return, rolling
from barloom.operators import checks, membership, metrics, portfolio
from barloom.plans import expressions, queries, walk_forward
from barloom.sources import panel

DATA = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 2)
FAST = ["bars_daily", "score", "weights_sector_cap", "turnover_step", "membership_expand", "interval_overlap", "asof_nearest", "dq_suite", "dq_faults", "risk_pre", "risk_post", "folds", "baseline_spy", "baseline_ew", "topk_signals", "subperiods", "expr_ts_corr", "expr_nested", "expr_ts_rank", "expr_ema"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda x: sorted(str([None if pd.isna(v) else round(v, 8) if isinstance(v, float) else str(v) for v in r]) for r in x[sorted(x.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_rank_averages_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([(DAY, str(i), v) for i, v in enumerate([3.0, 1.0, 1.0, None, 2.0, 9.0])], "date date, symbol string, v double")
    rows = df.select("symbol", pct_rank(F.col("v")).alias("up"), pct_rank(F.col("v"), False).alias("down")).orderBy("symbol").collect()
    assert [r["up"] for r in rows] == pytest.approx([0.8, 0.3, 0.3, None, 0.6, 1.0])
    assert [r["down"] for r in rows] == pytest.approx([0.4, 0.9, 0.9, None, 0.6, 0.2])


def test_returns_and_rolling(spark):
    rows = [(DAY + dt.timedelta(i), "A", v) for i, v in enumerate([1.0, None, 2.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "date date, symbol string, v double").withColumn("f", F.expr("last(v, true) over (partition by symbol order by date)"))
    assert [r[0] for r in df.select(period_return(F.col("f"), 1).alias("r"), "date").orderBy("date").collect()] == [None, 0.0, 1.0, -1.0, None]
    rows = [(DAY + dt.timedelta(i), "A", v) for i, v in enumerate([None, 1.0, 2.0, None, 5.0])]
    df = spark.createDataFrame(rows, "date date, symbol string, v double")
    got = [r[0] for r in df.select(rolling(F.stddev_samp, F.col("v"), 3, 2).alias("s"), "date").orderBy("date").collect()]
    assert got == pytest.approx([None, None, 0.70710678, 0.70710678, 2.12132034])


def sequential(rows, top_k, max_w, cap):
    """Weights by the plain two-pass definition."""
    tw, w, used = min(1 / top_k, max_w), {}, {}
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    for s, _, sec in rows:
        a = min(tw, max_w, cap - used.get(sec, 0.0))
        if a > 1e-10 and len(w) < top_k:
            w[s] = a
            used[sec] = used.get(sec, 0.0) + a
    left = max(1 - sum(w.values()), 0)
    for s, _, sec in rows:
        if s in w and left > 1e-10:
            b = max(0.0, min(left, max_w - w[s], cap - used[sec]))
            w[s], used[sec], left = w[s] + b, used[sec] + b, left - b
    return {s: x for s, x in w.items() if x > 1e-8}


def test_weights_equal_the_sequential_definition(spark):
    rng = random.Random(5)
    rows = [(DAY + dt.timedelta(d), f"S{i:02}", round(rng.random(), 2), rng.choice("ABC")) for d in range(40) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "date date, symbol string, score double, sector string")
    got: dict = {}
    for r in portfolio.desired_weights(df, 4, 0.3, 0.5).collect():
        got.setdefault(r["date"], {})[r["symbol"]] = r["weight"]
    for day in {r[0] for r in rows}:
        assert got[day] == pytest.approx(sequential([r[1:] for r in rows if r[0] == day], 4, 0.3, 0.5))


def test_turnover_cap(spark):
    new = spark.createDataFrame([(DAY, "N", 0.5), (DAY, "M", 0.5)], "date date, symbol string, weight double")
    old = spark.createDataFrame([(DAY, "A", 0.5), (DAY, "B", 0.5)], "date date, symbol string, weight double")
    w = {r["symbol"]: r["weight"] for r in portfolio.capped_turnover(new, old, 0.2, 1.0).collect()}
    assert w == pytest.approx({"A": 0.4, "B": 0.4, "N": 0.1, "M": 0.1})


def test_sectors_bins_and_sharpe(spark):
    codes = spark.createDataFrame([("3571",), ("7372",), ("2834",), (None,), ("x",)], "c string")
    assert [r[0] for r in codes.select(code_sector(F.col("c"), SIC_SECTORS)).collect()] == ["Information Technology", "Industrials", "Industrials", "Unknown", "Unknown"]
    df = spark.createDataFrame([(i, 0.0) for i in range(10)], "i int, r double")
    assert [r["bin"] for r in metrics.bins(df, [], ["i"]).orderBy("i").collect()] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    one = spark.createDataFrame([(0, -0.1)], "i int, r double")
    assert one.select(metrics.sharpe(F.col("r"))).first()[0] is None
    assert metrics.drawdowns(one, "r", [], ["i"]).first()["drawdown"] == 0


def test_conform_and_upsert(spark):
    df = spark.createDataFrame([("2024-01-02", "aapl", "1.5", "x"), ("bad", "b", "1", "1"), ("2024-01-02", None, "1", "1")], "date string, symbol string, close string, volume string")
    rows = panel.conform(df, panel.BARS).collect()
    assert [(r["symbol"], r["close"], r["volume"], r["dollar_volume"]) for r in rows] == [("AAPL", 1.5, None, 0.0)]
    with pytest.raises(ValueError, match="missing"):
        panel.conform(df.drop("close"), panel.BARS)
    old, new = (spark.createDataFrame([(DAY, "A", v)], "date date, symbol string, v int") for v in (1, 2))
    assert [r["v"] for r in panel.upserted(old, new).collect()] == [2]


def test_membership(spark):
    c = spark.createDataFrame([("aapl", dt.date(2024, 1, 2), None, 7), ("msft", None, dt.date(2024, 1, 2), 8)], "code string, start_date date, end_date date, permno long")
    got = membership.expanded(c, panel.weekdays(spark, "2024-01-01", "2024-01-07"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date"))
    assert sorted((str(r["date"]), r["symbol"]) for r in got.collect()) == [("2024-01-01", "MSFT"), ("2024-01-02", "AAPL"), ("2024-01-02", "MSFT"), ("2024-01-03", "AAPL")]


def test_quality_finds_duplicates_and_gaps(spark):
    rows = [(dt.date(2026, 2, d), s, p, p + 1, p - 1, p, p, 10.0, 10 * p) for d in (19, 20) for s, p in (("A", 100.0), ("B", 200.0))]
    bars = spark.createDataFrame(rows, panel.BARS)
    members = spark.createDataFrame([(r[0], r[1], True) for r in rows], "date date, symbol string, active boolean")
    ok = lambda df, day: {r["check"]: (r["passed"], r["value"]) for r in checks.quality(df, members, day, 2).collect()}
    assert all(p for p, _ in ok(bars, "2026-02-20").values())
    assert ok(bars.unionByName(bars.where("date = '2026-02-20'").limit(1)), "2026-02-20")["duplicates"] == (False, 2.0)
    assert ok(bars, "2026-02-25")["gap_backfill"] == (False, 3.0)
    # what happened on earlier days doesn't count, and severities say how bad a failure is
    old = spark.createDataFrame([(dt.date(2026, 2, d), s, p, p + 1, p - 1, p, a, 10.0, 10 * p) for d, s, p, a in ((16, "A", 100.0, 100.0), (17, "A", 170.0, 50.0), (17, "A", 170.0, 50.0), (18, "A", 100.0, 100.0))], panel.BARS)
    assert all(p for p, _ in ok(bars.unionByName(old), "2026-02-20").values())
    level = lambda df, day, least=2, **k: {r["check"]: (r["passed"], r["severity"]) for r in checks.quality(df, members, day, least, **k).collect()}
    assert set(level(bars, "2026-02-20").values()) == {(True, "info")}
    assert level(bars, "2026-02-20", warn=490)["completeness"] == (True, "warning")
    none = level(bars, "2026-02-21")
    assert none["ohlc_validity"] == none["adjusted_consistency"] == none["completeness"] == (False, "critical")
    less = bars.where("not (symbol = 'B' and date = '2026-02-20')")
    assert level(less, "2026-02-20")["gaps"] == (False, "critical") and level(less, "2026-02-20", 1)["gaps"] == (True, "warning")
    jump = bars.withColumn("adj_close", F.when((F.col("symbol") == "B") & (F.col("date") == "2026-02-20"), 900.0).otherwise(F.col("adj_close")))
    assert level(jump, "2026-02-20")["return_outliers"] == level(jump, "2026-02-20")["adjusted_consistency"] == (False, "warning")
    assert level(jump, "2026-02-20", explained=("B",))["return_outliers"] == (True, "info")
    assert not checks.passes(checks.quality(less, members, "2026-02-20", 2)).first()["passed"] and checks.passes(checks.quality(jump, members, "2026-02-20", 2)).first()["passed"]


def test_trade_checks(spark):
    intents = spark.createDataFrame([("OUT", "sell", -100.0), ("A", "Buy", 200.0)], "symbol string, side string, delta_value double").withColumns({c: F.lit(None).cast("double") for c in ("notional", "qty", "price")})
    signals = spark.createDataFrame([("a", 0.04), ("b", None)], "symbol string, weight double")
    universe = spark.createDataFrame([("A",), ("B",)], "symbol string")
    failed = lambda *a, **k: {r["check"] for r in checks.pre_trade(*a, **{"least": 2, **k}).where("not passed").collect()}
    assert failed(intents, signals, universe, 10000.0, 1000.0) == set()
    assert failed(intents, signals, None, 10000.0, 1000.0, latest="2024-01-02", as_of="2024-01-02") == set()
    assert failed(intents, signals, universe.where("symbol = 'A'"), 10000.0, 1000.0) == {"universe"}
    assert failed(intents, signals, universe, 10000.0, 100.0, latest="2024-01-01", as_of="2024-01-02", paused=True, trading_day=False) == {"buying_power", "data_age", "pause_switch", "trading_day"}
    assert failed(intents, signals, universe, -5.0, 1000.0) == {"turnover", "order_size"}
    assert failed(intents.limit(0), signals.limit(0), universe, 10000.0, 0.0) == {"positions"}


def test_baselines_rank_before_opens_are_joined(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(days[0], "A", 1.0, 0.9, True), (days[0], "B", 1.0, 0.8, True), (days[0], "C", 1.0, 0.1, False), (days[1], "B", 10.0, 0.0, True), (days[2], "B", 11.0, 0.0, True), (days[1], "C", 10.0, 0.0, True), (days[2], "C", 12.0, 0.0, True), (days[1], "A", 5.0, 0.0, True)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx long")
    got = walk_forward.baselines(spark.createDataFrame(rows, "date date, symbol string, open double, mom_252d double, active boolean"), cal, 1, "C").where("date = '2024-01-01'").first()
    assert got["baseline_momentum"] is None and got["baseline_equal_weight"] == pytest.approx(0.1 * 0.98) and got["baseline_spy"] == pytest.approx(0.2 * 0.98)


def test_folds_and_replay(spark):
    days = list(pd.bdate_range("2020-01-01", "2024-12-31"))
    s = walk_forward.Settings(train_months=24, valid_months=6, test_months=2, max_weight=0.5)
    got = walk_forward.folds(days, s)
    assert got and all(f[2] < f[3] <= f[4] < f[5] < f[6] for f in got)
    assert walk_forward.folds(days[:300], s) == []
    pdf = pd.DataFrame({"fold_id": 0, "date": DAY, "symbol": ["A", "B"], "adv20": 1e9, "vol_21d": 0.0, "eligible": True, "weight": 0.5, "entry_date": DAY, "exit_date": DAY, "entry": [10.0, 20.0], "exit": [11.0, 20.0]})
    assert walk_forward._replay(s)(pdf).iloc[0]["cash_weight"] == pytest.approx(0.02)
    row = walk_forward._replay(s)(pdf).iloc[0]
    assert row["gross_exposure"] == pytest.approx(0.98) and row["gross_return"] == pytest.approx(0.049) and row["turnover"] == pytest.approx(0.49)


def test_gates_judge_sectors_and_all_baselines(spark):
    held = [("A", 0.5, 0.1), ("B", 0.25, -0.2), ("C", 0.25, 0.4)]
    one = spark.createDataFrame([([dict(zip(("symbol", "weight", "ret"), h, strict=True)) for h in held],)], walk_forward.HELD)
    shares = walk_forward.sector_shares(one, spark.createDataFrame([("A", "x"), ("B", "x")], "symbol string, sector string")).collect()
    assert {r["sector"]: r["share"] for r in shares} == pytest.approx({"x": 0.5, "Unknown": 0.5})

    queries._walk(spark, DATA).createOrReplaceTempView("walk")
    panel.sectors(spark, DATA).createOrReplaceTempView("sectors")
    queries.baseline_ew(spark, DATA).createOrReplaceTempView("ew")
    queries.baseline_mom(spark, DATA).createOrReplaceTempView("mom")
    queries.baseline_spy(spark, DATA).createOrReplaceTempView("spy")
    pnl = {r[0]: r[1] for r in spark.sql("select s.sector, sum(abs(p.weight * p.ret)) from (select explode(held) p from walk) join sectors s on s.symbol = p.symbol group by 1").collect()}
    days = spark.sql("select net_return, ew.baseline_equal_weight, mom.baseline_momentum, spy.baseline_spy from walk left join ew on ew.date = as_of_date left join mom on mom.date = as_of_date left join spy on spy.date = as_of_date").toPandas()
    days = days.astype(float)
    ratio = (days.mean() / days.std() * 252**0.5).where(days.count() > 0, 0.0)
    got = {r["gate"]: r for r in entry.queries()["research_gates"](spark, DATA).collect()}
    share = max(pnl.values()) / sum(pnl.values())
    assert len(days) and got["sector_share"]["metric"] == pytest.approx(share) and got["sector_share"]["passed"] == (share <= 0.4)
    assert got["baselines"]["metric"] == pytest.approx(ratio["net_return"] - ratio[1:].max())


def test_expressions(spark):
    bad = ["", "import os", "FOO($close)", "TS_MEAN($close, 5", "A" * 501, "ema($close, 3)"]
    assert not any(expressions.sanitized(b).valid for b in bad)
    assert expressions.sanitized(" RANK(  $close ) ").cleaned == "RANK( $close )"
    df = spark.createDataFrame([(DAY + dt.timedelta(i), s, float(v)) for s, vs in {"A": [1, 2, 3], "B": [3, 1, 3]}.items() for i, v in enumerate(vs)], "date date, symbol string, close double")
    rows = expressions.evaluated(df, "TS_MEAN(RANK($close), 2)").orderBy("symbol", "date").collect()
    assert [r["value"] for r in rows] == pytest.approx([None, 0.75, 0.875, None, 0.75, 0.625])
    with pytest.raises(ValueError):
        expressions.evaluated(df, "TS_MEAN($close, $close)")
