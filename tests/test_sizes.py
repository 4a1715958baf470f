import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import pct_rank
from barloom.operators import membership, metrics, portfolio
from barloom.operators.factors import averaged_ranks
from barloom.plans import expressions, mining, queries, walk_forward
from barloom.sources import panel

DATA = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_correlation_of_what_does_not_vary_is_null(spark):
    rows = [(DAY + dt.timedelta(i), "A", x, y) for i, (x, y) in enumerate([(1.0, 3.0), (1.0, 3.0), (1.0, 4.0), (2.0, 5.0), (None, 9.0), (3.0, 7.0), (5.0, 7.5)])]
    df = spark.createDataFrame(rows, "date date, symbol string, close double, volume double")
    got = [r["value"] for r in expressions.evaluated(df, "TS_CORR($close, $volume, 3)").orderBy("date").collect()]
    assert got[:3] == [None, None, None] and got[4] is None and got[5] is None
    assert got[3] == pytest.approx(np.corrcoef([1.0, 1.0, 2.0], [3.0, 4.0, 5.0])[0, 1])


def test_ranks_of_arrays_are_those_of_windows(spark):
    rng = random.Random(8)
    rows = [(DAY, i, rng.choice([None, 0.0, -0.0, 1.5, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "date date, i int, x double")
    x = np.array([np.nan if r[2] is None else r[2] for r in rows])
    for up in (True, False):
        want = [r["r"] for r in df.select("i", pct_rank(F.col("x"), up).alias("r")).orderBy("i").collect()]
        assert [None if np.isnan(r) else float(r) for r in averaged_ranks(x, up)] == want
    assert averaged_ranks(np.full(3, np.nan), True).tolist() == pytest.approx([np.nan] * 3, nan_ok=True)


def test_scores_shuffle_lines_once_by_symbol_and_once_by_date(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(queries._scored(spark, DATA))
        assert text.count("Exchange hashpartitioning") == 2 and text.count("Sort [symbol") <= 1
        assert "WindowGroupLimit" in plan(queries._weights(spark, DATA))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_members_by_intervals_are_those_by_days(spark):
    d = lambda n: DAY + dt.timedelta(n)
    c = spark.createDataFrame([("a", d(0), d(2), 1), ("A", d(4), None, 2), ("b", None, d(1), 3), ("c", d(5), d(3), 4)], "code string, start_date date, end_date date, permno long")
    cal = spark.createDataFrame([(d(i),) for i in range(8)], "date date")
    lo, hi = F.lit(d(1)), F.lit(d(6))
    rows = cal.crossJoin(spark.createDataFrame([(s,) for s in "ABCD"], "symbol string"))
    got = membership.flagged(rows, c, lo, hi)
    assert got.count() == 32
    assert {(r["date"], r["symbol"]) for r in got.where("active").collect()} == {(r["date"], r["symbol"]) for r in membership.expanded(c, cal, lo, hi).collect()}
    assert "explode" not in optimized(queries._with_universe(panel.bars(spark, DATA), spark, DATA))


def test_a_fold_replays_only_the_symbols_it_weighs(spark):
    rng, days, names = random.Random(4), [DAY + dt.timedelta(i) for i in range(560)], [f"S{i}" for i in range(12)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx long")
    rows = [(d, s, 50 + rng.random(), 1e9, 0.01, s != "S3" or i % 5 > 0) for i, d in enumerate(days) for s in names]
    df = spark.createDataFrame(rows, "date date, symbol string, open double, adv20 double, vol_21d double, eligible boolean")
    weights = spark.createDataFrame([(d, names[(i // 9 + k) % 5], 0.3) for i, d in enumerate(days) for k in range(3)], "date date, symbol string, weight double")
    s = walk_forward.Settings(train_months=6, valid_months=2, max_weight=0.4)
    got = walk_forward.walk_forward(df, weights, cal, s)
    spans = walk_forward.fold_table(cal, s).select("fold_id", F.explode(F.sequence("test_start", "test_end")).alias("date"))
    every = df.join(spans, "date").join(walk_forward.dated(cal), "date").join(weights, ["date", "symbol"], "left")
    want = walk_forward.with_opens(every, df.select("date", "symbol", "open")).groupBy("fold_id").applyInPandas(walk_forward._replay(s), f"{walk_forward.RESULT}, {walk_forward.HELD}")
    order = ["fold_id", "as_of_date"]
    a, b = (x.orderBy(*order).drop("held").toPandas() for x in (got, want))
    assert len(a) > 100
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    assert "LeftSemi" in optimized(got)


def test_sectors_give_no_more_names_than_they_have_room_for(spark):
    rows = [(DAY, f"S{i:03}", float(i), "AB"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "date date, symbol string, score double, sector string")
    got = {r["symbol"]: r["weight"] for r in portfolio.desired_weights(df, 10, 0.15, 0.35).collect()}
    assert got == pytest.approx({**{f"S{i}": 0.1 for i in range(194, 200)}, "S193": 0.05, "S192": 0.05})


def test_the_next_value_is_found_without_going_over_what_follows_again(spark):
    left = spark.createDataFrame([("A", d) for d in (1, 2, 4, 9)], "k string, at int")
    right = spark.createDataFrame([("A", 2, 20.0), ("A", 3, None), ("A", 5, 50.0)], "k string, at int, v double")
    got = membership.nearest_after(left, right, ["k"], "at", "v")
    assert [r["v"] for r in got.orderBy("at").collect()] == [20.0, 20.0, 50.0, None]
    assert "unboundedfollowing" not in optimized(got)


def test_expressions_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, '{"factors": ["TS_MEAN($close,  5)", "FOO($x)", "RANK($x))(", " "]}')], "k int, answer string")
    rows = mining.expressions_in(df, "k", "answer")
    assert [(r["valid"], r["cleaned"]) for r in rows.orderBy("number").collect()] == [(True, "TS_MEAN($close, 5)"), (False, "FOO($x)"), (False, "RANK($x))(")]
    assert optimized(rows).count("trim(regexp_replace(expression#") == 1
    assert queries.mined_expressions(spark, DATA).rdd.getNumPartitions() == 4


def test_reports_rank_names_once(spark, monkeypatch):
    calls, plain = [], queries.scored
    monkeypatch.setattr(queries, "scored", lambda *a: calls.append(a) or plain(*a))
    got = queries.daily_report(spark, DATA)
    assert len(calls) == 1 and "Arrow" not in plan(got)
    for query in (queries.signal_summary, queries.latest_signals):
        assert "Arrow" not in plan(query(spark, DATA))
    assert panel.latest(spark, DATA) == panel.bars(spark, DATA).agg(F.max("date")).first()[0]


def test_days_of_folds_are_those_of_the_calendar_joined(spark):
    days = [DAY + dt.timedelta(i) for i in range(700) if i % 7 < 5]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx long")
    s = walk_forward.Settings(train_months=6, valid_months=2, warm_up=100, lag=2, horizon=3)
    spans = walk_forward.fold_table(cal, s).select("fold_id", F.explode(F.sequence("test_start", "test_end")).alias("date"))
    want = walk_forward.dated(cal, 2, 3).join(spans, "date").select("fold_id", "date", "entry_date", "exit_date")
    order = lambda df: [tuple(r) for r in df.orderBy("fold_id", "date").collect()]
    got = order(walk_forward.tested_days(cal, s))
    assert got == order(want) and got[-1][2:] == (None, None) and len(got) > 100


def test_a_replay_plans_neither_calendar_nor_weights_again(spark, monkeypatch):
    text = optimized(queries._walk(spark, DATA))
    assert "l_shipdate" not in text and text.count("Window") <= 1
    monkeypatch.delattr(queries, "_baselines")
    assert queries.walk_forward_summary(spark, DATA).count() == 1


def test_gates_put_days_in_order_once(spark):
    rng, order = random.Random(6), ["fold_id", "as_of_date"]
    rows = [(i % 3, DAY + dt.timedelta(i), rng.choice([None, rng.gauss(0.001, 0.01)]), rng.random(), rng.gauss(0, 0.01), None) for i in range(90)]
    df = spark.createDataFrame(rows, "fold_id int, as_of_date date, net_return double, turnover double, baseline_a double, baseline_b double")
    got = metrics.gates(df, 500, 1.0, 0.3, order)
    assert "Join" not in optimized(got) and plan(got).count("Exchange") == 1
    found = {r["gate"]: r["metric"] for r in got.collect()}
    parts = metrics.bins(df, [], order).groupBy("bin").agg(metrics.sharpe(F.col("net_return")).alias("s"))
    assert found["subperiods"] == parts.where("s > 0").count() and 0 < found["subperiods"] < 8
    assert found["drawdown"] == pytest.approx(metrics.drawdowns(df, "net_return", [], order).agg(F.max("drawdown")).first()[0])
    assert found["baselines"] == pytest.approx(found["net_sharpe"] - max(0.0, df.agg(metrics.sharpe(F.col("baseline_a"))).first()[0]))
    none = {r["gate"]: r for r in metrics.gates(df.limit(0), 500, 1.0, 0.3, order).collect()}
    assert len(none) == 8 and not any(r["passed"] for r in none.values()) and none["subperiods"]["metric"] == 0


def test_what_is_held_has_its_sector(spark):
    days = queries._walk(spark, DATA).select("held")
    sectors = {r["sector"]: r["share"] for r in walk_forward.sector_shares(days, panel.sectors(spark, DATA)).collect()}
    assert {r["sector"]: r["share"] for r in walk_forward.sector_shares(days).collect()} == pytest.approx(sectors)
    assert walk_forward.greatest_share(days) == pytest.approx(max(sectors.values())) and walk_forward.greatest_share(days.limit(0)) is None


def test_research_opens_each_table_once_and_runs_few_jobs(spark, monkeypatch):
    opened, plain, context = [], panel.table, spark.sparkContext
    monkeypatch.setattr(panel, "table", lambda *a: opened.append(a[-1]) or plain(*a))
    context.setJobGroup("barloom-research", "")
    try:
        assert queries.research_gates(spark, DATA).count() == 8
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(opened) == ["lineitem", "nation", "region", "supplier"]
    assert len(context.statusTracker().getJobIdsForGroup("barloom-research")) <= 40
