import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from barloom.plans import queries
from barloom.sources import panel

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select("date", "symbol", "score", "sector").collect()))


def last_two(df):
    days = sorted({r["date"] for r in df.select("date").distinct().collect()})[-2:]
    return rows_of(df.where(F.col("date").isin(days)))


def test_recent_eligible_are_the_last_dates_of_all(spark, monkeypatch):
    calls, plain = [], queries.scored
    monkeypatch.setattr(queries, "scored", lambda rows, *a: calls.append(rows) or plain(rows, *a))
    for until in (None, "2001-06-30"):
        every = queries._eligible(spark, DATA) if until is None else queries._eligible(spark, DATA).where(F.col("date") <= until)
        calls.clear()
        got = rows_of(queries._recent_eligible(spark, DATA, until))
        assert got and got == last_two(every)
        assert len(calls) == 1 and calls[0].select("date").distinct().count() <= queries.RECENT


def test_recent_eligible_go_back_over_days_without_any(spark, tmp_path):
    for name in ("supplier", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(Path(DATA) / f"{name}.parquet")
    lines = panel.table(spark, DATA, "lineitem")
    last = lines.agg(F.max("l_shipdate")).first()[0]
    empty = F.col("l_shipdate") > last - dt.timedelta(60)
    lines.withColumn("l_quantity", F.when(empty, 0.0).otherwise(F.col("l_quantity"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = str(tmp_path)
    assert panel.calendar(spark, d).where(F.col("date") > panel.latest(spark, d)).count() > queries.RECENT
    got = rows_of(queries._recent_eligible(spark, d))
    assert got and got == last_two(queries._eligible(spark, d))


def test_signals_and_risk_rank_recent_dates_alone(spark, monkeypatch):
    seen, plain = [], queries.scored
    monkeypatch.setattr(queries, "scored", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    for query in (queries.latest_signals, queries.signal_summary, queries.risk_pre, queries.report_daily):
        seen.clear()
        assert query(spark, DATA).count() > 0
        assert [rows.select("date").distinct().count() <= queries.RECENT for rows in seen] == [True], query.__name__


def test_members_of_a_day_are_those_of_all_days(spark):
    for day in ("1996-05-01", "2001-11-12", "2002-03-01"):
        want = queries._members(spark, DATA).where(F.col("date") == day)
        assert sorted(map(tuple, queries._members(spark, DATA, day).collect())) == sorted(map(tuple, want.collect()))


def test_held_shares_go_over_lines_once(spark, monkeypatch):
    calls, plain = [], panel.bars
    monkeypatch.setattr(panel, "bars", lambda *a: calls.append(a) or plain(*a))
    got = {r["sector"]: r["share"] for r in queries.held_sector_shares(spark, DATA).collect()}
    assert len(calls) == 1 and abs(sum(got.values()) - 1) < 1e-5


def test_ordered_days_meet_bars_where_they_lie(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (queries.asof_after, queries.asof_nearest):
            assert query(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
