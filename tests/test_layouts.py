import collections
import datetime as dt
import random

import pandas as pd
from pandas.tseries import holiday as h
from pyspark.sql import functions as F

from barloom.operators import membership
from barloom.sources import html, sessions, warehouse


def plain_grid(rows):
    """Cells of (text, columns, rows) put on a board one square at a time."""
    board = {}
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while (y, x) in board:
                x += 1
            for dy in range(len(rows) - y if down == 0 else min(down, len(rows) - y)):
                for dx in range(columns):
                    board.setdefault((y + dy, x + dx), text)
            x += columns
    return [[board.get((y, c), "") for c in range(max((c for r, c in board if r == y), default=-1) + 1)] for y in range(len(rows))]


def test_spans_as_on_a_board():
    rng = random.Random(4)
    for _ in range(400):
        groups, text = [], "<table>"
        for _ in range(rng.randint(1, 3)):
            rows = [[(f"c{rng.randrange(99)}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 0, 9])) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(5))]
            groups.append(rows)
            text += "<tbody>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan='{r}'> {t}\n" for t, c, r in row) for row in rows)
        assert html.tables_of(text) == [[r for rows in groups for r in plain_grid(rows) if r]]


def test_odd_spans_and_pages():
    one = lambda attrs: html.tables_of(f"<table><tr><td {attrs}>a<td>b<tr><td>c")[0]
    assert one("colspan=0") == one("colspan=x") == one("colspan") == one("rowspan=-2") == [["a", "b"], ["c"]]
    assert one("rowspan=99999999") == [["a", "b"], ["a", "c"]] and len(one("colspan=5000")[0]) == 1001
    assert html.tables_of(None) == html.tables_of("") == html.tables_of("<td>no table") == []
    assert html.tables_of("<table><tr><td>a<table><tr><td>in</table>z</table>") == [[["az"]], [["in"]]]
    assert html.tables_of("<table><tr><td>a<script>var x='<td>';</script>b") == [[["ab"]]]


def test_snapshots_under_any_names(spark):
    rows = spark.createDataFrame([(0, "brk.b ", "B", "x"), (1, "AAA", "A", None), (2, "BRK-B", "late", "y"), (3, None, "n", "z")], "place int, Ticker string, Company string, Sector string")
    got = {r["code"]: (r["name"], r["sector"], r["industry"]) for r in membership.snapshot(rows, F.col("place")).collect()}
    assert got == {"BRK-B": ("B", "x", None), "AAA": ("A", None, None)}
    assert membership.snapshot(rows.select("place", "Ticker"), F.col("place")).where("name = code").count() == 2
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3)], "date date")
    assert membership.constant_membership(spark.createDataFrame([("brk.b",), ("a",), ("A ",)], "symbol string"), days).count() == 4


class Exchange(h.AbstractHolidayCalendar):
    rules = [
        h.Holiday("new year", month=1, day=1, observance=h.sunday_to_monday), h.Holiday("king", month=1, day=1, offset=pd.DateOffset(weekday=h.MO(3)), start_date="1998-01-01"), h.USPresidentsDay, h.GoodFriday, h.USMemorialDay,
        h.Holiday("june", month=6, day=19, start_date="2022-01-01", observance=h.nearest_workday), h.Holiday("july", month=7, day=4, observance=h.nearest_workday), h.USLaborDay, h.USThanksgivingDay, h.Holiday("christmas", month=12, day=25, observance=h.nearest_workday),
    ]


#: Sessions a year, 1998 to 2026.
A_YEAR = [252, 252, 252, 248, 252, 252, 252, 252, 251, 251, 253, 252, 252, 252, 250, 252, 252, 252, 252, 251, 251, 252, 253, 252, 251, 250, 252, 250, 251]


def test_sessions_equal_a_list(spark):
    got = [str(r["date"]) for r in sessions.sessions(spark, "1998-01-01", "2026-12-31").orderBy("idx").collect()]
    off = {str(d.date()) for d in Exchange().holidays("1997-12-01", "2027-01-31")} | set(sessions.CLOSED)
    assert got == [str(d.date()) for d in pd.bdate_range("1998-01-01", "2026-12-31") if str(d.date()) not in off]
    assert [n for _, n in sorted(collections.Counter(d[:4] for d in got).items())] == A_YEAR
    easters = spark.range(1900, 2100).select(sessions.easter(F.col("id").cast("int")).alias("e")).collect()
    assert [str(r["e"]) for r in easters] == [str((pd.Timestamp(y, 1, 1) + pd.tseries.offsets.Easter()).date()) for y in range(1900, 2100)]


def test_securities_lie_by_number(spark, tmp_path):
    daily = spark.createDataFrame([(p, dt.date(2024, 1, d), 1.0, 1.0, 1.0, -2.0, 5.0, 2.0) for p in range(50) for d in range(1, 11)], "permno long, date date, open double, high double, low double, price double, volume double, factor double")
    names = spark.createDataFrame([(p, n, dt.date(2020, 1, 1), None) for p, n in [(i, f"N{i}") for i in range(48)] + [(48, "nan"), (49, " ")]], "permno long, name string, start date, end date")
    prices = warehouse.laid_out(daily, "layout_prices", f"{tmp_path}/p", 4)
    held = warehouse.laid_out(names, "layout_names", f"{tmp_path}/n", 4, "start")
    ask = lambda rows: spark.createDataFrame(rows, "symbol string, permno long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warehouse.batch(prices, held, ask([("x", 48), ("y", 49), ("z", 3), ("n7", None)]), "2024-01-03")
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("In(permno, [3,48,49])") >= 2 and "SelectedBucketsCount" in plan
    assert collections.Counter(r["symbol"] for r in got.collect()) == {"48": 8, "49": 8, "N3": 8}
    assert {(r["symbol"], r["close"], r["adj_close"]) for r in warehouse.batch(prices, held, ask([(" n7", None), ("none", None)])).collect()} == {("N7", 2.0, 1.0)}
    assert warehouse.batch(prices, held, ask([])).count() == 0 and warehouse.one_day(prices, held, "2024-01-05").count() == 50
    spark.sql("drop table layout_prices")
    spark.sql("drop table layout_names")
