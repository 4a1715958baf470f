import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from barloom.operators import checks
from barloom.plans import ingest
from barloom.sources import panel, store

DAY0 = dt.date(2020, 1, 1)


def bars(spark, days, symbols=("A", "B", "C"), price=10.0):
    rows = [(DAY0 + dt.timedelta(d), s, price, price, price, price, price, 5.0, 50.0) for d in days for s in symbols]
    return spark.createDataFrame(rows, panel.BARS)


def day(d):
    return str(DAY0 + dt.timedelta(d))


def members(spark, days, symbols=("A", "B", "C")):
    return spark.createDataFrame([(DAY0 + dt.timedelta(d), s, True) for d in days for s in symbols], "date date, symbol string, active boolean")


def files(root):
    return {str(p.relative_to(root)) for p in pathlib.Path(root).rglob("*.parquet")}


@pytest.fixture
def held(spark, tmp_path):
    out = store.Store(spark, f"{tmp_path}/panel", panel.BARS)
    ingest.load(out, bars(spark, range(970, 1000)))
    return out


def test_a_day_writes_its_own_partitions_only(spark, tmp_path):
    held = store.Store(spark, f"{tmp_path}/panel", panel.BARS)
    ingest.load(held, bars(spark, range(1000)))
    before, first = files(held.root), held.current()
    assert len({f.split("/")[2] for f in before if f.startswith("rows/")}) == 1000
    at = 1001 if (DAY0 + dt.timedelta(1000)).weekday() >= 5 else 1000
    done = ingest.ingest_day(held, members(spark, [at]), day(at), bars(spark, [at], price=11.0), least=1)
    new = {f for f in files(held.root) - before if f.startswith("rows/")}
    assert {f.split("/")[2] for f in new} == {f"date={day(at)}"} and before <= files(held.root)
    assert done["new_rows"] == 3 and done["total_rows"] == 3003 and done["version"] == 2
    assert held.read().count() == 3003 and held.read(version=first).count() == 3000
    assert {r["close"] for r in held.read(start=day(at)).collect()} == {11.0}
    assert {f.split("/")[-2] for f in held.read(start=day(at)).inputFiles()} == {f"date={day(at)}"}


def test_a_failed_check_leaves_readers_where_they_were(spark, held):
    before, version = files(held.root), held.current()
    with pytest.raises(ingest.Halted, match="completeness"):
        ingest.ingest_day(held, members(spark, [1001]), day(1001), bars(spark, [1001], symbols="A"), least=3, strict=False, most_days=9)
    assert held.current() == version and files(held.root) == before


def test_modes_halt_on_what_they_should(spark, held):
    bad = bars(spark, [1001]).withColumn("high", F.lit(1.0))
    with pytest.raises(ingest.Halted, match="ohlc"):
        ingest.ingest_day(held, members(spark, [1001]), day(1001), bad, least=1, most_days=9)
    twice = bad.unionByName(bad)
    assert ingest.ingest_day(held, members(spark, [1001]), day(1001), twice, least=1, strict=False, most_days=9)["total_rows"] == 93
    jumped = bars(spark, [1002], price=100.0)
    with pytest.raises(ingest.Halted, match="outliers"):
        ingest.ingest_day(held, members(spark, [1002]), day(1002), jumped, least=1)
    ingest.ingest_day(held, members(spark, [1002]), day(1002), jumped, least=1, explained=("A", "B", "C"))
    with pytest.raises(ingest.Halted, match="weekdays"):
        ingest.ingest_day(held, members(spark, [1020]), day(1020), bars(spark, [1020]), least=1, strict=False)


def test_membership_empty_missing_and_of_gaps(spark, held):
    none = members(spark, [])
    asked = []

    def fetch(days, symbols):
        asked.append((tuple(days), tuple(sorted(r["symbol"] for r in symbols.collect()))))
        return bars(spark, range(1000, 1006), symbols=("A", "B", "C", "D"))

    done = ingest.ingest_day(held, none, day(1006), bars(spark, [1006], symbols=("A", "Z")), fetch=fetch, least=1, strict=False, most_days=9)
    wanted = [d for d in range(1000, 1006) if (DAY0 + dt.timedelta(d)).weekday() < 5]
    assert asked == [(tuple(map(day, wanted)), ("A", "B", "C"))]  # no members then: all known symbols
    assert done["new_symbols"] == 2 and done["backfilled_days"] == len(wanted) and done["backfilled_rows"] == 3 * len(wanted)
    with pytest.raises(ingest.Halted, match="no members"):
        ingest.ingest_day(held, members(spark, [5]), day(1007), bars(spark, [1007]), least=1)
    with pytest.raises(ingest.Halted, match="no bars"):
        ingest.ingest_day(held, none, day(1007), bars(spark, [5]), least=1)


def test_of_two_writers_one_fails(spark, held):
    base = held.current()
    one, _ = held.stage(bars(spark, [973], price=1.0))
    two, _ = held.stage(bars(spark, [973], price=2.0))
    held.commit(one, base)
    with pytest.raises(store.Conflict):
        held.commit(two, base)
    assert {r["close"] for r in held.read(days=[day(973)]).collect()} == {1.0}


def test_an_empty_store(spark, tmp_path):
    empty = store.Store(spark, f"{tmp_path}/none", panel.BARS)
    assert empty.current() == store.Version(0, None) and empty.read().count() == 0
    done = ingest.ingest_day(empty, members(spark, []), day(2), bars(spark, [2]), least=1, strict=False)
    assert done["total_rows"] == 3 and empty.read().count() == 3


def test_state_is_folded_in_any_order_and_needs_no_window(spark):
    rows = bars(spark, range(6)).withColumn("adj_close", F.when(F.dayofmonth("date") != 4, F.col("close") + F.dayofmonth("date")))
    of = lambda a, b: checks.carried(rows.where(F.dayofmonth("date").between(a, b)))
    whole = sorted(checks.carried(rows).collect())
    assert whole == sorted(checks.folded(of(5, 6), of(1, 2), of(3, 4)).collect()) == sorted(checks.folded(checks.folded(of(1, 1), of(4, 6)), of(2, 3)).collect())
    plan = checks.quality_of_day(rows.where(F.col("date") == day(4)), of(1, 4), members(spark, [4]), day(4), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_an_earlier_day_again_carries_the_state_anew(spark, held):
    ingest.ingest_day(held, members(spark, [980]), day(980), bars(spark, [980], price=10.5), least=1, strict=False)
    state = {r["symbol"]: r for r in held.state(checks.CARRIED).collect()}
    assert {str(r["latest"]) for r in state.values()} == {day(999)} and {r["price"]["value"] for r in state.values()} == {10.0}
    assert held.read(days=[day(980)]).first()["close"] == 10.5
