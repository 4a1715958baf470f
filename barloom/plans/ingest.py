"""Daily ingest: the gap before a day, its bars and those between, merged and published only if the checks pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import checks
from barloom.sources.panel import publish, upserted
from barloom.sources.session import shared_folder
from barloom.sources.sessions import is_weekday
from barloom.sources.store import Store

#: Bars of missing days: from days and symbols (column symbol) wanted.
Fetch = Callable[[list[str], DataFrame], DataFrame]
#: Whether a date is one on which bars are due.
Session = Callable[[Column], Column]


class Halted(RuntimeError):
    """The checks forbid to go on."""


@dataclass(frozen=True)
class Ingested:
    bars: DataFrame
    checks: DataFrame
    days: list[str]


def weekdays_after(latest: DataFrame, day: str, session: Session = is_weekday) -> list[str]:
    """Weekdays (or other sessions) after a date (one row: latest) up to `day`; none where latest is null."""
    days = latest.where("latest is not null").select(F.explode(F.sequence(F.col("latest"), F.greatest(F.lit(day).cast("date"), F.col("latest")))).alias("date"), "latest")
    return [str(r[0]) for r in days.where((F.col("date") > F.col("latest")) & session(F.col("date"))).select("date").orderBy("date").collect()]


def missing_days(bars: DataFrame, day: str, most: int | None = None) -> list[str]:
    """Weekdays after the latest bar and before `day`; more than `most` weekdays up to the day itself halt."""
    return _between(weekdays_after(bars.agg(F.max("date").alias("latest")), day), day, most)


def _between(gap: list[str], day: str, most: int | None) -> list[str]:
    if most is not None and len(gap) > most:
        raise Halted(f"{len(gap)} weekdays are missing up to {day}")
    return [d for d in gap if d < day]


def taken(known: DataFrame, members: DataFrame, day: str, days: list[str], new: DataFrame, fetch: Fetch | None, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The bars of `day`, and those of the missing days before it, that count.

    Of the day, members' bars count; a membership table without rows filters nothing, one without members of that day halts.
    On missing days, symbols count that are members on any of them; where there are none, all known ones (column symbol).
    """
    at = F.lit(day).cast("date")
    today = new.where(F.col("date") == at).select(columns)
    active = members.where("active").select("date", F.upper("symbol").alias("symbol"))
    if not members.isEmpty():
        of_day = active.where(F.col("date") == at).select("symbol").distinct()
        if of_day.isEmpty():
            raise Halted(f"no members on {day}")
        today = today.join(of_day, "symbol", "left_semi").select(columns)
    if new.where(F.col("date") == at).isEmpty():
        raise Halted(f"no bars of {day}")
    if not days or fetch is None:
        return today, today.limit(0)
    wanted = F.col("date").isin([F.lit(d).cast("date") for d in days])
    symbols = active.where(wanted).select("symbol").distinct()
    symbols = known.select("symbol").distinct() if symbols.isEmpty() else symbols
    return today, fetch(days, symbols).where(wanted).join(symbols, "symbol", "left_semi").select(columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _passed(found: DataFrame, strict: bool) -> DataFrame:
    """The checks, computed once; raises Halted where one forbids to go on."""
    found = stored(found, "checks")
    if failed := [r["check"] for r in found.where(checks.halting(strict)).collect()]:
        raise Halted(f"failed: {', '.join(sorted(failed))}")
    return found


def ingested(bars: DataFrame, members: DataFrame, day: str, new: DataFrame, fetch: Callable[[list[str]], DataFrame] | None = None, least: int = 480, strict: bool = True, most_days: int = 5, warn: int | None = None, explained: tuple[str, ...] = ()) -> Ingested:
    """bars with those of `day` and of the days between; raises Halted where the gap is too long or a check fails.

    fetch gives the bars of missing days. Strict mode halts on any failed check, the other on a stale or incomplete day and
    on too long a gap. Returns of symbols named in `explained` are no outliers.
    """
    days = missing_days(bars, day, most_days)
    today, filled = taken(bars, members, day, days, new, None if fetch is None else lambda days, _: fetch(days), bars.columns)
    whole = upserted(bars, filled.unionByName(today))
    return Ingested(whole, _passed(checks.quality(whole, members, day, least, warn=warn, explained=explained), strict), days)


def ingest(path_in: str, path_out: str, bars: DataFrame, members: DataFrame, day: str, new: DataFrame, **options) -> dict:
    """Publish the merged bars at path_out, which must differ from where they were read, and say what was done."""
    if path_in == path_out:
        raise ValueError("a table can't be replaced while it is read")
    done = ingested(bars, members, day, new, **options)
    publish(done.bars, path_out)
    out = bars.sparkSession.read.schema(done.bars.schema).parquet(path_out)
    one = out.agg(F.count("*").alias("total_rows"), F.countDistinct("symbol").alias("total_symbols"), F.count_if(F.col("date") == F.lit(day).cast("date")).alias("new_rows")).first()
    return {"date": day, "backfilled_days": len(done.days), **one.asDict(), "output": path_out, "quality": [r.asDict() for r in done.checks.collect()]}


def load(store: Store, bars: DataFrame) -> None:
    """Put whole dates of bars in a store, in place of what it holds of them, with the state that checks carry forward."""
    base = store.current()
    name, rows = store.stage(bars)
    state = checks.carried(rows)
    if base.name:
        touched = [r[0] for r in rows.select("date").distinct().collect()]
        rest = store.dates(base).where(~F.col("date").isin(touched)).select("date")
        state = checks.folded(checks.carried(store.read(days=[r[0] for r in rest.collect()], version=base)), state)
    store.commit(name, base, state)


def ingest_day(store: Store, members: DataFrame, day: str, new: DataFrame, fetch: Fetch | None = None, least: int = 480, strict: bool = True, most_days: int = 5, warn: int | None = None, explained: tuple[str, ...] = (), session: Session = is_weekday) -> dict:
    """Ingest a day into a store, and say what was done; raises Halted, and leaves readers the version they had, as ingested().
    Days count as missing if they are sessions: weekdays, or those of an exchange (sessions.is_session).

    Read are the rows of the touched dates and the state by symbol; written are those dates' partitions. Only a day before
    the store's latest makes the state be carried anew from the dates before it.
    """
    base = store.current()
    held = store.dates(base)
    latest = held.agg(F.max("date").alias("latest"))
    last = latest.first()[0]
    days = _between(weekdays_after(latest, day, session), day, most_days)
    state = store.state(checks.CARRIED, base)
    late = last is not None and str(last) >= day
    today, filled = taken(state, members, day, days, new, fetch, store.schema.names)
    more = stored(filled.unionByName(today), "new_bars")
    touched = [r[0] for r in more.select("date").distinct().collect()]
    name, rows = store.stage(upserted(store.read(days=touched, version=base), more))
    try:
        at = F.lit(day).cast("date")
        before = checks.folded(state if not late else checks.carried(store.read(end=day, version=base).where(F.col("date") < at)), checks.carried(rows.where(F.col("date") < at)))
        seen = checks.folded(before, state) if late else before  # the latest date is one of all dates
        carried = before.drop("latest").join(seen.select("symbol", "latest"), "symbol", "right") if late else before
        own = rows.where(F.col("date") == at)
        found = _passed(checks.quality_of_day(own, carried, members, day, least, warn=warn, explained=explained, session=session), strict)
        after = checks.folded(before, checks.carried(own))
        after = checks.folded(after, checks.carried(store.read(start=day, version=base).where(F.col("date") > at))) if late else after
        after = stored(after, "state")
    except BaseException:
        store.discard(name)
        raise
    version = store.commit(name, base, after)
    sizes = store.dates(version).agg(F.sum("rows")).first()[0]
    counts = more.agg(F.count_if(F.col("date") == at).alias("new_rows"), F.countDistinct(F.when(F.col("date") == at, F.col("symbol"))).alias("new_symbols"), F.count_if(F.col("date") != at).alias("backfilled_rows")).first()
    return {"date": day, **counts.asDict(), "backfilled_days": len(days), "total_rows": sizes, "total_symbols": after.count(), "version": version.number, "quality": [r.asDict() for r in found.collect()]}
