"""Point-in-time membership, interval joins, as-of lookups and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded(constituents: DataFrame, calendar: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row (date, symbol, permno) for each trading day of each interval (code, start_date, end_date); open bounds are start and end.

    Each interval becomes a sequence of days that meets the calendar by an equality, so that no range join is planned.
    Of intervals that overlap, the one that starts last counts. Intervals are few but make thousands of rows each, so that
    they are dealt out to a fixed number of tasks first.
    """
    rows = constituents.select("code", "permno", F.greatest(F.coalesce("start_date", start), start).alias("lo"), F.least(F.coalesce("end_date", end), end).alias("hi")).where("lo <= hi")
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "code")
    days = rows.select(F.upper("code").alias("symbol"), "permno", "lo", F.explode(F.sequence("lo", "hi")).alias("date")).join(calendar.select("date"), "date", "left_semi")
    return days.groupBy("date", "symbol").agg(F.max(F.struct("lo", "permno")).alias("m")).select("date", "symbol", F.col("m.permno").alias("permno"), F.lit(True).alias("active"))


def flagged(rows: DataFrame, constituents: DataFrame, start: Column, end: Column) -> DataFrame:
    """rows (date, symbol, ...) with active: whether the symbol is a member on that date, from its intervals side by side. Rows that
    lie by symbol stay where they are."""
    lo, hi = F.greatest(F.coalesce("start_date", start), start), F.least(F.coalesce("end_date", end), end)
    spans = constituents.groupBy(F.upper("code").alias("barloom_code")).agg(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("barloom_spans"))
    inside = F.exists("barloom_spans", lambda s: F.col("date").between(s["lo"], s["hi"]))
    return rows.join(spans, F.col("symbol") == F.col("barloom_code"), "left").withColumn("active", F.coalesce(inside, F.lit(False))).drop("barloom_code", "barloom_spans")


def while_members(rows: DataFrame, constituents: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows (date, symbol, ...) of symbols that are members on their date, from the intervals themselves: as many rows as
    intervals meet them by symbol, where expanded() would make one for each day."""
    lo, hi = F.greatest(F.coalesce("start_date", start), start), F.least(F.coalesce("end_date", end), end)
    spans = constituents.select(F.upper("code").alias("barloom_code"), lo.alias("barloom_lo"), hi.alias("barloom_hi"))
    return rows.join(spans, (F.col("symbol") == F.col("barloom_code")) & F.col("date").between(F.col("barloom_lo"), F.col("barloom_hi")), "left_semi")


#: Names that a snapshot's columns may have.
SNAPSHOT = {"code": ("Symbol", "Ticker", "Code"), "name": ("Security", "Company", "Name"), "sector": ("GICS Sector", "Sector"), "industry": ("GICS Sub-Industry", "Sub-Industry", "Sub Industry", "Industry")}


def snapshot(rows: DataFrame, order: Column) -> DataFrame:
    """code, exchange, name, sector and industry of a list of constituents under any of the names in SNAPSHOT; of rows of one
    code, written with a dash for class shares, the first in order counts. Without a column of codes that is an error."""
    have = {n: next((F.col(f"`{c}`") for c in names if c in rows.columns), None) for n, names in SNAPSHOT.items()}
    if have["code"] is None:
        raise ValueError("a snapshot needs a column of symbols or tickers")
    code = F.replace(F.trim(F.upper(have["code"])), F.lit("."), F.lit("-"))
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    plain = rows.select(order.alias("place"), code.alias("code"), *(text(have[n]).alias(n) for n in ("name", "sector", "industry"))).where("code is not null")
    if have["name"] is None:
        plain = plain.withColumn("name", F.col("code"))
    first = plain.groupBy("code").agg(F.min(F.struct("place", "name", "sector", "industry")).alias("f"))
    return first.select("code", F.lit("US").alias("exchange"), "f.name", "f.sector", "f.industry")


def constant_membership(snapshot: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol of a snapshot on every day, with class shares written with a dash."""
    symbols = snapshot.select(F.replace(F.upper(F.trim("symbol")), F.lit("."), F.lit("-")).alias("symbol")).distinct()
    days = calendar.agg(F.sort_array(F.collect_set("date")).alias("days"))
    return symbols.join(F.broadcast(days)).select(F.explode("days").alias("date"), "symbol", F.lit(True).alias("active"))


def point_in_interval(facts: DataFrame, names: DataFrame, key: str, at: str = "date") -> DataFrame:
    """facts with the interval (key, start, end) that holds their date, or nulls; an open end holds all later dates."""
    n = names.withColumnRenamed(key, "barloom_key")
    inside = (F.col(key) == F.col("barloom_key")) & F.col(at).between(F.col("start"), F.coalesce("end", F.lit("9999-12-31").cast("date")))
    return facts.join(n, inside, "left").drop("barloom_key")


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals of one key that overlap, with their common part; columns of b are prefixed with other_."""
    right = b.select(*(F.col(c).alias(c if c == key else f"other_{c}") for c in b.columns))
    far = F.lit("9999-12-31").cast("date")
    lo, hi = F.greatest("start", "other_start"), F.least(F.coalesce("end", far), F.coalesce("other_end", far))
    return a.join(right, key).withColumns({"common_start": lo, "common_end": hi}).where("common_start <= common_end")


def ticker_changes(names: DataFrame) -> DataFrame:
    """(permno, old_symbol, new_symbol, effective_date) wherever a security's name differs from the one before."""
    w = Window.partitionBy("permno").orderBy("start")
    return names.where("symbol <> ''").withColumn("old_symbol", F.lag("symbol").over(w)).where("old_symbol <> symbol").select("permno", "old_symbol", F.col("symbol").alias("new_symbol"), F.col("start").alias("effective_date")).distinct()


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the latest value of right at or before its time, by a union and one window: no range join."""
    none = F.lit(None)
    both = left.select(*keys, at, none.cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(*keys, at, value, F.lit(0).alias("side")))
    w = Window.partitionBy(*keys).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("side") == 0, F.col(value)), ignorenulls=True).over(w)).where("side = 1").drop("side")


def nearest_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the earliest value of right at or after its time, in the way of as_of()."""
    both = left.select(*keys, at, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(0).alias("side")).unionByName(right.select(*keys, at, value, F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)  # backwards, since a frame that ends with the last row is gone over for each row
    return both.withColumn(value, F.last(F.when(F.col("side") == 1, F.col(value)), ignorenulls=True).over(w)).where("side = 0").drop("side")


def renamed(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """members with symbols by the latest name: mapping (old_symbol, new_symbol) is followed once, without regard to case."""
    m = mapping.where("old_symbol is not null and new_symbol is not null").groupBy(F.upper("old_symbol").alias("symbol")).agg(F.max(F.upper("new_symbol")).alias("barloom_new"))
    rows = members.join(F.broadcast(m), "symbol", "left")
    return rows.withColumn("symbol", F.coalesce("barloom_new", "symbol")).select(members.columns)


def ticker_mapping(table: DataFrame) -> DataFrame:
    """old_symbol and new_symbol of a table that has them under one of their usual names, else an empty mapping."""
    pick = lambda names: next((c for c in names if c in table.columns), None)
    old, new = pick(["old_symbol", "from_symbol", "old", "symbol_old"]), pick(["new_symbol", "to_symbol", "new", "symbol_new"])
    if old is None or new is None:
        return table.sparkSession.createDataFrame([], "old_symbol string, new_symbol string")
    return table.select(F.upper(old).alias("old_symbol"), F.upper(new).alias("new_symbol"))


def listed(members: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """date and its sorted members, for dates of a range (either end may be open)."""
    rows = members.where("active")
    rows = rows if start is None else rows.where(F.col("date") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.where(F.col("date") <= F.lit(end).cast("date"))
    return rows.groupBy("date").agg(F.sort_array(F.collect_set("symbol")).alias("members"))


def shifted(calendar: DataFrame, n: int) -> DataFrame:
    """Each trading day with the day n trading days later."""
    return calendar.select("date", F.lead("date", n).over(Window.orderBy("date")).alias("shifted"))


def coverage(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Members and members with a bar by date."""
    has = bars.select("date", "symbol").distinct().withColumn("has_bar", F.lit(True))
    rows = members.select("date", "symbol").join(has, ["date", "symbol"], "left")
    return rows.groupBy("date").agg(F.count("*").alias("members"), F.count("has_bar").alias("covered")).withColumn("ratio", F.try_divide("covered", "members"))


def validated(members: DataFrame, least: int, most: int) -> DataFrame:
    """Days, least and most members over days, and days outside the bounds, in one row."""
    by_day = members.where("active").groupBy("date").agg(F.countDistinct("symbol").alias("n"))
    return by_day.agg(F.count("*").alias("days"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(~F.col("n").between(least, most)).alias("violations"))


def mask(members: DataFrame, symbols: list[str]) -> DataFrame:
    """A row for each date and a boolean column for each of the given symbols."""
    wide = members.where(F.col("symbol").isin(symbols)).groupBy("date").pivot("symbol", symbols).agg(F.lit(True))
    return wide.select("date", *(F.coalesce(F.col(f"`{s}`"), F.lit(False)).alias(s) for s in symbols))


def summary(members: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: rows, symbols, first and last date, and the least and most members of a date, over a range of dates."""
    rows = members.where("active")
    rows = rows if start is None else rows.where(F.col("date") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.where(F.col("date") <= F.lit(end).cast("date"))
    by = rows.groupBy("date").agg(F.countDistinct("symbol").alias("n")).agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.coalesce(F.min("n"), F.lit(0)).alias("min_members"), F.coalesce(F.max("n"), F.lit(0)).alias("max_members"))
    return rows.agg(F.count("*").alias("membership_rows"), F.countDistinct("symbol").alias("unique_symbols")).join(F.broadcast(by))
