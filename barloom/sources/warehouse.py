"""Bars and constituents from a warehouse of securities: daily prices by security number, and names that hold for a time.

Tables come as DataFrames, from JDBC (`table`) or anywhere else; joins and cleaning are one plan over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import SIC_SECTORS, code_sector, number
from barloom.operators.membership import overlaps, point_in_interval
from barloom.sources.vendor import price_sign_repaired

#: Where prices, names and members are looked for (library, table), the first that is there.
DAILY = [("crsp", "dsf_v2"), ("crsp", "dsf")]
NAMES = [("crsp", "stocknames_v2"), ("crsp", "stocknames"), ("crsp", "msenames")]
MEMBERS = [("crsp_a_indexes", "dsp500list_v2"), ("crsp_a_indexes", "dsp500list"), ("crsp_q_indexes", "dsp500list_v2"), ("crsp_q_indexes", "dsp500list"), ("crsp", "dsp500list_v2"), ("crsp", "dsp500list")]


def table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A warehouse table over JDBC; with a column and its bounds it is read in so many parts side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def found(catalog: DataFrame, wanted: list[tuple[str, str]], like: str | None = None) -> tuple[str, str, set[str]] | None:
    """Library, table and columns of the first wanted table in a catalog (library, table, column); else of one whose name fits `like`."""
    order = F.coalesce(*(F.when((F.col("library") == a) & (F.col("table") == b), F.lit(i)) for i, (a, b) in enumerate(wanted)))
    fits = F.when(F.col("table").rlike(like), len(wanted)) if like else F.lit(None).cast("int")
    tables = catalog.withColumn("place", F.coalesce(order, fits)).where("place is not null").groupBy("place", "library", "table").agg(F.collect_set(F.lower("column")).alias("columns"))
    first = tables.orderBy("place", "library", "table").first()
    return None if first is None else (first["library"], first["table"], set(first["columns"]))


def symbol_or(ticker: Column, fallback: Column) -> Column:
    """A ticker in capitals; the fallback where it is null, blank or what missing values are written as."""
    named = F.upper(F.trim(ticker))
    return F.when(named.isNotNull() & ~named.isin("", "NAN", "NONE"), named).otherwise(F.upper(fallback))


def history(daily: DataFrame, names: DataFrame, start: str, end: str | None = None, symbols: list[str] | None = None, fallback: Column | None = None) -> DataFrame:
    """date, symbol, prices, volume and permno of securities between two dates, by the name that held on each date.

    daily: permno, date, open, high, low, price, volume, factor. names: permno, name, start, end. A price below 0 is the
    middle of a quote; adj_close is the price over its split factor. Rows without a symbol are left out.
    """
    day = F.col("date").try_cast("date")
    rows = daily if dict(daily.dtypes)["date"] == "date" else daily.withColumn("date", day)
    rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    rows = rows if end is None else rows.where(F.col("date") <= F.lit(end).cast("date"))
    named = point_in_interval(rows, names.select("permno", "name", "start", "end"), "permno")
    symbol = symbol_or(F.col("name"), F.lit(None).cast("string") if fallback is None else fallback)
    close, adjusted = price_sign_repaired(number(F.col("price")), number(F.col("factor")))
    plain = [F.abs(number(F.col(c))).alias(c) for c in ("open", "high", "low")]
    out = named.select("date", symbol.alias("symbol"), *plain, close.alias("close"), adjusted.alias("adj_close"), number(F.col("volume")).alias("volume"), F.col("permno").cast("long").alias("permno")).where("symbol is not null")
    return out.where(F.col("symbol").isin([s.upper() for s in symbols])) if symbols else out


def laid_out(df: DataFrame, name: str, path: str, buckets: int = 64, order: str = "date") -> DataFrame:
    """df as a table in buckets by permno, sorted inside: two such tables of one number of buckets join without a shuffle, and
    a filter on permno reads its buckets only. The table is kept at path, and by its name in the session's catalog."""
    df.withColumn("permno", F.col("permno").cast("long")).write.bucketBy(buckets, "permno").sortBy("permno", order).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def resolved(names: DataFrame, requests: DataFrame) -> tuple[list[int], list[str] | None]:
    """Security numbers of requests (symbol, permno), and the symbols to keep, None for all.

    Where any request has a number, the numbers count and symbols don't. Else numbers are those that ever had one of the
    symbols as a name. What comes to the driver is as long as the request.
    """
    asked = requests.select(F.col("permno").cast("long").alias("permno"), F.upper(F.trim("symbol")).alias("symbol")).distinct()
    numbers = sorted(r[0] for r in asked.where("permno is not null").select("permno").distinct().collect())
    if numbers:
        return numbers, None
    held = names.select(F.col("permno").cast("long").alias("permno"), F.upper(F.trim("name")).alias("symbol")).join(F.broadcast(asked.select("symbol").distinct()), "symbol", "left_semi")
    return sorted(r[0] for r in held.select("permno").distinct().collect()), [r[0] for r in asked.select("symbol").distinct().collect()]


def batch(daily: DataFrame, names: DataFrame, requests: DataFrame, start: str = "1900-01-01", end: str | None = None) -> DataFrame:
    """history() of the requested securities: their numbers are known before prices are read, and go to both scans."""
    numbers, symbols = resolved(names, requests)
    own = F.col("permno").isin(numbers) if numbers else F.lit(False)
    return history(daily.where(own), names.where(own), start, end, symbols, F.col("permno").cast("string"))


def one_day(daily: DataFrame, names: DataFrame, day: str) -> DataFrame:
    """history() of all securities on one day."""
    return history(daily, names, day, day, fallback=F.col("permno").cast("string"))


def constituents(members: DataFrame, names: DataFrame, today: str) -> DataFrame:
    """code, exchange, name, sector, industry, start_date, end_date, active and permno of every name a member had while it was one.

    members: permno, start, end; names: permno, name, company, sic, start, end. Open ends hold for ever.
    """
    both = overlaps(members.select("permno", "start", "end"), names.where(F.trim("name") != ""), "permno")
    sic = F.col("other_sic").try_cast("double").try_cast("int")
    code = F.upper(F.trim("other_name"))
    return both.select(
        code.alias("code"), F.lit("US").alias("exchange"), F.coalesce("other_company", code).alias("name"), code_sector(F.col("other_sic"), SIC_SECTORS).alias("sector"),
        F.coalesce(F.concat(F.lit("SIC "), sic.cast("string")), F.lit("Unknown")).alias("industry"), F.col("common_start").alias("start_date"), F.col("common_end").alias("end_date"),
        (F.col("common_end") >= F.lit(today).cast("date")).alias("active"), F.col("permno").cast("long").alias("permno"),
    ).distinct()
