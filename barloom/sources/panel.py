"""Tables of the daily panel, derived from order lines, and reading and writing of tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import number

#: What opens a table of a folder: table() or tables().
Read = Callable[[SparkSession, str, str], DataFrame]

BARS = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume", "dollar_volume"))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables() -> Read:
    """table() for a query that meets the same tables in many places: each is opened once, which takes a job of its own."""
    return functools.cache(table)


def scan(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A Parquet or CSV table (by suffix) under a given schema; where there is none an empty table, or an error if it is required."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType, required: tuple = ("date", "symbol", "close")) -> DataFrame:
    """df under a schema: missing required columns raise, other missing ones are derived or null, bad values become null.

    Symbols are upper-cased, adj_close defaults to close, and dollar_volume to close times volume (0 without volume).
    Rows without a date or symbol are dropped.
    """
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {lacking}")
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    if "dollar_volume" not in df.columns:
        volume = F.coalesce(number(F.col("volume")), F.lit(0.0)) if "volume" in df.columns else F.lit(0.0)
        df = df.withColumn("dollar_volume", number(F.col("close")) * volume)

    def read(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if f.name == "symbol":
            c = F.upper(c)
        elif isinstance(f.dataType, T.DateType):
            c = c.try_cast("date")
        elif isinstance(f.dataType, T.DoubleType):
            c = number(c)
        else:
            c = c.try_cast(f.dataType)
        return c.alias(f.name)

    return df.select(*(read(f) for f in schema)).where("date is not null and symbol is not null")


def bars(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    """Daily bars by supplier: prices per unit, the first line of the day as open, the volume-weighted mean as close.

    Lines are dealt out by symbol once, before they are added up (hardly two share a symbol and date), so that windows by
    symbol need neither a shuffle nor a sort of their own.
    """
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 0").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    exact = lambda c, scale: F.sum(F.col(c).cast(f"decimal(18,{scale})")).cast("double")
    lines = lines.select(F.upper("s_name").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    day = lines.repartition("symbol").groupBy("symbol", "date").agg(
        first.alias("first"), F.max(price).alias("high"), F.min(price).alias("low"), exact("l_quantity", 2).alias("volume"), exact("l_extendedprice", 2).alias("dollar_volume"), (exact("l_discount", 4) / F.count("*")).alias("discount")
    )
    close = F.col("dollar_volume") / F.col("volume")
    return day.select("date", "symbol", (F.col("first.l_extendedprice") / F.col("first.l_quantity")).alias("open"), "high", "low", close.alias("close"), (close * (1 - F.col("discount"))).alias("adj_close"), "volume", "dollar_volume")


def latest(spark: SparkSession, sf_dir: str):
    """The last date with bars."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return lines.agg(F.to_date(F.max("l_shipdate"))).first()[0]


def sectors(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    """A row for each symbol: the region of its supplier as sector, the nation as industry."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.upper("s_name").alias("symbol")).agg(F.min(F.struct("s_suppkey", "r_name", "n_name")).alias("f")).select("symbol", F.col("f.r_name").alias("sector"), F.col("f.n_name").alias("industry"))


def trading_days(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    """date of every trading day, in no order."""
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).where("date is not null").distinct()


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days with their index from 0; days are few whatever the input, so that one task may number them."""
    return trading_days(spark, sf_dir).select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("idx"))


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mondays to Fridays from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def constituents(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    """Membership intervals: each symbol from its first to its last ship date; every seventh has an open end, every fifth leaves by 2000."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    sold = lines.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    spans = sold.groupBy("s_suppkey", F.upper("s_name").alias("code")).agg(F.min(F.to_date("lo")).alias("start_date"), F.max(F.to_date("hi")).alias("last_date"))
    return spans.select("code", "start_date", F.when(F.col("s_suppkey") % 7 != 0, F.when(F.col("s_suppkey") % 5 == 0, F.least("last_date", F.lit("2000-12-31").cast("date"))).otherwise(F.col("last_date"))).alias("end_date"), F.col("s_suppkey").cast("long").alias("permno"))


def upserted(old: DataFrame, new: DataFrame, keys: tuple = ("date", "symbol")) -> DataFrame:
    """Union of both, one row for each key: new over old; of rows that are equally new, the greatest by their other columns."""
    both = old.withColumn("barloom_order", F.lit(0)).unionByName(new.withColumn("barloom_order", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in both.columns if c not in (*keys, "barloom_order")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("barloom_order"), *rest))
    return both.withColumn("barloom_rank", rank).where("barloom_rank = 1").drop("barloom_rank", "barloom_order")


def publish(df: DataFrame, path: str) -> str:
    """Write a table as Parquet, to a path that the same job doesn't read."""
    df.write.mode("overwrite").parquet(path)
    return path
