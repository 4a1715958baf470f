"""Streaming variants of the daily panel: bars of a day, keep-latest upserts and the equity monitor.

A stream reads a table's files as they come. Results are written batch by batch to a folder that driver and executors
share, each with its batch's number, and read back with the newest batch winning; a batch that is run again after a
failure overwrites its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.metrics import monitored
from barloom.sources.session import shared_folder

MICRO = 1_000_000


def stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The table `name` of a folder, a file or a folder itself, as a stream of its files; timestamps without a zone are UTC."""
    schema, zone = spark.read.parquet(f"{folder}/{name}.parquet").schema, spark.conf.get("spark.sql.session.timeZone")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parquet*")
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(c)).cast("timestamp")
    return rows.withColumns({f.name: local(f.name) for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def live_bars(events: DataFrame, late: str | None = "3 days") -> DataFrame:
    """date, symbol and first, greatest, least and last value of each day (UTC); rows later than `late` are left out.

    With late = None none is, and the days' state is kept: files of a finished table come in any order of time.
    """
    at = F.struct("ts", "event_id", "value")
    days = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("symbol"))
    rows = days.agg(F.min(at).alias("a"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(at).alias("z"), F.count("*").alias("n"))
    return rows.select(F.date_from_unix_date((F.unix_seconds("w.start") / 86400).cast("int")).alias("date"), "symbol", F.col("a.value").alias("open"), "high", "low", F.col("z.value").alias("close"), "n")


def unrepeated(events: DataFrame, key: str = "event_id", late: str = "3 days") -> DataFrame:
    """events with one row of each key; a key is forgotten once the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(df: DataFrame, mode: str = "update") -> DataFrame:
    """All batches of what a stream has now, as a table with column batch."""
    spark = df.sparkSession
    out = shared_folder(spark, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of each key those of the newest batch."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return batches.withColumn("barloom_rank", rank).where("barloom_rank = 1").drop("barloom_rank", "batch")


def micros(value: Column) -> Column:
    """Millionths as a whole number, which adds up alike in any order; null counts as none."""
    return F.coalesce(F.floor(value * float(MICRO) + 0.5), F.lit(0)).cast("long")


def monitored_entries(entries: DataFrame, start: float = 1000.0) -> DataFrame:
    """user_id, event_id and halt level after each entry, as monitor_stream() has it, of a stream that is read to its end.

    The entries of all batches are put in the order of their ids first, so that it does not matter how they lie in files.
    """
    rows = run_to_end(entries.select("user_id", "event_id", micros(F.col("value")).alias("micros")), "append")
    at = F.col("event_id").asc_nulls_last()
    so_far = Window.partitionBy("user_id").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    log = rows.select("user_id", "event_id", (F.lit(int(start * MICRO)) + F.sum("micros").over(so_far)).alias("equity"))
    return monitored(log, "user_id", at, "equity").select("user_id", "event_id", "level")


def monitor_stream(entries: DataFrame, start: float = 1000.0, max_drawdown: float = 0.10, max_loss: float = 0.03, least_entries: int = 5) -> DataFrame:
    """user_id, event_id and halt level after each entry (user_id, event_id, value) of an account that begins with `start`.

    What is kept for an account is four numbers. The entries of a batch are taken in the order of their ids; how many
    come at once is set by the stream's files per batch. For a finished table, whose ids may lie in files in any order,
    see monitored_entries().
    """
    first = int(start * MICRO)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, seen = state.get if state.exists else (first, 0, 0)
        rows = pd.concat(list(parts)).sort_values("event_id")
        levels = []
        for change in rows["micros"]:
            before, equity, seen = equity, equity + int(change), seen + 1
            peak = equity if seen == 1 else max(peak, equity)
            fallen = peak != 0 and 1 - equity / peak > max_drawdown and seen > least_entries
            lost = seen > 1 and before != 0 and 1 - equity / before > max_loss
            levels.append(2 if fallen else 1 if lost else 0)
        state.update((equity, peak, seen))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "level": levels})

    rows = entries.select("user_id", "event_id", micros(F.col("value")).alias("micros")).where("user_id is not null and event_id is not null")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, level int", "equity long, peak long, seen long", "append", GroupStateTimeout.NoTimeout)
