"""Vendors' JSON: a Spark data source that fetches answers over HTTP, and their parsing with DataFrame functions.

    spark.dataSource.register(HttpJson)
    raw = spark.read.format("http_json").option("url", "https://host/eod/{key}?from=2024-01-01").option("keys", "A,B").load()
    history(raw)

An answer is one row (key, body, error); what is in it is told by from_json under a given schema, on the executors.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.functions.columns import number
from barloom.sources.panel import BARS, conform

#: Statuses worth another try.
RETRIED = (429, 500, 502, 503, 504)


class Pace:
    """At most `calls` calls in any span of `span` seconds; wait() returns when the next may be made."""

    def __init__(self, calls: int, span: float = 60.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.calls, self.span, self.clock, self.sleep = calls, span, clock, sleep
        self.made: deque[float] = deque()

    def wait(self) -> None:
        while len(self.made) >= self.calls:
            due = self.made[0] + self.span - self.clock()
            if due > 0:
                self.sleep(due)
            self.made.popleft()
        self.made.append(self.clock())


def fetched(url: str, pace: Pace, retries: int = 4, timeout: float = 30.0, sleep: Callable = time.sleep) -> str:
    """The JSON text at a URL; busy servers, lost connections and broken JSON are tried again, at doubling distances up to 30 s."""
    for turn in range(retries + 1):
        pace.wait()
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                body = answer.read().decode()
            json.loads(body)
            return body
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or turn == retries:
                raise
        except (urllib.error.URLError, ValueError, TimeoutError):
            if turn == retries:
                raise
        sleep(min(2.0**turn, 30.0))
    raise AssertionError


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.keys = [k for k in options["keys"].split(",") if k]
        self.tasks = max(1, min(int(options.get("tasks", "4")), len(self.keys) or 1))
        self.calls = int(options.get("callsperminute", options.get("callsPerMinute", "500")))
        self.retries = int(options.get("retries", "4"))

    def partitions(self) -> list[InputPartition]:
        return [_Keys(self.keys[i :: self.tasks]) for i in range(self.tasks)]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        pace = Pace(max(1, self.calls // self.tasks))
        for key in partition.keys:
            try:
                yield key, fetched(self.url.replace("{key}", urllib.parse.quote(key)), pace, self.retries), None
            except (urllib.error.URLError, ValueError, TimeoutError) as e:
                yield key, None, str(e)


class HttpJson(DataSource):
    """Options: url with {key}, keys (comma-separated), tasks, callsPerMinute (over all tasks), retries.

    A key whose calls all fail gives a row with an error instead of failing its task. Write the rows to a table to keep
    them as a cache: Spark may read a source more than once.
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "key string, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listing(symbol: Column, exchange: str = "US") -> Column:
    """A symbol as vendors name it, SYMBOL.EXCHANGE; one that has an exchange keeps it."""
    name = F.upper(F.trim(symbol))
    return F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(f".{exchange}")))


PRICES = "open string, high string, low string, close string, adjusted_close string, volume string"


def _answers(raw: DataFrame, of: str) -> DataFrame:
    """key and a struct `a` for each object of the answers; broken and missing bodies give none."""
    return raw.select("key", F.explode(F.from_json("body", f"array<struct<{of}>>")).alias("a"))


def history(raw: DataFrame) -> DataFrame:
    """Daily bars from answers [{date, open, ..., adjusted_close, volume}], the key being the symbol."""
    rows = _answers(raw, f"date: string, {_typed(PRICES)}").select(F.col("key").alias("symbol"), "a.*")
    return conform(rows.withColumnRenamed("adjusted_close", "adj_close"), BARS)


def bulk_day(raw: DataFrame) -> DataFrame:
    """Bars of one day from answers [{code, date, open, ...}]."""
    rows = _answers(raw, f"code: string, date: string, {_typed(PRICES)}").select("a.*")
    return conform(rows.withColumnsRenamed({"code": "symbol", "adjusted_close": "adj_close"}), BARS)


def splits(raw: DataFrame) -> DataFrame:
    """symbol, date and split (as written) from answers [{date, split}]."""
    return _answers(raw, "date: string, split: string").select(F.upper("key").alias("symbol"), F.col("a.date").try_cast("date").alias("date"), "a.split").where("date is not null")


def dividends(raw: DataFrame) -> DataFrame:
    """symbol, date and value from answers [{date, value}]."""
    return _answers(raw, "date: string, value: string").select(F.upper("key").alias("symbol"), F.col("a.date").try_cast("date").alias("date"), number(F.col("a.value")).alias("value")).where("date is not null")


def listed_symbols(raw: DataFrame) -> DataFrame:
    """exchange (the key), symbol and name from answers [{Code, Name}]: all or delisted symbols of an exchange."""
    return _answers(raw, "Code: string, Name: string").select(F.col("key").alias("exchange"), F.upper("a.Code").alias("symbol"), F.col("a.Name").alias("name")).where("symbol is not null")


def members(raw: DataFrame, keys: tuple = ("HistoricalTickerComponents", "Components")) -> DataFrame:
    """code, name, start_date, end_date and active from an answer that holds them, by position or name, under one of `keys`."""
    of = "struct<Code: string, Name: string, StartDate: string, EndDate: string, IsActiveNow: string>"
    body = F.from_json("body", ", ".join(f"`{k}` map<string, {of}>" for k in keys), {"mode": "PERMISSIVE"})
    lists = F.from_json("body", ", ".join(f"`{k}` array<{of}>" for k in keys), {"mode": "PERMISSIVE"})
    rows = F.coalesce(*(F.coalesce(F.map_values(body[k]), lists[k]) for k in keys), F.from_json("body", f"array<{of}>"))
    day = lambda c: F.col(c).try_cast("date")
    flat = raw.select(F.explode(rows).alias("a"))
    active = F.lower("a.IsActiveNow").isin("1", "true")
    return flat.select(F.upper("a.Code").alias("code"), F.col("a.Name").alias("name"), day("a.StartDate").alias("start_date"), day("a.EndDate").alias("end_date"), active.alias("active")).where("code is not null")


def _typed(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(","))


def first_filled(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first of several sources that gives rows, else an empty one; the last error only where none gives a table."""
    error, empty = None, None
    for source in sources:
        try:
            df = source()
            if not df.isEmpty():
                return df
            empty = df if empty is None else empty
        except Exception as e:  # noqa: BLE001  whatever a source fails with, the next is asked
            error = e
    if empty is None:
        raise error or ValueError("no source")
    return empty


def price_sign_repaired(price: Column, factor: Column) -> tuple[Column, Column]:
    """close and adj_close of a price whose sign marks a quote's middle, and of its split factor (null and 0: none)."""
    close = F.abs(price)
    return close, F.when(F.coalesce(factor, F.lit(0.0)) == 0, close).otherwise(F.try_divide(close, F.abs(factor)))
