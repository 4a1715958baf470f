"""Backfill of history by key, that a later run goes on with: answers land batch by batch, and what has landed isn't asked again.

    root/answers/source=I/batch=B/   answers (key, body) of one batch of keys from one source, written in one job
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources import vendor

ANSWERS = "key string, body string, source int, batch int"
#: A source: from keys (column key) to their answers (key, body, error).
Source = Callable[[DataFrame], DataFrame]


def landed(spark: SparkSession, root: str) -> DataFrame:
    """All answers so far: key, body, source and batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/answers")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(f"{root}/answers")


def _empty():
    return F.coalesce(F.trim("body"), F.lit("")).isin("", "[]", "{}", "null")


def fetched(root: str, wanted: DataFrame, sources: list[Source], keys_a_batch: int = 500) -> DataFrame:
    """Fetch what is wanted (column key) and hasn't landed; all answers of it, each key's from the first source that has some.

    A key goes to the next source where one gave an empty answer. Answers with an error don't land, so that a later run asks
    again. A run that is killed loses the batch it was at. Batches are dealt out by hash.
    """
    spark, keys = wanted.sparkSession, wanted.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    for i, source in enumerate(sources):
        have = landed(spark, root)
        filled = have.where(~_empty()).select("key")
        todo = keys.join(filled, "key", "left_anti").join(have.where(F.col("source") == i).select("key"), "key", "left_anti")
        batches = max(1, -(-todo.count() // keys_a_batch))
        first = (have.where(F.col("source") == i).agg(F.max("batch")).first()[0] or 0) + 1
        part = todo.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(batches)))
        for b in range(batches):
            own = part.where(F.col("part") == b).select("key")
            if own.isEmpty():
                continue
            # the keys that are asked are settled before their answers come to lie among what todo reads
            path = f"{root}/asked/source={i}/batch={first + b}"
            own.write.mode("overwrite").parquet(path)
            got = source(spark.read.schema("key string").parquet(path))
            got.where("error is null").select("key", "body").write.mode("overwrite").parquet(f"{root}/answers/source={i}/batch={first + b}")
    have = landed(spark, root).join(keys, "key", "left_semi")
    # which answer counts is settled without the bodies; theirs are then dealt out once, by key
    have = have.where(~_empty())
    best = have.groupBy("key").agg(F.min(F.struct("source", "batch")).alias("f"))
    own = have.join(best, "key").where(F.struct("source", "batch") <= F.col("f"))
    return own.groupBy("key", F.col("f.source").alias("source")).agg(F.min("body").alias("body")).select("key", "body", "source")


def bars(answers: DataFrame) -> DataFrame:
    """Daily bars of the answers, one for each date and symbol, those without a close left out."""
    return vendor.history(answers).where("close is not null").dropDuplicates(["date", "symbol"])


def summary(wanted: DataFrame, rows: DataFrame, sample: int = 25) -> DataFrame:
    """symbols_requested, symbols_with_data, rows, date_min, date_max and some symbols without data, by name."""
    asked = wanted.select(F.upper("key").alias("symbol")).distinct()
    none = asked.join(rows.select("symbol").distinct(), "symbol", "left_anti").orderBy("symbol").limit(sample).agg(F.array_sort(F.collect_list("symbol")).alias("symbols_without_data_sample"))
    one = rows.agg(F.countDistinct("symbol").alias("symbols_with_data"), F.count("*").alias("rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return asked.agg(F.count("*").alias("symbols_requested")).join(F.broadcast(one)).join(F.broadcast(none))
