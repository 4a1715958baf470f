"""Picking files of a folder by what the file system says of them, before any is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, bytes) of the files in a folder, and in folders below it, whose names fit; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def latest(spark: SparkSession, folder: str, pattern: str = "*", by: str = "path") -> str | None:
    """The file that is last by path, name or time of modification (ties: by path); None where none fits or there is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return listed(spark, folder, pattern).agg(F.max(F.struct(by, F.col("path").alias("at")))["at"]).first()[0]


def latest_json(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str, by: str = "path", lines: bool = False) -> DataFrame:
    """The rows of the latest JSON file alone, one object in all or one a line; none where there is no file or no JSON in it."""
    path = latest(spark, folder, pattern, by)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(path)
