"""A panel kept by date: a day's ingest writes that day's partitions, and one commit file makes them count.

    root/rows/version=V/date=D/...   rows of a date, as one version wrote them; never changed afterwards
    root/dates/V, root/state/V       which version holds each date (date, version, rows), and what is carried forward by symbol
    root/commits/000000012           the name of the version that counts from the twelfth commit on

A version is staged (rows written, seen by nobody), then committed or discarded. A commit is the creation of a file that must
not exist yet, so that of two writers who started from the same version one fails; readers keep what they opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many dates are read by their paths; more, by versions that a join with the dates narrows down.
FEW = 200
DATES = "date date, version string, rows long"


class Conflict(RuntimeError):
    """Another version was committed since this one was started."""


@dataclass(frozen=True)
class Version:
    """A version that counts (number, name), or the state before any (0, None)."""

    number: int
    name: str | None


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        """schema: of the rows, with a column date."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> Version:
        files, folder = self._path("commits")
        if not files.exists(folder):
            return Version(0, None)
        for name in sorted((str(f.getPath().getName()) for f in files.listStatus(folder) if str(f.getPath().getName()).isdigit()), reverse=True):
            if said := [r[0] for r in self.spark.read.text(f"{self.root}/commits/{name}").collect()]:
                return Version(int(name), said[0])
        return Version(0, None)

    def dates(self, version: Version | None = None) -> DataFrame:
        """(date, version, rows) of every date of a version, the current one by default."""
        version = version or self.current()
        return self.spark.read.schema(DATES).parquet(f"{self.root}/dates/{version.name}") if version.name else self.spark.createDataFrame([], DATES)

    def state(self, schema: T.StructType | str, version: Version | None = None) -> DataFrame:
        """What was carried forward by symbol when the version was committed."""
        version = version or self.current()
        return self.spark.read.schema(schema).parquet(f"{self.root}/state/{version.name}") if version.name else self.spark.createDataFrame([], schema)

    def read(self, start: str | None = None, end: str | None = None, days: list | None = None, version: Version | None = None) -> DataFrame:
        """Rows of the dates from start to end, or of given days, as a version has them; files of other dates aren't listed or opened."""
        held = self.dates(version)
        for bound, keep in ((start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") <= F.lit(end).cast("date"))):
            held = held if bound is None else held.where(keep)
        held = held if days is None else held.where(F.col("date").isin([F.lit(d).cast("date") for d in days] or [F.lit(None).cast("date")]))
        wanted = [(r["date"], r["version"]) for r in held.select("date", "version").collect()]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        few = len(wanted) <= FEW
        paths = [f"{self.root}/rows/version={v}/date={d}" for d, v in wanted] if few else sorted({f"{self.root}/rows/version={v}" for _, v in wanted})
        schema = T.StructType([*self.schema, T.StructField("version", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/rows").parquet(*paths)
        rows = rows if few else rows.join(F.broadcast(held.select("date", "version")), ["date", "version"], "left_semi")
        return rows.select(*self.schema.names)

    def stage(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write the whole rows of some dates under a new name; the name, and the rows as written."""
        name = uuid.uuid4().hex
        path = f"{self.root}/rows/version={name}"
        rows.select(*self.schema.names).hint("rebalance", "date").write.partitionBy("date").parquet(path)
        return name, self.spark.read.schema(self.schema).parquet(path)

    def discard(self, name: str) -> None:
        for kind in (f"rows/version={name}", f"dates/{name}", f"state/{name}"):
            files, path = self._path(kind)
            files.delete(path, True)

    def commit(self, name: str, base: Version, state: DataFrame | None = None) -> Version:
        """Let a staged version count, its dates in place of the base's; raises Conflict where base is no longer the last."""
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/version={name}").groupBy("date").agg(F.count("*").alias("rows"))
        written = written.select("date", F.lit(name).alias("version"), "rows")
        self.dates(base).join(F.broadcast(written.select("date")), "date", "left_anti").unionByName(written).coalesce(1).write.parquet(f"{self.root}/dates/{name}")
        if state is not None:
            state.write.parquet(f"{self.root}/state/{name}")
        files, path = self._path("commits", f"{base.number + 1:09}")
        try:
            out = files.create(path, False)
        except Exception as e:
            self.discard(name)
            raise Conflict(f"version {base.number + 1} was committed by another writer") from e
        out.write(name.encode())
        out.close()
        return Version(base.number + 1, name)
