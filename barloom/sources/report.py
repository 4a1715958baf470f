"""Reports: rows and a manifest that come into sight together.

    df.write.format("report").mode("overwrite").options(path=..., meta=json).save()

Tasks write JSON lines under data/<job>/, which nobody reads yet. The commit writes MANIFEST.json, which names the files that
count, with their rows and SHA-256, the schema and what else is to be kept; it takes the place of the one before in one
step. A job that fails leaves the manifest as it was, and removes its files. Mode append keeps the files of the manifest
before. Paths are URIs of any file system that pyarrow opens (file, hdfs, s3), seen by the driver and the executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "MANIFEST.json"
#: Hexadecimal digits of each part of a row's digest that are added up, and the number of parts.
DIGITS, PARTS = 15, 4


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def manifest(path: str) -> dict | None:
    """What was last committed at a path, or None."""
    files, root = _files(path)
    try:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


@dataclass
class _Written(WriterCommitMessage):
    file: dict | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, meta: str, schema: T.StructType, overwrite: bool):
        self.path, self.meta, self.schema, self.overwrite, self.job = path.rstrip("/"), json.loads(meta), schema.json(), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        rows, digest, out = 0, hashlib.sha256(), None
        files, root = _files(self.path)
        name = f"data/{self.job}/part-{uuid.uuid4().hex}.jsonl"
        for row in iterator:
            if out is None:
                files.create_dir(f"{root}/data/{self.job}", recursive=True)
                out = files.open_output_stream(f"{root}/{name}")
            line = json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n"
            out.write(line)
            digest.update(line)
            rows += 1
        if out is None:
            return _Written(None)
        out.close()
        return _Written({"name": name, "rows": rows, "sha256": digest.hexdigest()})

    def commit(self, messages: list) -> None:
        before = None if self.overwrite else manifest(self.path)
        files = (before["files"] if before else []) + [m.file for m in messages if m and m.file]
        said = {"schema": json.loads(self.schema), "files": files, "rows": sum(f["rows"] for f in files), "meta": self.meta}
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{self.job}.tmp") as f:
            f.write(json.dumps(said).encode())
        system.move(f"{root}/{self.job}.tmp", f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        system, root = _files(self.path)
        if system.get_file_info(f"{root}/data/{self.job}").type.name == "Directory":
            system.delete_dir(f"{root}/data/{self.job}")


class Report(DataSource):
    """Options: path, and meta (a JSON object that is kept in the manifest)."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("meta", "{}"), schema, overwrite)


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's values as text, each after a bar; a null is nothing."""
    return F.sha2(F.concat(*(F.concat(F.lit("|"), F.coalesce(c.cast("string"), F.lit(""))) for c in columns)), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and sha256 of a table: the digest of its number of rows and of the sums of its rows' digests, part by part.

    Sums need no order, so that equal tables have equal digests however their rows lie, and rows that occur twice count twice.
    """
    digest = row_digest(*(F.col(f"`{c}`") for c in df.columns))
    part = lambda i: F.conv(F.substring("digest", i * DIGITS + 1, DIGITS), 16, 10).cast("decimal(20,0)")
    sums = df.select(digest.alias("digest")).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(PARTS)))
    return sums.select("rows", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("rows", *(f"s{i}" for i in range(PARTS))))), 256).alias("sha256"))


def published(df: DataFrame, path: str, append: bool = False, **meta) -> dict:
    """Write a table as a report, its digest in the manifest, and give the manifest."""
    df.sparkSession.dataSource.register(Report)
    df = df.persist()  # gone over twice
    try:
        content = table_digest(df).first()
        kept = json.dumps(meta | {"content_rows": content["rows"], "content_sha256": content["sha256"]}, default=str)
        df.write.format("report").mode("append" if append else "overwrite").option("path", path).option("meta", kept).save()
    finally:
        df.unpersist()
    return manifest(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last commit; an error where there is none."""
    said = manifest(path)
    if said is None:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(said["schema"])
    files = [f"{path.rstrip('/')}/{f['name']}" for f in said["files"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
