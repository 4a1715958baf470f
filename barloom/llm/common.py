"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_of_hashes(hashed: Column, sample: int, distinct: Column) -> Column:
    """Whether a 64-bit hash lies in the share of all hashes that about `sample` of `distinct` different ones fall into."""
    return F.shiftright(hashed, 20) < (F.least(F.lit(1.0), sample / F.greatest(distinct, F.lit(1))) - 0.5) * 2.0**44


def free_name(docs: DataFrame, name: str) -> str:
    """name, or with as many underscores as it takes to be none of the table's columns in any case of letters."""
    used = {c.lower() for c in docs.columns}
    while name.lower() in used:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers in batches of at most so many rows, which bounds their memory; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shipped(spark: SparkSession, path: str) -> str:
    """path, once its file has been sent to the executors; there, local() finds it."""
    spark.sparkContext.addFile(path)
    return path


def local(path: str) -> str:
    """Where a shipped file lies on this machine: at its own path, else where Spark put it."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers outlive the tasks that needed it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def freeing(f):
    """f, with unused memory given back after each call; for functions that go over a batch of texts."""

    @functools.wraps(f)
    def call(*args):
        try:
            return f(*args)
        finally:
            release()

    return call


def as_large(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones, with 64-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, "").cast(pa.large_string())


def slices(texts: pa.Array, max_bytes: int):
    """Consecutive slices of about max_bytes each; a longer text is a slice of its own, never cut."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield texts.slice(first, last - first)
        first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a large_string array without nulls, and each text's bounds in them (one more than texts)."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def bounds_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


class IdCache:
    """Text pieces with their token ids; ids lie one after the other in a single array.

    ids_of(pieces), asked for pieces not met before, gives all their ids and the number of each piece's. Once more than `limit` pieces are held, it starts afresh,
    which costs time only.
    """

    def __init__(self, ids_of, limit: int = 500_000):
        self.ids_of, self.limit = ids_of, limit
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.used, self.n = pa.array([], pa.large_string()), np.zeros(1 << 16, np.int32), 0, 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    @staticmethod
    def _grown(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The number of each (distinct) piece of a large_string array."""
        if self.n > self.limit:
            self.clear()
        found = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            missing = pieces.take(pa.array(new))
            flat, lens = self.ids_of(missing.to_pylist())
            total = len(flat)
            self.flat = self._grown(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = flat
            self.starts, self.lens = self._grown(self.starts, self.n + len(new)), self._grown(self.lens, self.n + len(new))
            self.starts[self.n : self.n + len(new)] = self.used + np.cumsum(lens) - lens
            self.lens[self.n : self.n + len(new)] = lens
            self.known = pa.concat_arrays([self.known, missing])
            found[new] = np.arange(self.n, self.n + len(new))
            self.n, self.used = self.n + len(new), self.used + total
        return found

    def gather(self, places: np.ndarray, owners_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in order, and the bounds of each owner's ids; owner i has pieces owners_first[i] up to owners_first[i + 1]."""
        lens = self.lens[places]
        flat = self.flat[spread(self.starts[places], lens)]
        return flat, bounds_of(lens)[owners_first]
