"""Benchmark decontamination by winnowing.

A benchmark item's windows are its runs of `window` (13) consecutive words; an item of fewer words, but not none, is one
window. For windows of n words, k-grams with k = min(5, n) are hashed and the least hash of each n - k + 1 consecutive
k-grams is kept as a fingerprint, in documents as in items: a window that both share has the same least hash on both
sides, so every shared span of n words is met.

Both sides' fingerprints are tables. Their join leaves the documents that share some, with those they share; only these
are read again and extended to whole windows, which a second join compares with the benchmark's by the SHA-256 of their
words. Nothing of either side goes through the driver but the distinct window lengths, `window` numbers at most. The
benchmark's tables are written first, so that Spark knows their size when it chooses between a broadcast join and a shuffle.

Null texts and texts without words have no words, hits or items and are not contaminated. Repeated rows are kept. Items
with null ids or without words have no window. Items that share an id count once. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_large, bounds_of, freeing, slices, small_batches, stored
from barloom.llm.words import Words, mix

K = 5
PRINTS = "struct<n_words: bigint, prints: array<bigint>>"
WINDOW = "array<struct<n: int, first: bigint, print: bigint, digest: binary>>"


def fingerprints(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of n words, and the window's fingerprint: the least hash of its k-grams, mixed with n."""
    k = min(K, n)
    at, _ = words.grams(n)
    grams = np.full(len(words.hash) + 1, np.iinfo(np.uint64).max, np.uint64)
    where, hashes = words.grams(k)
    grams[where] = hashes
    least = grams[at]
    for j in range(1, n - k + 1):
        np.minimum(least, grams[at + j], out=least)
    return at, mix(least ^ np.uint64(n)).view(np.int64)


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """values, ordered by owner, as a list for each of so many rows."""
    return pa.ListArray.from_arrays(pa.array(bounds_of(np.bincount(owner, minlength=rows)), pa.int32()), values)


def winnowed(text: Column, sizes: list[int]) -> Column:
    """PRINTS of a text: its number of words, and the fingerprints of its windows of each size, once for neighbours that share one."""

    @F.arrow_udf(PRINTS)
    @freeing
    def prints_of(texts: pa.Array) -> pa.Array:
        counts, lists = [np.zeros(0, np.int64)], [pa.array([], pa.list_(pa.int64()))]
        for some in slices(as_large(texts), 1 << 20):
            words = Words(some)
            owners, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in sizes:
                at, own = fingerprints(words, n)
                owner = words.owner[at]
                new = np.ones(len(at), bool)
                new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
                owners.append(owner[new])
                prints.append(own[new])
            owner = np.concatenate(owners)
            order = np.argsort(owner, kind="stable")
            counts.append(words.counts)
            lists.append(_lists(owner, len(some), pa.array(np.concatenate(prints)[order], pa.int64())))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), pa.concat_arrays(lists)], ["n_words", "prints"])

    return prints_of(text)


def _window_lists(words: Words, rows: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Array:
    """WINDOW of each row, from (n, first words, fingerprints) of windows."""
    owner = words.owner[np.concatenate([np.zeros(0, np.int64), *(at for _, at, _ in found)])]
    order = np.argsort(owner, kind="stable")
    digests = [hashlib.sha256(words.text(i, i + n)).digest() for n, at, _ in found for i in at]
    columns = [
        pa.array(np.concatenate([np.zeros(0, np.int64), *(np.full(len(at), n) for n, at, _ in found)]), pa.int32()),
        pa.array(np.concatenate([np.zeros(0, np.int64), *(at - words.bounds[words.owner[at]] for _, at, _ in found)]), pa.int64()),
        pa.array(np.concatenate([np.zeros(0, np.int64), *(prints for _, _, prints in found)]), pa.int64()),
        pa.array(digests, pa.binary()),
    ]
    return _lists(owner, rows, pa.StructArray.from_arrays(columns, ["n", "first", "print", "digest"]).take(pa.array(order)))


_NO_WINDOWS = pa.list_(pa.struct([("n", pa.int32()), ("first", pa.int64()), ("print", pa.int64()), ("digest", pa.binary())]))


def item_windows(text: Column, window: int = 13) -> Column:
    """All windows of a benchmark text."""

    @F.arrow_udf(WINDOW)
    @freeing
    def windows_of(texts: pa.Array) -> pa.Array:
        lists = [pa.array([], _NO_WINDOWS)]
        for some in slices(as_large(texts), 1 << 18):
            words, found = Words(some), []
            size = np.minimum(words.counts, window)
            for n in sorted(set(size.tolist()) - {0}):
                at, prints = fingerprints(words, n)
                mine = size[words.owner[at]] == n
                found.append((n, at[mine], prints[mine]))
            lists.append(_window_lists(words, len(some), found))
        return pa.concat_arrays(lists)

    return windows_of(text)


def extended(text: Column, prints: Column, sizes: list[int]) -> Column:
    """Windows of a document's text whose fingerprint is among `prints`, or among those of a text handled with it."""

    @F.arrow_udf(WINDOW)
    @freeing
    def windows_of(texts: pa.Array, shared: pa.Array) -> pa.Array:
        lists, done = [pa.array([], _NO_WINDOWS)], 0
        for some in slices(as_large(texts), 1 << 20):
            words, found = Words(some), []
            known = shared.slice(done, len(some)).flatten().to_numpy(zero_copy_only=False)
            done += len(some)
            for n in sizes:
                at, own = fingerprints(words, n)
                met = np.isin(own, known)
                found.append((n, at[met], own[met]))
            lists.append(_window_lists(words, len(some), found))
        return pa.concat_arrays(lists)

    return windows_of(text, prints)


def benchmark_windows(benchmark: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """digest, n, print and items (ids, ascending) of each different window of the benchmark, written as a table."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = items.select("id", F.explode(item_windows(F.col("text"), window)).alias("w")).select("id", "w.digest", "w.n", "w.print")
    return stored(rows.groupBy("digest", "n", "print").agg(F.array_sort(F.collect_set("id")).alias("items")), "windows")


def united(runs: Column) -> Column:
    """Number of words in the union of runs (array of first, last)."""
    return F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(
            F.greatest(acc["end"], r["last"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(acc["end"], r["first"] - 1))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def _same(*columns: str) -> Column:
    """Null-safe equality of d's and f's columns."""
    every = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns]
    return every[0] & every[1]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each document's doc_id, print (a hash of its text) and n_words; and doc_id, print, n_hit and items of those with hits."""
    windows = benchmark_windows(benchmark, window)
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())
    known = stored(windows.select(F.col("print").alias("shared")).distinct(), "prints")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    rows = stored(texts.select("doc_id", "print", winnowed(F.col("text"), sizes).alias("w")).select("doc_id", "print", "w.*"), "fingerprints")
    met = rows.select("doc_id", "print", F.explode("prints").alias("shared")).join(known, "shared", "left_semi")
    met = stored(met.groupBy("doc_id", "print").agg(F.collect_set("shared").alias("prints")), "shared")
    again = texts.alias("d").join(met.alias("f"), _same("doc_id", "print")).select("d.doc_id", "d.print", "d.text", "f.prints")
    spans = again.select("doc_id", "print", F.explode(extended(F.col("text"), F.col("prints"), sizes)).alias("w")).select("doc_id", "print", "w.digest", "w.first")
    run = F.struct("first", (F.col("first") + F.col("n") - 1).alias("last"))
    hits = spans.join(windows.select("digest", "n", "items"), "digest").groupBy("doc_id", "print")
    found = hits.agg(united(F.collect_set(run)).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.select("doc_id", "print", "n_words"), found


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids) and contaminated of every document."""
    rows, found = _hits(docs, benchmark, window, id_col, text_col)
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    every = rows.alias("d").join(found.alias("f"), _same("doc_id", "print"), "left").select("d.doc_id", "n_words", n_hit, items)
    return every.withColumn("contaminated", _contaminated())


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without contaminated ones; each row is judged by its own text."""
    rows, found = _hits(docs, benchmark, window, id_col, text_col)
    bad = rows.alias("d").join(found.alias("f"), _same("doc_id", "print")).where(_contaminated()).select("d.doc_id", "d.print").distinct()
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("f.doc_id")) & F.xxhash64(F.col(f"d.{text_col}")).eqNullSafe(F.col("f.print"))
    return docs.alias("d").join(bad.alias("f"), same, "left_anti")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    rows = contamination(docs, benchmark, **options)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated")
