"""Token tables: documents encoded to token ids and stored as Parquet list columns.

A table has one row per document (doc_id, n_tokens, ids) in ascending order of doc_id, over files and inside them. Ids are
dictionary coded (a vocabulary's 16 bits an id), with delta coding where a dictionary grows too large; row groups and
pages are small enough that their minima and maxima of doc_id let a reader fetch a few documents' ids only, and a reader
of doc_id and n_tokens touches no page of ids.

Null and empty texts give the end id alone. Repeated rows are kept, each with its ids. Further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import IdCache, as_large, bounds_of, local, shared_folder, shipped, slices, small_batches, spread

#: Writer settings: 32 MB row groups with 128 KB pages, dictionary first, delta coding as the fallback.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "v2",
    "compression": "zstd",
}


@functools.lru_cache(1)
def _loose() -> str:
    """Letters that normal form C and lower case turn into something that doesn't end in a letter, such as U+0958."""
    import unicodedata as u

    ends = lambda c: u.category(u.normalize("NFC", c).lower()[-1])[0]
    return "".join(c for c in map(chr, range(0x110000)) if u.category(c)[0] == "L" and ends(c) != "L")


@functools.lru_cache(2)
def _coder(path: str) -> tuple:
    """The library's ids of many pieces, and a cache of them. Words of Latin letters, each sure to be one word for the
    library too, go to it joined by spaces; their ids are told apart by the mark that ends a word's last token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(local(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def coded(texts: list) -> list:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(pieces: list) -> tuple[np.ndarray, np.ndarray]:
        lens = np.zeros(len(pieces), np.int64)
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), "^[a-z\xdf-\xf6\xf8-\xff]+$").to_numpy(zero_copy_only=False).astype(bool)
        words, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = [" ".join([pieces[i] for i in words[k : k + 500]]) for k in range(0, len(words), 500)]
        flat = np.fromiter(itertools.chain.from_iterable(coded(joined)), np.int32)
        lens[words] = np.diff(np.flatnonzero(ends[flat]), prepend=-1)
        lists = coded([pieces[i] for i in rest])
        lens[rest] = [len(x) for x in lists]
        ids = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(lists), np.int32)])
        order = np.concatenate([words, rest])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return ids[spread(starts, lens)], lens

    return ids_of, IdCache(ids_of)


def encode_texts(texts: pa.Array, path: str, end_id: int | None, slice_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the bounds of each text's ids, as the tokenizers library gives them for whole texts.

    For a vocabulary that lower-cases, drops white space and splits letters from punctuation, the ids of a text are those
    of its words one after the other, so that each distinct word goes to the library once. Words are cut at spaces and
    between a letter and a full stop or comma, but for letters that the library takes apart (a mark and punctuation are
    one piece to it). Texts that hold "<|", and so may hold a special token, go to it whole.
    """
    ids_of, cache = _coder(path)
    parts, lens = [], []
    for some in slices(as_large(texts), slice_bytes):
        whole = pc.match_substring(some, "<|").to_numpy(zero_copy_only=False)
        plain = pc.replace_substring_regex(pc.if_else(pa.array(whole), "", some), r"[\n\t\r]", " ")
        plain = pc.replace_substring_regex(plain, rf"([^\PL{_loose()}])([.,])", r"\1 \2")
        words = pc.split_pattern(plain, " ")
        first = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        # capitals of words that the library's normal form leaves as they are; others may compose with a mark, and go to it as they are
        steady = pc.match_substring_regex(coded.dictionary, r"^[\x00-\x{ff}]*$")
        lower = pc.if_else(steady, pc.ascii_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        places = cache.places(lower.dictionary)[lower.indices.to_numpy()]
        flat, bounds = cache.gather(places[coded.indices.to_numpy()], first)
        own = np.diff(bounds)
        if whole.any() or end_id is not None:
            at = np.flatnonzero(whole)
            own_ids, own_lens = ids_of(some.take(pa.array(at)).to_pylist())
            special = dict(zip(at.tolist(), np.split(own_ids, np.cumsum(own_lens)[:-1]), strict=False)) if len(at) else {}
            end = [] if end_id is None else [end_id]
            lists = []
            if special:
                for i in range(len(some)):
                    lists += [np.asarray([*special[i], *end], np.int32)] if i in special else [flat[bounds[i] : bounds[i + 1]], np.asarray(end, np.int32)]
                own = own + len(end)
                for i, ids in special.items():
                    own[i] = len(ids) + len(end)
                flat = np.concatenate(lists)
            else:
                flat, own = np.insert(flat, bounds[1:], end_id), own + 1
        parts.append(flat)
        lens.append(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)).astype(np.int32), bounds_of(np.concatenate(lens) if lens else [])


def token_ids(text: Column, tokenizer_path: str, end_id: int | None) -> Column:
    """array<int> of the whole text's ids, then end_id."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        flat, bounds = encode_texts(texts, tokenizer_path, end_id)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))

    return encoded(text)


def write_token_table(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs' ids to path in ascending order of id_col, one range of ids per file."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = ranged.select("doc_id", token_ids(F.col("text"), tokenizer_path, end_id).alias("ids"))
    ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**LAYOUT).parquet(path)


def read_token_table(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, metadata_only: bool = False) -> DataFrame:
    """The table, or documents first to last of it; metadata_only leaves the ids unread."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens") if metadata_only else rows


def ids_digest(ids: Column) -> Column:
    """Number of ids, and the unsigned crc32 of the ids as little-endian 32-bit integers."""

    @F.arrow_udf("struct<n: bigint, crc: bigint>")
    def digest(lists: pa.Array) -> pa.Array:
        bounds = lists.offsets.to_numpy().astype(np.int64)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["n", "crc"])

    return digest(ids)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read from the files.

    Files hold ranges of doc_id in the order of their numbers, so a running sum over each file's rows as they lie in it and
    one over the files' totals (a row per file) give the positions; no task sees more than a file's rows.
    """
    name = F.col("_metadata.file_name")
    file = F.struct(F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("number"), name.alias("name")).alias("file")
    rows = read_token_table(spark, path).select("doc_id", file, F.col("_metadata.row_index").alias("row"), ids_digest(F.col("ids")).alias("d"))
    rows = rows.select("doc_id", "file", "row", F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32"))
    rows = rows.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    totals = read_token_table(spark, path, metadata_only=True).groupBy(file).agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    start = (F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).cast("long")
    return rows.join(before, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write a token table of docs to the shared folder and return the positions and checksums found in it."""
    small_batches(docs.sparkSession)
    path = shared_folder(docs.sparkSession, "tokens")
    shipped(docs.sparkSession, tokenizer_path)
    write_token_table(docs, path, tokenizer_path, end_id)
    return token_positions(docs.sparkSession, path)
