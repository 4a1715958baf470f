"""Language identification by rank-order profiles.

A language's profile is its `size` most frequent letter n-grams (n = 1, 2, 3, words padded with a blank) in rank order. A
document's own most frequent n-grams are ranked likewise; the out-of-place distance to a profile sums the differences of
rank, with `size` for an n-gram that the profile lacks. The nearest language is taken, ties by its name.

Profiles are learnt from about `per_language` different labelled texts of each language, chosen by their hash, so that
the sample is bounded however large the input is; predictions read whole texts. Null texts and texts without a letter are
`und` with score 0, as is everything where no labelled document has a letter. Equal texts get equal answers. Ties in
frequency are ranked by the n-gram's code points.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import as_large, share_of_hashes, slices, small_batches

SIZE = 400


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its own value if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, 0).astype(np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; three code points of 21 bits make a code, a blank is 1, nothing is 0."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = np.ones(len(points) + 2, bool)
    gap[1:-1] = points == 0
    marked = np.ones(len(points) + 2, np.int64)
    marked[1:-1] = np.where(points == 0, 1, points)
    marked = marked[~gap | np.concatenate([~gap[1:], [False]]) | np.concatenate([[False], ~gap[:-1]])]
    if len(marked) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = marked[:-2], marked[1:-1], marked[2:]
    ones = marked[marked > 1]
    twos = ((marked[:-1] << 21) | marked[1:])[(marked[:-1] > 1) | (marked[1:] > 1)]
    threes = ((a << 42) | (b << 21) | c)[b > 1]
    return np.unique(np.concatenate([ones, twos, threes]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in rank order."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], size: int = SIZE):
        self.names, self.size = sorted(ranks), size
        every = np.array(sorted({c for codes in ranks.values() for c in codes}), np.int64)
        self.codes = every
        self.rank = np.full((len(self.names), len(every) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(every, np.array(ranks[name], np.int64))] = np.arange(len(ranks[name]))

    def nearest(self, text: str) -> tuple[str, float]:
        """Language and score: 1 less the share of the greatest possible distance."""
        own = ranked(*gram_counts(text), self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        place = np.searchsorted(self.codes, own)
        place[place == len(self.codes)] = 0
        place = np.where(self.codes[place] == own, place, len(self.codes))
        theirs = self.rank[:, place]
        away = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def sampled(labelled: DataFrame, per_language: int) -> DataFrame:
    """About per_language different texts (lang, text) of each language, those whose hashes lie in a share of all hashes.

    The share follows from each language's number of different texts, so that what is drawn is bounded however large the
    input is, and a large group of copies counts once.
    """
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("different"))
    drawn = rows.join(F.broadcast(sizes), "lang").where(share_of_hashes(F.col("h"), per_language, F.col("different")))
    return drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def learn(labelled: DataFrame, per_language: int = 1024, size: int = SIZE) -> Profiles:
    """Profiles from labelled documents (lang, text). What reaches the driver is `size` codes a language."""
    small_batches(labelled.sparkSession)

    def counted(batches):
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, counts = gram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    grams = sampled(labelled, per_language).mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = grams.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "rank", "code").collect()
    ranks: dict[str, list[int]] = {}
    for row in sorted(top):
        ranks.setdefault(row["lang"], []).append(row["code"])
    return Profiles(ranks, size)


def language(text: Column, profiles: Profiles) -> Column:
    """struct<lang, score> of a text."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def judged(texts: pa.Array) -> pa.Array:
        found = [profiles.nearest(t) for some in slices(as_large(texts), 8 << 20) for t in some.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return judged(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, per_language: int = 1024, size: int = SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt from those not held out."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), per_language, size)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), profiles).alias("l"))
    return rows.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
