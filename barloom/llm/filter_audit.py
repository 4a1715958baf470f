"""Audits of how text filters interact: what each filter removes, wherever it stands among the others.

Every document is a set of failed filters, a number below 2**k. A table, made once, says for each such set and each of the
k! orders at which step the document is removed. Tasks look their documents up in it and count removals by part, order,
step and label; their counts are summed. Everything else follows from these counts: what fails a filter is what the filter
removes when it comes first, and what fails it alone is what it removes when it comes last.

Null and empty texts are equal and have no words: they fail A only, and E if a document of a lesser id has no text either.
Repeated rows each count, and no row counts as a copy of one with the same id. A row without id is a copy of nothing, and
nothing is a copy of it; it has no labels. A null part is the empty string. A document with several rows of labels has
a label if any of them has it. An empty table has no parts, and so no rows. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

NAMES = "ABCDE"
#: Parts whose counts a task holds before it passes them on.
HELD = 256


def orders(k: int) -> np.ndarray:
    """All orders of k filters, k! x k."""
    return np.array(list(itertools.permutations(range(k))))


def first_failures(k: int) -> np.ndarray:
    """2**k x k!: the step (from 0) at which a document that fails the filters of a set is removed; k where it never is."""
    fails = (np.arange(1 << k)[:, None, None] >> orders(k)[None]) & 1 == 1
    return np.where(fails.any(2), fails.argmax(2), k)


def failed(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def bits(w: Column) -> Column:
        few = F.size(w) < 200
        repeated = F.size(F.array_distinct(w)) * 100 < F.size(w) * 50
        loud = F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3
        marks = text.rlike(r"[#$%&*|]")
        return sum((c.cast("int") * (1 << i) for i, c in enumerate((few, repeated, loud, marks))), F.lit(0))

    return F.element_at(F.transform(F.array(words), bits), 1)


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """rows (doc_id, digest, mask, ...) with the bit set where a lesser doc_id has the same digest; without digest.

    Only the least id of digests that several rows have is looked up, from a table, so that a digest which a third of all
    rows share is an ordinary skewed join.
    """
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("digest", "least")
    joined = rows.join(stored(least, "copies"), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return joined.withColumn("mask", F.col("mask") + copy.cast("int") * (1 << bit)).drop("digest", "least")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed(text).alias("mask"))
    rows = with_copies(stored(rows, "failures"), 4)
    any_of = lambda c, v: F.max(F.coalesce((F.col(c) == v).cast("int"), F.lit(0)))
    known = stored(labels.groupBy("doc_id").agg(any_of("quality", 1).alias("good"), any_of("toxic", 1).alias("toxic")), "labels")
    return rows.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


COUNTED = "part string, cell int, removed long, good long, toxic long"


def removals(rows: DataFrame, k: int) -> DataFrame:
    """Sums of removals by part and cell (order * (k + 1) + step; step k: kept) over rows (part, mask, good, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures(k)
        n_orders = table.shape[1]
        cells = n_orders * (k + 1)
        at = np.arange(n_orders) * (k + 1)
        held: dict[str, np.ndarray] = {}

        def passed_on() -> Iterable[pa.RecordBatch]:
            for part, sums in held.items():
                used = np.flatnonzero(sums[0])
                columns = [pa.array([part] * len(used), pa.string()), pa.array(used, pa.int32()), *(pa.array(s[used], pa.int64()) for s in sums)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "cell", "removed", "good", "toxic"])
            held.clear()

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            mask, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic"))
            of = parts.indices.to_numpy()
            for code, part in enumerate(parts.dictionary.to_pylist()):
                own = of == code
                cell = (table[mask[own]] + at).ravel()
                weights = (None, np.repeat(good[own], n_orders), np.repeat(toxic[own], n_orders))
                sums = np.stack([np.bincount(cell, w, cells).astype(np.int64) for w in weights])
                held[part] = held[part] + sums if part in held else sums
                if len(held) > HELD:
                    yield from passed_on()
        yield from passed_on()

    return rows.mapInArrow(count, COUNTED).groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))


def audited(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """Of rows (part, mask, good, toxic): a row for each part, order of the filters and step, with what was counted there."""
    k = len(names)
    sums = removals(rows, k).withColumns({"order": F.floor(F.col("cell") / (k + 1)).cast("int"), "step": (F.col("cell") % (k + 1)).cast("int")})
    totals = sums.where("order = 0").groupBy("part").agg(F.sum("removed").alias("total"))
    steps = [(i, "".join(names[f] for f in order), s + 1, names[f]) for i, order in enumerate(orders(k).tolist()) for s, f in enumerate(order)]
    listed = rows.sparkSession.createDataFrame(steps, "order int, filter_order string, step int, filter string")
    grid = totals.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(len(steps) // k - 1)))).join(F.broadcast(listed), "order")
    found = grid.join(sums.select("part", "order", (F.col("step") + 1).alias("step"), "removed", "good", "toxic"), ["part", "order", "step"], "left").fillna(0, ["removed", "good", "toxic"])
    so_far = Window.partitionBy("part", "order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    of_filter = Window.partitionBy("part", "filter")
    when = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(of_filter)
    return found.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", (when(1) - F.col("removed")).alias("redundant"), when(k).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(of_filter).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    return audited(judged(docs, labels))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS s FROM w LEFT JOIN l USING (doc_id)),
fails AS (SELECT row_number() OVER () AS id, part, good, toxic, map {'A': s['A'], 'B': s['B'], 'C': s['C'], 'D': s['D'], 'E': s['E']} AS m FROM f),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
each AS (SELECT part, good, toxic, o AS filter_order, step, m[o[step]] AS fail,
  len(list_filter(range(1, step), lambda i: m[o[i]])) > 0 AS gone, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda i: m[i])) = 1 AS alone FROM fails, steps),
c AS (SELECT part, filter_order, step, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
  count(*) FILTER (fail AND alone) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost FROM each GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM c
"""
