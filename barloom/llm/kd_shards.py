"""K-d tree partitioning into shards of near equal bytes, with DataFrame functions only.

A node is split along the metadata dimension in which its documents spread widest (position of doc_id, length, source,
language, each over its whole range), at the weighted median of bytes, or at the fitting fraction where the number of
leaves is odd. Rows of equal value are ordered by a hash of id and text, so that a hot source is split as finely as any
other. Medians come from histograms of sums by node and bin that are refined around the cut; Spark adds them up and finds
the bin that holds the cut, so that one row a node reaches the driver, and all nodes of a level share each pass over the
(narrow, stored) metadata.

A document weighs its text's UTF-8 bytes plus 16. Null texts have no bytes and crc32 0. Null metadata counts as least.
Rows that are equal in id and text can't be told apart and share a shard. An empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

DIMS, BITS, BINS = 4, 31, 8192


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and a key of 62 bits for each dimension: the value's place and a hash."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang", F.length(text).alias("chars"))
    rows = stored(rows, "metadata")
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, span = (lo or 0), max(1, (hi or 0) - (lo or 0))
    top = (1 << BITS) - 1
    place = [
        F.floor((F.col("doc_id") - lo) / span * top),
        F.least(F.floor(F.log2(F.col("chars") + 1) * (1 << 26)), F.lit(top)),
        F.when(F.col("source").isNotNull(), F.pmod(F.xxhash64("source"), F.lit(top + 1))),
        F.when(F.col("lang").isNotNull(), F.pmod(F.xxhash64("lang"), F.lit(top + 1))),
    ]
    tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(top + 1))
    keys = [(F.shiftleft(F.coalesce(p.cast("long"), F.lit(0).cast("long")), BITS) + tie).alias(f"k{i}") for i, p in enumerate(place)]
    return stored(rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), *keys, F.lit(0).alias("node")), "keys")


def _key() -> Column:
    """A row's key in its node's dimension."""
    return F.get(F.array(*(f"k{i}" for i in range(DIMS))), F.col("dim"))


def _cuts(rows: DataFrame, nodes: list[dict], exact: float) -> dict[int, int]:
    """For each node (node, dim, lo, hi, goal, leaf) the key below which its rows weigh nearest to goal."""
    spark, cuts = rows.sparkSession, {}
    open_ = {n["node"]: n | {"before": 0} for n in nodes}
    while open_:
        bounds = [(n["node"], n["dim"], n["lo"], n["hi"], -(-(n["hi"] - n["lo"]) // BINS), n["before"], n["goal"]) for n in open_.values()]
        local = spark.createDataFrame(bounds, "node int, dim int, lo long, hi long, width long, before long, goal double")
        inside = rows.join(F.broadcast(local), "node").withColumn("key", _key()).where("key >= lo and key < hi")
        bins = inside.groupBy("node", "lo", "hi", "width", "goal", "before", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size").alias("bytes"))
        up_to = F.col("before") + F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        met = F.min(F.struct("bin", "bytes", "up_to", "lo", "hi", "width")).alias("met")
        for r in bins.withColumn("up_to", up_to).where("up_to >= goal").groupBy("node").agg(met).select("node", "met.*").collect():
            n, where, at = open_[r["node"]], r["lo"] + r["bin"] * r["width"], r["up_to"] - r["bytes"]
            if r["width"] <= 1 or r["bytes"] <= exact * n["leaf"]:
                cuts[r["node"]] = where + (r["width"] if r["up_to"] - n["goal"] < n["goal"] - at else 0)
                del open_[r["node"]]
            else:
                n.update(lo=where, hi=min(r["hi"], where + r["width"]), before=at)
    return cuts


def partitioned(rows: DataFrame, shards: int, exact: float = 1e-3) -> DataFrame:
    """rows with their leaf as column node; a cut is refined until its bin holds at most `exact` of a leaf's bytes or one key.

    A node is known by its first leaf. A level costs one pass for the nodes' extents, a few for their cuts, and one to
    write the narrow rows with their new nodes; a row a node reaches the driver.
    """
    leaves, whole = {0: shards}, None
    while any(n > 1 for n in leaves.values()):
        ends = [f(f"k{i}").alias(f"{name}{i}") for i in range(DIMS) for name, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *ends).collect()}
        if not stats:
            return rows
        whole = whole or [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(DIMS)]
        nodes = []
        for node, n in leaves.items():
            if n > 1 and (s := stats.get(node)):
                dim = max(range(DIMS), key=lambda i: ((s[f"hi{i}"] - s[f"lo{i}"]) / whole[i], -i))  # noqa: B023
                nodes.append({"node": node, "dim": dim, "lo": s[f"lo{dim}"], "hi": s[f"hi{dim}"] + 1, "goal": s["total"] * (n // 2) / n, "leaf": s["total"] / n})
        cuts = _cuts(rows, nodes, exact)
        moves = [(n["node"], n["dim"], cuts[n["node"]], n["node"] + leaves[n["node"]] // 2) for n in nodes]
        local = rows.sparkSession.createDataFrame(moves, "node int, dim int, cut long, right int")
        node = F.when(_key() >= F.col("cut"), F.col("right")).otherwise(F.col("node")).alias("node")
        rows = stored(rows.join(F.broadcast(local), "node", "left").select(*(c for c in rows.columns if c != "node"), node), "nodes")
        leaves = {k: v for node, n in leaves.items() for k, v in ([(node, n)] if n == 1 else [(node, n // 2), (node + n // 2, n - n // 2)])}
    return rows


def sharded(docs: DataFrame, shards: int = 40, rows_per_part: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; slots number a shard's rows from 0 without a gap.

    A shard is numbered part by part (parts by hash, of about rows_per_part rows), with the parts' counts as offsets, so
    that no task holds a whole shard.
    """
    rows = partitioned(metadata(docs), shards)
    parts = max(8, math.ceil(rows.count() / shards / rows_per_part))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod("tie", F.lit(parts)).alias("part"))
    counts = rows.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside).join(offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    rows = sharded(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
