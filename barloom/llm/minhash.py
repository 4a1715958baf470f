"""Near-duplicate groups by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its runs of five words; one of fewer words is a single run of all of them. Two documents are
linked if their weighted Jaccard similarity (sum of least counts over sum of greatest counts) is at least 0.8. Classes are
the connected components of these links.

Signatures. Each run of words has independent Poisson processes of points in time, one for the weight level 1 and one for
each dyadic range of levels (1, 2], (2, 4], (4, 8], ...; a range's process has as many times the rate as it has levels,
and each of its points draws one level. A run of weight c keeps the points of levels up to c, so that a count of c costs
about log c processes. Every point draws one of `m` registers, which keeps its earliest point. Two registers agree with a
probability that is the weighted Jaccard similarity. Points are made up to a time at which all registers of a document
are sure to be filled; where one is not, the time is doubled for that document.

Bands of `rows` registers make the buckets: with 32 bands of 5 a pair of similarity 0.8 shares no bucket with a probability
of 3e-6. Documents of equal words are one class from the start and stand in buckets once. In a bucket every member is
compared with one centre; members of other components are compared with further centres in later rounds. What then still
lies in one bucket but in several components is joined by an exact prefix filter on its rarest runs of words. So no link
is left out, while a bucket of copies costs comparisons in proportion to its size, and documents that only share a
template meet nothing, since what they have of their own fills their prefixes.

Before texts are compared, a bound: runs are counted by hash in `BINS` bins, and two documents share at most the sum of
the lesser counts of each bin.

Texts are compared by a digest of their words, so that rows which share an id but not their words are told apart; repeated
rows each get their class. A null text and a text without words has a class of its own, but for equal texts that aren't null
or empty. Rows without id and words are one class, whose ids are null. Ids are the least ones of their groups, null only
where no row has one. Every text that isn't alone in its class has a verified link, the best of which stands beside it;
links() gives all that were verified. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import as_large, free_name, freeing, slices, small_batches, stored
from barloom.llm.words import Words, mix, runs_hash

BANDS, ROWS, SHINGLE, SIMILARITY = 32, 5, 5, 0.8
#: Bins of a document's runs, for the bound on what two documents share.
BINS = 256
_U = np.uint64


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each run of k words, or of all words where there are fewer."""
    at, hashes = words.grams(k)
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = runs_hash(words.hash, words.bounds[few], words.bounds[few + 1])
    owner = np.concatenate([words.owner[at], few])
    return owner, np.concatenate([hashes, whole])


def multisets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of each distinct run of words, by owner and hash."""
    owner, hashes = shingles(words, k)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def bag_signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers of 16 bits: a hash of each register's earliest point."""
    weight = np.bincount(owner, counts, n)
    horizon = m * (np.log(m) + 6) / np.maximum(weight, 1)
    best = np.full(n * m, np.iinfo(np.int64).max)
    todo = np.ones(len(owner), bool)
    while todo.any():
        of, x, c = owner[todo], hashes[todo], counts[todo]
        level = 0
        while len(of):
            width = 1 if level == 0 else 1 << (level - 1)
            _points(best, of, x, c, level, width, horizon, m)
            more = c > (1 if level == 0 else 2 * width)
            of, x, c, level = of[more], x[more], c[more], level + 1
        empty = np.unique(np.flatnonzero(best == np.iinfo(np.int64).max) // m)
        redo = np.zeros(n, bool)
        redo[empty] = weight[empty] > 0
        horizon = np.where(redo, 2 * horizon, horizon)
        todo = redo[owner]
    return (best & 0xFFFF).astype(np.uint16).reshape(n, m)


def _points(best, of, x, c, level, width, horizon, m) -> None:
    """Put the points of one range of levels into the registers; all arrays go by element."""
    state = mix(x ^ _U((level + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
    time, limit = np.zeros(len(of)), horizon[of]
    base = of * m
    step = _U(0x9E3779B97F4A7C15)
    while len(time):
        state = state + step
        draw = mix(state)
        time = time - np.log1p(-((draw >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        live = time <= limit
        if not live.all():
            state, draw, time, limit, base, c = state[live], draw[live], time[live], limit[live], base[live], c[live]
        other = mix(draw ^ step)
        at = base + ((other >> _U(40)) % _U(m)).astype(np.int64)
        value = (time.astype(np.float32).view(np.int32).astype(np.int64) << 32) | (other & _U(0xFFFF)).astype(np.int64)
        if level:
            kept = (width if level > 1 else 1) + 1 + ((other >> _U(16)) & _U(0xFFFFFF)).astype(np.int64) % width <= c
            at, value = at[kept], value[kept]
        np.minimum.at(best, at, value)


def _sketched(texts: pa.Array, m: int) -> pa.Array:
    digests, counts, signatures = [], [], []
    for some in slices(as_large(texts), 1 << 20):
        words = Words(some)
        owner, hashes, times = multisets(words)
        registers = bag_signatures(owner, hashes, times, len(some), m)
        size = np.bincount(owner, times, len(some)).astype(np.int64)
        counts.append(size)
        raw = memoryview(words.hash).cast("B") if len(words.hash) else b""
        b = words.bounds
        for i in range(len(some)):
            if size[i]:
                digests.append(hashlib.blake2b(raw[8 * b[i] : 8 * b[i + 1]], digest_size=16).digest())
                signatures.append(registers[i].tobytes())
            else:
                text = some[i].as_py()
                digests.append(hashlib.blake2b(text.encode(), digest_size=16, person=b"no words").digest() if text else None)
                signatures.append(None)
    columns = [pa.array(digests, pa.binary()), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(signatures, pa.binary())]
    return pa.StructArray.from_arrays(columns, ["digest", "n", "signature"])


def sketch(text: Column, m: int = BANDS * ROWS) -> Column:
    """struct<digest, n, signature> of a text: a hash of its words, its number of runs and its BagMinHash registers."""

    @F.arrow_udf("struct<digest: binary, n: bigint, signature: binary>")
    @freeing
    def sketched(texts: pa.Array) -> pa.Array:
        return _sketched(texts, m)

    return sketched(text)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of two texts' runs of words."""

    @F.arrow_udf("double")
    @freeing
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        left, right = as_large(left).dictionary_encode(), as_large(right).dictionary_encode()
        x, y = _bags(left.dictionary), _bags(right.dictionary)
        out = []
        for i, j in zip(left.indices.to_numpy(), right.indices.to_numpy(), strict=True):
            (ha, ca, na), (hb, cb, nb) = x(i), y(j)
            _, p, q = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            both = int(np.minimum(ca[p], cb[q]).sum())
            out.append(both / (na + nb - both) if na + nb else 0.0)
        return pa.array(out, pa.float64())

    return similarity(a, b)


def _bags(texts: pa.Array):
    """Hashes, counts and total count of each text, by its number."""
    found = []
    for some in slices(texts, 1 << 20):
        owner, hashes, counts = multisets(Words(some))
        bounds = np.searchsorted(owner, np.arange(len(some) + 1))
        found += [(hashes[a:b], counts[a:b], int(counts[a:b].sum())) for a, b in zip(bounds, bounds[1:], strict=False)]
    return lambda i: found[i]


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in edges (a, b): the least id of its connected component.

    In each round every id takes its least neighbour, and what was taken stands in for it in the edges; edges within what
    stands for one id go, so that the graph shrinks until none is left. Each round is stored.
    """
    left = stored(_straight(edges), "edges")
    now = stored(left.select(F.col("a").alias("id")).unionByName(left.select(F.col("b").alias("id"))).distinct().withColumn("comp", F.col("id")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "taken")
        of = lambda side, to: taken.select(F.col("a").alias(side), F.col("to").alias(to))  # noqa: B023, E731
        left = stored(_straight(left.join(of("a", "to_a"), "a").join(of("b", "to_b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
        now = stored(now.join(of("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
    return now


def _straight(edges: DataFrame) -> DataFrame:
    """Distinct edges between different ids, the lesser id first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, comp) with further links (a, b), which are taken as links between components."""
    of = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"of_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    roots = components(ends)
    known = comp.join(roots.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    return stored(known.unionByName(roots.join(comp.select("id"), "id", "left_anti")), "components")


def _least_id() -> Column:
    """Aggregate: the least id, or null where no row has one, with the text's hash."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))


def linked(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, stars: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows (id, text_hash, digest) of all documents, reps (digest, id, text_hash, n, signature), the verified links of
    digests (a, b, similarity), and components (id: digest, comp), null if there are no links."""
    small_batches(docs.sparkSession)
    texts_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = texts_in.select("id", "text_hash", sketch(F.col("text"), bands * rows).alias("s")).select("id", "text_hash", "s.*")
    sketches = stored(sketches.withColumn("digest", F.coalesce("digest", F.col("id").cast("string").cast("binary"), F.lit("no id").cast("binary"))), "sketches")
    reps = sketches.groupBy("digest").agg(_least_id().alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    reps = stored(reps.select("digest", "least.id", "least.text_hash", "n", "signature"), "reps")

    width = 2 * rows
    bucket = F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})"))
    entries = reps.where("n > 0").select(F.col("digest").alias("id"), "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select(bucket.alias("bucket"), "id", "n")
    shared = entries.groupBy("bucket").count().where("count > 1").select("bucket")
    members = stored(entries.join(shared, "bucket", "left_semi"), "members")
    wanted = reps.select(F.col("digest").alias("id"), F.xxhash64("id").alias("id_hash"), "text_hash").join(members.select("id").distinct(), "id", "left_semi")
    held = texts_in.select(F.xxhash64("id").alias("id_hash"), "text_hash", "text").join(wanted, ["id_hash", "text_hash"]).dropDuplicates(["id_hash", "text_hash"]).select("id", "text")
    held = stored(held.withColumn("bins", binned(F.col("text"))).withColumn("n", F.aggregate("bins", F.lit(0), lambda total, x: total + x)), "texts")

    comp = tested = links = None
    for turn in range(stars + 1):
        now = members.withColumn("comp", F.col("id")) if comp is None else members.join(comp, "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp"))
        now = stored(now, "now")
        pairs = _star_pairs(now, turn) if turn < stars else _rest_pairs(now, held, similarity)
        pairs = pairs.where(F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        sides = lambda *names: [held.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in names)) for k in "ab"]
        left, right = sides("bins", "n")
        near = stored(pairs.join(left, "a").join(right, "b").where(can_reach(similarity, "bins_a", "bins_b", "n_a", "n_b")).select("a", "b"), "near")
        left, right = sides("text")
        judged = stored(near.join(left, "a").join(right, "b").select("a", "b", weighted_jaccard(F.col("text_a"), F.col("text_b")).alias("similarity")), "judged")
        good = judged.where(F.col("similarity") >= similarity)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = good if links is None else links.unionByName(good)
        comp = components(good.select("a", "b")) if comp is None else grown(comp, good.select("a", "b"))
    if links is None:
        links = docs.sparkSession.createDataFrame([], "a binary, b binary, similarity double")
    return sketches.select("id", "text_hash", "digest"), reps, links, comp


def links(docs: DataFrame, **options) -> DataFrame:
    """(a, b, similarity): the least ids of the texts of each verified link; a class of n different texts has n - 1 at least."""
    _, reps, found, _ = linked(docs, **options)
    of = lambda side: reps.select(F.col("digest").alias(side), F.col("id").alias(f"id_{side}"))
    return found.join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")


def _classes(sketches: DataFrame, reps: DataFrame, found: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(digest, rep_id, class: struct<none, id, text_hash>, linked_id, similarity): class is its least row."""
    own = reps.select("digest", "id", "text_hash") if comp is None else reps.select("digest", "id", "text_hash").join(comp.select(F.col("id").alias("digest"), "comp"), "digest", "left")
    own = stored(own.withColumn("comp", F.coalesce("comp", "digest") if comp is not None else F.col("digest")), "of_class")
    least = stored(own.groupBy("comp").agg(_least_id().alias("class")), "classes")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.groupBy(F.col("a").alias("digest")).agg(F.max(F.struct("similarity", "b")).alias("best"))
    best = best.select("digest", F.col("best.b").alias("b"), "best.similarity").join(reps.select(F.col("digest").alias("b"), F.col("id").alias("linked_id")), "b")
    return own.join(least, "comp").join(best.drop("b"), "digest", "left").select("digest", F.col("id").alias("rep_id"), "class", "linked_id", "similarity")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, rep_id (least id of equal words), class_id (least id of the class), and the best verified link of the words:
    linked_id (the least id of the other words) and similarity; null for those that are alone."""
    sketches, *rest = linked(docs, **options)
    classes = stored(_classes(sketches, *rest), "of_words")
    return sketches.select("digest", F.col("id").alias("doc_id")).join(classes, "digest").select("doc_id", "rep_id", F.col("class.id").alias("class_id"), "linked_id", "similarity")


def _star_pairs(now: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold several components, each with its bucket's centre, where that is of another component.

    Buckets of the first round tend to have the same centre, so that a class costs few comparisons; later ones differ.
    """
    centres = now.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", *([F.lit(turn), "bucket"] if turn else [])), "id", "n", "comp")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    centres = centres.where("lo != hi").select("bucket", F.col("c.id").alias("other"), F.col("c.n").alias("other_n"), F.col("c.comp").alias("other_comp"))
    return now.join(centres, "bucket").where("comp != other_comp").select("id", "n", "other", "other_n")


def binned(text: Column, bins: int = BINS) -> Column:
    """Number of a text's runs of words in each bin, by hash: array<int>."""

    @F.arrow_udf("array<int>")
    @freeing
    def counted(texts: pa.Array) -> pa.Array:
        rows = []
        for some in slices(as_large(texts), 1 << 20):
            owner, hashes = shingles(Words(some))
            at = owner * bins + (hashes >> _U(40)).astype(np.int64) % bins
            rows.append(np.bincount(at, minlength=len(some) * bins).astype(np.int32))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bins), pa.array(flat))

    return counted(text)


def can_reach(similarity: float, a: str, b: str, n_a: str, n_b: str) -> Column:
    """Whether two documents with bins a and b and n_a and n_b runs may have the similarity; true for all that have it."""
    lesser = F.zip_with(a, b, lambda x, y: F.least(x, y))
    shared = F.aggregate(lesser, F.lit(0), lambda total, x: total + x)
    return shared * (1 + similarity) >= similarity * (F.col(n_a) + F.col(n_b)) - 1e-6


def runs_of_words(text: Column) -> Column:
    """Distinct runs of words of a text: array of (hash, count)."""

    @F.arrow_udf("array<struct<h: bigint, c: bigint>>")
    @freeing
    def runs(texts: pa.Array) -> pa.Array:
        lens, hashes, counts = [], [], []
        for some in slices(as_large(texts), 1 << 20):
            owner, h, c = multisets(Words(some))
            lens.append(np.bincount(owner, minlength=len(some)))
            hashes.append(h.view(np.int64))
            counts.append(c)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lens, hashes, counts)]
        pairs = pa.StructArray.from_arrays([pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64())], ["h", "c"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat[0])]).astype(np.int32)), pairs)

    return runs(text)


def _rest_pairs(now: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs of documents of different components in shared buckets that can reach the similarity, by a prefix filter.

    Runs are put in one order for all documents: those that only one component has, then the rest, rarest first. Two
    documents share no more than what each has from their first common run on. So a run that comes after `before` others
    of a document of n runs can be the first one shared with a linked document of at most `reach` runs, where
    n - before = similarity / (1 + similarity) * (n + reach); it is an entry if any document can be that small. Entries
    meet by run, within reach of each other. A document whose own runs fill its prefix has no entry at all.
    `earlier` holds some of the entries before, and spares pairs that meet there already.
    """
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    rest = now.join(mixed, "bucket", "left_semi").select("id", "n", "comp").distinct()
    runs = rest.join(held.select("id", "text"), "id").select("id", "n", "comp", F.explode(runs_of_words(F.col("text"))).alias("r"))
    runs = stored(runs.select("id", "n", "comp", "r.h", "r.c"), "runs")
    crossing = runs.groupBy("h").agg(F.count("*").alias("docs"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("h", "docs")
    of_doc = Window.partitionBy("id")
    order = of_doc.orderBy("docs", "h")
    placed = runs.join(crossing, "h").withColumn("left", F.sum("c").over(of_doc) - F.sum("c").over(order) + F.col("c"))
    reach = F.floor(F.col("left") * ((1 + similarity) / similarity) - F.col("n") + 1e-6)
    entries = placed.withColumn("reach", reach).where(F.col("reach") >= similarity * F.col("n") - 1e-6)
    entries = stored(entries.withColumn("earlier", F.collect_list("h").over(order.rowsBetween(-16, -1))).select("h", "id", "n", "comp", "reach", "earlier"), "entries")
    other = entries.select("h", *(F.col(c).alias(f"other_{c}") for c in ("id", "n", "comp", "reach", "earlier")))
    meet = entries.join(other, "h").where("comp != other_comp and id < other_id and n <= other_reach and other_n <= reach and not arrays_overlap(earlier, other_earlier)")
    return meet.select("id", "n", F.col("other_id").alias("other"), "other_n")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each class: the one with the least id (of several with that id, the one whose
    text has the least hash). Of rows equal in id and text one stays. Rows without an id all stay."""
    sketches, *rest = linked(docs, id_col=id_col, text_col=text_col)
    classes = stored(_classes(sketches, *rest).select("digest", "class"), "of_words")
    own = sketches.where("id is not null").join(classes, "digest")
    gone = own.where((F.col("id") != F.col("class.id")) | (F.col("text_hash") != F.col("class.text_hash"))).select(F.xxhash64("id").alias("id_hash"), "text_hash").distinct()
    by_id, by_text, once = (free_name(docs, f"barloom_{x}") for x in ("id_hash", "text_hash", "row_without_id"))
    rows = docs.withColumns({by_id: F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), by_text: F.xxhash64(text_col), once: F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())})
    rows = rows.join(gone.withColumnsRenamed({"id_hash": by_id, "text_hash": by_text}), [by_id, by_text], "left_anti")
    return rows.dropDuplicates([by_id, by_text, once]).select(docs.columns)
