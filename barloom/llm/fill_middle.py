"""Fill-in-the-middle transformation: texts cut into prefix, middle and suffix at tokens, and written in another order.

A token is a run of the letters A to Z and a to z, or any other single character. An automaton of two states (outside and
inside a run) counts them. A chunk of a text is read on its own: it yields, for either state it may be entered in, the state
in which it is left and the number of tokens that begin in it. Composing these functions in the order of the chunks gives
the state at each chunk's entry and the tokens before it; a cut after so many tokens is then looked for in the one chunk
that holds it. Texts of up to `chunk` characters are a single chunk and are cut where they lie. Longer ones are spread
chunk by chunk over the cluster, so that a giant document is scanned by many tasks; only what chunks yield, and where the
cuts lie, comes together.

What becomes of a document follows from its id and text alone, so repeated rows get the same result. A null text counts as
empty, and stays plain; a null id counts as an empty string. Texts that hold a marker stay plain, whatever their length.
transformed() keeps all columns; what it adds goes by a name that the table doesn't use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_large, bounds_of, free_name, freeing, slices, small_batches, stored, utf8

#: Markers, and the shares of plain and suffix-first results in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
CHUNK = 1 << 16
OUTSIDE, INSIDE = 0, 1


class Scan:
    """The automaton run over each text of a large_string array without nulls, as a chunk by itself.

    to[i, s] is the state in which chunk i, entered in state s, is left; count[i, s] is the number of tokens that begin in it.
    """

    def __init__(self, texts: pa.Array):
        self.raw, self.bounds = utf8(texts)
        raw, b, n = self.raw, self.bounds, len(texts)
        self.char = (raw & 0xC0) != 0x80
        letter = ((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)
        begins = self.char.copy()
        begins[1:] &= ~(letter[1:] & letter[:-1])
        filled = b[1:] > b[:-1]
        begins[b[:-1][filled]] = True
        self.tokens, self.chars = np.flatnonzero(begins), np.flatnonzero(self.char)
        self.first_token, self.first_char = np.searchsorted(self.tokens, b), np.searchsorted(self.chars, b)
        self.glued = np.zeros(n, bool)
        self.glued[filled] = letter[b[:-1][filled]]
        last = np.zeros(n, np.int64)
        last[filled] = letter[b[1:][filled] - 1]
        self.to = np.stack([np.where(filled, last, s) for s in (OUTSIDE, INSIDE)], 1)
        n_tokens = np.diff(self.first_token)
        self.count = np.stack([n_tokens, n_tokens - self.glued], 1)

    def position(self, i: np.ndarray, state: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Characters of chunk i before its token number k (from 0), if it is entered in the state; all of them if it has no such token."""
        token = self.first_token[i] + k + (self.glued[i] & (state == INSIDE))
        inside = token < self.first_token[i + 1]
        at = np.where(inside, np.append(self.tokens, 0)[np.minimum(token, len(self.tokens))], self.bounds[i + 1])
        return np.searchsorted(self.chars, at) - self.first_char[i]


def summary(text: Column) -> Column:
    """struct<chars, to, count> of a chunk: see Scan."""

    @F.arrow_udf("struct<chars: bigint, to: array<int>, count: array<bigint>>")
    @freeing
    def summed(texts: pa.Array) -> pa.Array:
        chars, to, count = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for some in slices(as_large(texts), 4 << 20):
            scan = Scan(some)
            chars.append(np.diff(scan.first_char))
            to.append(scan.to)
            count.append(scan.count)
        pairs = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * 2), pa.array(x.ravel(), kind))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(chars)), pairs(np.concatenate(to), pa.int32()), pairs(np.concatenate(count), pa.int64())], ["chars", "to", "count"])

    return summed(text)


def position(text: Column, state: Column, k: Column) -> Column:
    """Characters before token k of a chunk entered in the state."""

    @F.arrow_udf("long")
    @freeing
    def found(texts: pa.Array, states: pa.Array, tokens: pa.Array) -> pa.Array:
        s, k, out, at = states.to_numpy(zero_copy_only=False), tokens.to_numpy(zero_copy_only=False), [np.zeros(0, np.int64)], 0
        for some in slices(as_large(texts), 4 << 20):
            own = slice(at, at + len(some))
            out.append(Scan(some).position(np.arange(len(some)), s[own], k[own]))
            at += len(some)
        return pa.array(np.concatenate(out), pa.int64())

    return found(text, state, k)


def cuts_in_place(text: Column, draws: Column) -> Column:
    """struct<n, a, b> of texts that are one chunk each: tokens, and characters before the two cuts."""

    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint>")
    @freeing
    def cut(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        h = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        parts, at = [np.zeros((3, 0), np.int64)], 0
        for some in slices(as_large(texts), 4 << 20):
            scan, own = Scan(some), np.arange(len(some))
            n = scan.count[:, OUTSIDE]
            units = np.sort(h[at : at + len(some)] % (n[:, None] + 1), 1)
            parts.append(np.stack([n, *(scan.position(own, np.zeros_like(own), units[:, c]) for c in (0, 1))]))
            at += len(some)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(parts, 1)], ["n", "a", "b"])

    return cut(text, draws)


def chunks(texts: DataFrame, chunk: int) -> DataFrame:
    """(key, no, piece): the texts of (key, text) in chunks of so many characters, dealt out evenly over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text").slice(i, 1).cast(pa.large_string())
                raw, _ = utf8(text)
                at = np.flatnonzero((raw & 0xC0) != 0x80)[::chunk]
                bounds = bounds_of(np.diff(np.append(at, len(raw))))
                for j in range(0, len(at), 64):
                    own = bounds[j : j + 65]
                    pieces = pa.LargeStringArray.from_buffers(len(own) - 1, pa.py_buffer((own - own[0]).astype(np.int64)), pa.py_buffer(raw[own[0] : own[-1]].tobytes()))
                    key = pa.array([batch.column("key")[i].as_py()] * len(pieces), pa.binary())
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(j, j + len(pieces)), pa.int32()), pieces.cast(pa.string())], ["key", "no", "piece"])

    return texts.select("key", "text").mapInArrow(cut, "key binary, no int, piece string").repartition("key", "no")


def entered(yields: DataFrame) -> DataFrame:
    """(key, n, no, state, units, chars, tokens): each chunk of (key, no, s: summary) with the state it is entered in, the
    tokens and characters before it and its own tokens. A row's chunks are as many as a row may be long, so they fit in an array."""
    own = yields.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "s"))).alias("all"))
    kind = "array<struct<no: int, state: int, units: bigint, chars: bigint, tokens: bigint>>"
    start = F.struct(F.lit(OUTSIDE).alias("state"), F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("chars"), F.array().cast(kind).alias("out"))

    def compose(acc: Column, c: Column) -> Column:
        tokens = F.get(c["s"]["count"], acc["state"])
        entry = F.struct(c["no"].alias("no"), acc["state"].alias("state"), acc["units"].alias("units"), acc["chars"].alias("chars"), tokens.alias("tokens"))
        return F.struct(F.get(c["s"]["to"], acc["state"]).alias("state"), (acc["units"] + tokens).alias("units"), (acc["chars"] + c["s"]["chars"]).alias("chars"), F.concat(acc["out"], F.array(entry)).alias("out"))

    run = own.select("key", F.aggregate("all", start, compose).alias("run"))
    return run.select("key", F.col("run.units").alias("n"), F.inline("run.out"))


def cuts_by_chunks(texts: DataFrame, chunk: int) -> DataFrame:
    """(key, n, a, b) of the texts of (key, text, draws), each key once: tokens, and characters before the two cuts; null for a cut at the end."""
    pieces = stored(chunks(texts, chunk), "chunks")
    entries = stored(entered(pieces.select("key", "no", summary(F.col("piece")).alias("s"))), "entries")
    drawn = entries.join(texts.select("key", "draws"), "key")
    unit = lambda i: F.get("draws", F.lit(i)) % (F.col("n") + 1)
    cut = F.struct(F.least(unit(0), unit(1)).alias("a"), F.greatest(unit(0), unit(1)).alias("b"))
    asked = drawn.withColumn("cut", cut).select("key", "n", "no", "state", "units", "chars", "tokens", F.explode(F.create_map(F.lit("a"), F.col("cut.a"), F.lit("b"), F.col("cut.b"))).alias("side", "unit"))
    held = (F.col("unit") >= F.col("units")) & (F.col("unit") < F.col("units") + F.col("tokens"))  # a cut after all tokens is in no chunk
    asked = asked.where(held).join(pieces, ["key", "no"])
    found = asked.select("key", "side", (F.col("chars") + position(F.col("piece"), F.col("state"), F.col("unit") - F.col("units"))).alias("at"))
    found = found.groupBy("key").agg(F.max(F.when(F.col("side") == "a", F.col("at"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("at"))).alias("b"))
    return entries.select("key", "n").distinct().join(found, "key", "left")


def transformed(docs: DataFrame, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim") -> DataFrame:
    """docs, all columns, with out_col: struct<n, form, a, b, output>; a and b are the characters before the cuts, null if plain.

    out_col must be a new name; free_name() gives one.
    """
    small_batches(docs.sparkSession)
    text, hashed, key, cut = (free_name(docs, f"{out_col}_{x}") for x in ("text", "hash", "key", "cut"))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), hashed: digest})
    draw = lambda i: F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")
    draws = F.array(draw(0), draw(1))
    short = rows.where(F.length(text) <= chunk).withColumn(cut, cuts_in_place(F.col(text), draws))
    long = rows.where(F.length(text) > chunk).withColumn(key, F.unhex(F.sha2(F.concat(F.col(hashed), F.col(text)), 256)))
    once = long.select(F.col(key).alias("key"), F.col(text).alias("text"), draws.alias("draws")).dropDuplicates(["key"])
    cuts = stored(cuts_by_chunks(once, chunk), "cuts").select(F.col("key").alias(key), F.struct("n", "a", "b").alias(cut))
    long = long.join(cuts, key).select(*short.columns)
    rows = short.unionByName(long)

    t, c = F.col(text), F.col(cut)
    a, b = F.coalesce(c["a"], F.length(t).cast("long")).cast("int"), F.coalesce(c["b"], F.length(t).cast("long")).cast("int")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (draw(2) % 100 >= TRANSFORMED), "plain").when(draw(3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t) - b)
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(form == "plain", t).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    cut_at = lambda x: F.when(form != "plain", x.cast("long"))
    made = F.struct(c["n"].alias("n"), form.alias("form"), cut_at(a).alias("a"), cut_at(b).alias("b"), output.alias("output"))
    return rows.withColumn(out_col, made).drop(text, hashed, cut)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; markers are found where they stand, since transformed texts hold none."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.concat(part(1), part(3), part(2)))


def fim_report(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    rows = transformed(docs.select("doc_id", "text"), chunk)
    f = F.col("fim")
    return rows.select(
        "doc_id", f["n"].alias("n"), f["form"].alias("form"), f["a"].alias("prefix_chars"), (f["b"] - f["a"]).alias("middle_chars"),
        F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(list_aggregate(units[1:i], 'string_agg', ''), '') AS a, coalesce(list_aggregate(units[i + 1:j], 'string_agg', ''), '') AS b, coalesce(list_aggregate(units[j + 1:n], 'string_agg', ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
