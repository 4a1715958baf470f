"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hex strings. A pair of character Markov models, one of random strings
and one of ordinary identifiers, adds further spans: a run of 20 or more key characters is a secret if its log-likelihood ratio,
summed over its pairs of characters, passes `cutoff`. Base spans are cut out of a run, and what remains is judged piece by
piece, however short.

The models are trained from labelled samples: values that a base rule matches count as random, other words of 8 or more
key characters as ordinary. They come from about `sample` different texts each, those whose hashes lie in a share of all
hashes that follows from the number of different texts, so that what is learnt from is bounded however large the input is
and copies count once; the scan itself reads every whole text.

Positions are code points. Null texts count as empty: no spans. Repeated rows are kept, and further columns are ignored.
scanned() and redacted() keep all columns; what they add goes by names that the table doesn't use.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import free_name, share_of_hashes

#: The base rules as (kind, pattern, group whose length counts, least length).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
]
#: What a text must match for a rule to find anything in it.
NEEDED = {"assign": ASSIGN[:-2] + "{8,})", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
KEY, LONG = "[A-Za-z0-9+/_=-]", 20
CHARS = 96
SPANS = "array<struct<start: int, end: int, rank: int, kind: string, value: string>>"


def found(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of a pattern's matches, leftmost first and without overlap, whose group has at least `least` characters.

    The pieces between matches and the matches themselves, added up in turn, give the positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["2"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(F.length(x["2"]) >= least, span).otherwise(none)).alias("spans"))

    parts = F.transform(parts, lambda p: F.struct(p["piece"].alias("0"), p["whole"].alias("1"), p["value"].alias("2")))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """Spans of the base rules, rule by rule."""
    none = F.array().cast(SPANS)
    rules = [F.when(text.rlike(NEEDED[kind]), found(text, pattern, group, least, rank, kind)).otherwise(none) for rank, (kind, pattern, group, least) in enumerate(BASE)]
    return F.concat(*rules)


def _pairs(values: DataFrame, label: str) -> DataFrame:
    """Counts of the pairs of characters in column value; a pair's code is made of both places among printable ones."""
    place = lambda i: F.least(F.greatest(F.ascii(F.substring("value", i, F.lit(1))) - 32, F.lit(0)), F.lit(CHARS - 1))
    rows = values.where(F.length("value") >= 2).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("value") - 1)))
    return rows.select((place(F.col("i")) * CHARS + place(F.col("i") + 1)).alias("pair")).groupBy("pair").count().select(F.lit(label).alias("label"), "pair", "count")


def train(docs: DataFrame, text_col: str = "text", sample: int = 2000, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random against ordinary) by pair of characters; CHARS * CHARS numbers whatever the input."""
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where("text is not null")
    any_rule = F.col("text").rlike(NEEDED["assign"]) | F.col("text").rlike(NEEDED["access"]) | F.col("text").rlike(NEEDED["hex"])
    different = texts.agg(F.approx_count_distinct("h").alias("all"), F.approx_count_distinct(F.when(any_rule, F.col("h"))).alias("secret")).first()
    some = lambda of: share_of_hashes(F.col("h"), sample, F.lit(different[of]))
    once = lambda rows: rows.groupBy("h").agg(F.min("text").alias("text"))
    secret = once(texts.where(some("secret")).where(any_rule)).select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("value"))
    words = once(texts.where(some("all"))).select(F.explode(F.regexp_extract_all("text", F.lit(f"{KEY}{{8,}}"), F.lit(0))).alias("value"))
    ordinary = words.where(~(F.col("value").rlike(NEEDED["hex"]) | F.col("value").rlike(NEEDED["access"])) & ~F.col("value").rlike(r"[0-9]"))
    counts = {"random": [smoothing] * CHARS**2, "ordinary": [smoothing] * CHARS**2}
    for row in _pairs(secret, "random").unionByName(_pairs(ordinary, "ordinary")).collect():
        counts[row["label"]][row["pair"]] += row["count"]

    def logs(n: list[float]) -> list[float]:
        totals = [sum(n[i : i + CHARS]) for i in range(0, CHARS**2, CHARS)]
        return [math.log(x / totals[i // CHARS]) for i, x in enumerate(n)]

    return [round(a - b, 4) for a, b in zip(logs(counts["random"]), logs(counts["ordinary"]), strict=True)]


def log_ratio(value: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over a value's pairs of characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.least(F.greatest(F.ascii(c) - 32, F.lit(0)), F.lit(CHARS - 1)))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * CHARS + c))).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def without(span: Column, base: Column) -> Column:
    """What remains of a span when the base spans are cut out of it: spans of the same kind."""
    none = F.array().cast(SPANS)

    def piece(start: Column, end: Column) -> Column:
        value = F.substring(span["value"], start - span["start"] + 1, end - start)
        made = F.array(F.struct(start.alias("start"), end.alias("end"), span["rank"].alias("rank"), span["kind"].alias("kind"), value.alias("value")))
        return F.when(start < end, made).otherwise(none)

    def cut(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["spans"], piece(acc["at"], b["start"])).alias("spans"))

    touching = F.array_sort(F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])))
    start = F.struct(span["start"].alias("at"), none.alias("spans"))
    return F.aggregate(touching, start, cut, lambda acc: F.concat(acc["spans"], piece(acc["at"], span["end"])))


def scanned(docs: DataFrame, model: list[float], text_col: str = "text", cutoff: float = 15.0, out_col: str = "secrets") -> DataFrame:
    """docs, all columns, with out_col: struct<base, spans>, the spans of the base rules, and those of all rules by position.

    out_col must be a new name; free_name() gives one.
    """
    run = rf"(?<!{KEY}){KEY}{{{LONG},}}"
    text, base, more = (free_name(docs, f"{out_col}_{x}") for x in ("text", "base", "more"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn(base, base_spans(F.col(text)))
    longer = F.when(F.col(text).rlike(f"{KEY}{{{LONG}}}"), found(F.col(text), run, 0, LONG, len(BASE), "markov")).otherwise(F.array().cast(SPANS))
    rows = rows.withColumn(more, longer)
    pieces = F.flatten(F.transform(more, lambda s: without(s, F.col(base))))
    kept = F.filter(pieces, lambda s: log_ratio(s["value"], model) >= cutoff)
    spans = F.array_sort(F.concat(base, F.when(F.size(more) > 0, kept).otherwise(F.array().cast(SPANS))))
    return rows.withColumn(out_col, F.struct(F.col(base).alias("base"), spans.alias("spans"))).drop(text, base, more)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, sample: int = 2000, cutoff: float = 15.0) -> DataFrame:
    rows = scanned(docs.select("doc_id", "text"), train(docs, sample=sample), cutoff=cutoff)
    number = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    numbers = [number(kind) for kind, *_ in BASE]
    return rows.select("doc_id", *numbers, F.sha2(listed(F.array_sort("secrets.base")), 256).alias("base_sha256"), listed(F.col("secrets.spans")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "<SECRET>", sample: int = 2000, cutoff: float = 15.0) -> DataFrame:
    """docs with every span of text_col replaced by mask; overlapping spans give one mask."""
    found_in = free_name(docs, "secrets")
    rows = scanned(docs, train(docs, text_col, sample), text_col, cutoff, found_in)
    text, spans = F.col(text_col), F.col(found_in)["spans"]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
    return rows.withColumn(text_col, clean).select(docs.columns)
