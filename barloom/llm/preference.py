"""Preference formatting with DataFrame functions only.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered
once as the prompt; what follows it on either side is a completion. A completion's mask lists the code points, counted in
prompt + completion, on which a loss is taken: the texts and end marks of assistant turns. All else is masked out.

A turn is rendered as <|role|>, a line end, its text, <|end|> and a line end. Null texts count as empty, null roles as
"unknown". Turns go by number, then role, then text; repeated turns stay. A side that is missing is null with all that
belongs to it, and its prompt is empty. Rows without a conversation id are left out. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _whole(t: Column) -> Column:
    return F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))


def _turn(t: Column) -> Column:
    return F.concat(_head(t), t["text"], F.lit("<|end|>\n"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda i: ~F.element_at(a, i).eqNullSafe(F.element_at(b, i)))
    return F.when(a.isNull() | b.isNull() | (shorter <= 0), 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, shorter))


def loss_mask(turns: Column, offset: Column) -> Column:
    """start:end of each assistant turn's text and end mark, comma-joined, if the turns are rendered from offset on."""
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = acc["at"] + F.length(_turn(t))
        span = F.array(F.concat_ws(":", start.cast("string"), (end - 1).cast("string")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.when(t["role"] == "assistant", span).otherwise(none)).alias("spans"))

    return F.aggregate(turns, F.struct(offset.alias("at"), none.alias("spans")), step, lambda acc: F.array_join(acc["spans"], ","))


def formatted(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt, completions and masks of rows (pair_id, chosen, rejected), both arrays of (role, text)."""
    rows = pairs.select("pair_id", *(F.transform(c, _whole).alias(c) for c in ("chosen", "rejected"))).withColumn("n", F.coalesce(common_prefix(F.col("chosen"), F.col("rejected")), F.lit(0)))
    prompt = F.when(F.col("n") > 0, rendered(F.slice("chosen", F.lit(1), F.col("n")))).otherwise("")
    after = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    rows = rows.select("pair_id", "n", prompt.alias("prompt"), *(F.when(F.col(c).isNotNull(), after(c)).alias(c) for c in ("chosen", "rejected")))
    masks = [loss_mask(F.col(c), F.length("prompt")).alias(f"{c}_mask") for c in ("chosen", "rejected")]
    return rows.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), "prompt", rendered(F.col("chosen")).alias("chosen"), rendered(F.col("rejected")).alias("rejected"), *masks)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected) from rows (conv_id, turn, role, text); one shuffle by pair."""
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").select(F.shiftright("conv_id", 1).alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), turn.alias("t"))
    both = rows.groupBy("pair_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("t")))).alias(c) for i, c in enumerate(("chosen", "rejected"))))
    bare = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias(c)
    return both.select("pair_id", bare("chosen"), bare("rejected"))


#: The same for DuckDB.
SQL = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM t),
m AS (SELECT a.pair_id, a.i, a.role = b.role AND a.text = b.text AS same FROM (SELECT * FROM n WHERE side = 0) a JOIN (SELECT * FROM n WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
p AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS k FROM m GROUP BY pair_id),
r AS (SELECT n.*, coalesce(p.k, 0) AS k, head || text || '<|end|>' || chr(10) AS body FROM n LEFT JOIN p USING (pair_id)),
q AS (SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY i) - length(body) AS pos FROM r)
SELECT pair_id, max(k)::BIGINT AS n_prompt_turns,
  coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= k), '') AS prompt,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 0 AND i > k), '') END AS chosen,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(body, '' ORDER BY i) FILTER (WHERE side = 1 AND i > k), '') END AS rejected,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(body) - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 0 AND i > k AND role = 'assistant'), '') END AS chosen_mask,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg((pos + length(head))::BIGINT || ':' || (pos + length(body) - 1)::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 1 AND i > k AND role = 'assistant'), '') END AS rejected_mask
FROM q GROUP BY pair_id
"""
