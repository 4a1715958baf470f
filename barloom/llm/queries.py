"""The queries of this subpackage, one for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, fill_middle, filter_audit, interleave, kd_shards, language_id, minhash, personal, preference, rank_bpe, secret_scan, token_table, url_rules


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_report(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.preference_pairs(_read(spark, sf_dir, "conversations")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.media_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.bpe_digests(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_report(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(_read(spark, sf_dir, "documents"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_report(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_report(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_token_table, op2_secret_scan, op3_minhash, op4_preference, op5_decontaminate, op6_interleave, op7_rank_bpe, op8_url_rules, op9_kd_shards, op10_language_id, op11_personal, op12_filter_audit, op13_fill_middle, pipeline]
    return {f.__name__: f for f in named}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_preference": preference.SQL, "op5_decontaminate": OP5_SQL, "op12_filter_audit": filter_audit.SQL, "op13_fill_middle": fill_middle.SQL}
