"""A corpus pipeline: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language_id, minhash, rank_bpe, secret_scan
from barloom.llm.common import free_name, shipped, small_batches, stored
from barloom.llm.queries import tokenizer

#: Least score of a document whose language counts as identified.
LEAST_SCORE = 0.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang is filled in where it was null. Null texts and those without a letter go;
    repeated rows stay, each judged by its text; an empty table stays empty. Columns of any name are kept."""
    profiles = language_id.learn(docs)
    found = language_id.language(F.col("text"), profiles)
    name = free_name(docs, "barloom_language")
    kept = docs.withColumn(name, found).where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce(F.col("lang"), F.col(name)["lang"])).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id. Of rows equal in id and text one stays; rows
    that share an id but not their words, rows without id, and each id's null or empty text stay; an empty table stays empty."""
    return minhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of. Null and empty texts and repeated rows stay, each judged by its
    own text; with an empty benchmark all stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text, null for a null text. Repeated rows are kept."""
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token ids of every row; null and empty texts have no ids."""
    small_batches(spark)
    ids = docs.select("doc_id", "lang", "source", rank_bpe.bpe_ids(F.col("text"), shipped(spark, tokenizer("byte_bpe_50k.json"))).alias("token_ids"))
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language ID", identify), ("near-duplicates", deduplicate), ("decontamination", decontaminated), ("secrets", redact), ("tokens", tokenize)]

#: Signatures, Markov models and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
