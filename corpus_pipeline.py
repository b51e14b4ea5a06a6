"""A corpus pipeline over `documents`: language ID, near-duplicate removal, PII surrogates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of `documents`.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import bpe, langid, mixing, ngram_join, pii
from calibra.llm._common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; learns from the labelled rows that op4 learns from."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).filter(~F.col("rejected")).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, 0.8).

    Of rows that share an id one stays. Rows with a null id go by a hash of their text, which no real id reaches.
    """
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)).alias("node")
    rows = docs.select(*COLUMNS, node)
    found = ngram_join.link_components(rows.select(F.col("node").alias("doc_id"), "text"))
    first = found.filter("component_id = doc_id").select(F.col("doc_id").alias("node")).distinct()
    return rows.hint("merge").join(first, "node", "left_semi").dropDuplicates(["node"]).select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates and counts the characters anew."""
    made = pii.pseudonymize(docs.select(*COLUMNS), pii.key_of(spark), spans=None)
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens by source, language and topic meet tempered targets at four fifths of the tokens."""
    return mixing.sample(docs.select(*COLUMNS), budget=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each whole text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), memo_bytes=10 << 20).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", known_language), ("ngram_jaccard", distinct_texts), ("pii_surrogates", without_pii), ("source_mixing", mixed), ("byte_bpe", tokens)]
#: A trained classifier, a keyed permutation and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
