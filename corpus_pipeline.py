"""The training-data pipeline: documents of a known language, one of each group of near copies, none with benchmark items,
mixed over sources to target weights, as token ids. Each stage works on all that its predecessor kept, written as Parquet
and read again. What a stage does with nulls, empty texts, repeated rows and empty tables its operator's docstring says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from karyoloom.core import plain_unions, scratch
from karyoloom.llm import crf_language, latent_decontam, mixing, token_store, vantage_simhash
from karyoloom.llm.queries import END_ID, TOKENIZER, table

ORACLE_SQL = None                # learned labels, hashes and a tokenizer are beyond SQL: tested against brute force
MIN_SCORE = 0.5                  # a text without a language that most of its words agree on is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; no letters, or no language with half of the words, rejects a document."""
    plain_unions(spark)
    field = crf_language.train_field(docs, F.lit(True))
    labelled = crf_language.predict(docs, field)
    return labelled.filter((F.col("lang_pred") != crf_language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more, that with the smallest id."""
    plain_unions(spark)
    return vantage_simhash.keep_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return latent_decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them, repeats included."""
    plain_unions(spark)
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents (doc_id, start, n_tokens, ids), written as shards and read back through their index."""
    plain_unions(spark)
    store = token_store.write_store(docs, TOKENIZER, END_ID)
    return token_store.read_documents(store, docs, "doc_id")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix),
          ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
