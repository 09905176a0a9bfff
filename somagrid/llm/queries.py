"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from somagrid.llm.bpe import compile_lexicon, digests
from somagrid.llm import backoff, cotrain, crosspoly, licences, middle, repair, repeats, secrets, topk, toxicity
from somagrid.llm.near_dups import near_duplicates
from somagrid.llm.oracles import ORACLES
from somagrid.llm.packing import pack_documents

__all__ = ["ORACLES", "QUERIES"]

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups over 2-word shingles at 80 percent."""
    return near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are never seen."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    lexicon = toxicity.learn(docs, labels, usable=~toxicity.held_out(F.col("_id")))
    return toxicity.score(docs, lexicon).select(
        F.col("id").alias("doc_id"), F.coalesce(toxicity.held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"), "clauses")


def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document under the counts of all documents."""
    return backoff.scores(table(spark, folder, "documents")).withColumn("log_score", F.round("log_score", 4))


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest integer inner products of each query vector."""
    return topk.search(table(spark, folder, "embeddings"))


def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Best licence template of every document."""
    return licences.match(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by two co-trained views."""
    docs = table(spark, folder, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, folder, "labels"))).withColumnRenamed("id", "doc_id").withColumn(
        "keep", (F.col("score") >= cotrain.KEEP))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encoding and decoding of all documents with the corpus' lexicon."""
    docs = table(spark, folder, "documents")
    return digests(docs, WORD_BPE, lexicon=compile_lexicon(docs, WORD_BPE)).withColumnRenamed("id", "doc_id")


def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for each query vector."""
    return crosspoly.search(table(spark, folder, "embeddings"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of at most 2048 tokens from all documents."""
    return pack_documents(table(spark, folder, "documents"), WORD_BPE)


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document, with the verdict of corpus-wide ownership."""
    docs = secrets.with_rows(table(spark, folder, "documents"))
    return secrets.report(secrets.scan(docs)).withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix, middle and suffix forms of every document."""
    return middle.digests(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document without those in passages of 20 words that occur earlier."""
    return repeats.digests(table(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.report(table(spark, folder, "conversations"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scores": op3_lm_scores,
    "op4_topk": op4_topk,
    "op5_licences": op5_licences,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_ann": op8_ann,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

