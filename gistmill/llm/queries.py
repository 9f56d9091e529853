"""One query per operator, over its whole table.  Each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, line_dedup, ngram_join, pii, toxicity, urls, vptree, warc
from ._shared import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Passes over 4 % of the inner products of 16,384 vectors at a recall of 0.996 (README); 1 is exact.
ANN_FACTOR = 4.0


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20, factor=ANN_FACTOR)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select("doc_id", "n_lines", "n_kept", "n_near", F.array_join("dropped", ",").alias("dropped"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted", "n_words", "n_passages", "top_excess")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of the pages table against dated lists; tables without fetch times or lists get both by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = urls.judge(urls.sample_captures(pages), urls.sample_entries(pages))
    return found.select("page_id", "url", F.col("day").cast("string").alias("day"), "n_captures", "n_active", "lists", "verdict")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.expand(turns.unionByName(odd)), ordered=True)


#: A demonstration key; a deployment passes its own.
PII_KEY = b"gistmill demonstration key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    said = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["first"], x["pseudonym"])), "|")
    return changed.select("doc_id", F.size("pii").cast("long").alias("n_pii"), said.alias("pseudonyms"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ann, op2_ngram_join, op3_decontaminate, op4_line_dedup, op5_toxicity, op6_urls, op7_warc, op8_chat, op9_pii, op10_bpe)}
