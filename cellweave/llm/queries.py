"""The registered queries of the training-data operators: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, lm, passages, quality, sharding, simhash, sql, toxicity, winnow
from .shared import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op3_decontamination": sql.DECONTAMINATION, "op4_substring_dedup": sql.SUBSTRING_DEDUP}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.bpe_encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = bpe.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return decontaminate.verdict(found)


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 24).withColumn("law", F.lit("key"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.edited_fingerprints(table(spark, sf_dir, "documents"), overlap=winnow.LONG_RUN)
    digest = lambda name: F.sha2(winnow.rendered(F.col(name)), 256).alias(name)
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest("fingerprint"), digest("edited_fingerprint"), "near_edited", "near_next", F.size("fingerprint").alias("n_kept"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = keep(toxicity.training_labels(table(spark, sf_dir, "labels")), "toxicity labels")
    grammar = toxicity.lexicon_of(docs, labels)
    counted = keep(toxicity.count(docs, grammar), "matched clauses")
    scored = toxicity.score(counted, toxicity.weigh(grammar, counted, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "clauses")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, weighted = quality.choose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weighted.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "log_weight", (F.col("key") >= model.least).alias("selected"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = lm.score(docs, lm.train(docs.where(~held_out)))
    return scored.withColumn("held_out", held_out).withColumn("perplexity", lm.perplexity(F.col("n_tokens"), F.col("score")))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
