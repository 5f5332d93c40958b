"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, decontaminate, minhash, passages, quality, simhash
from cellweave.llm.shared import keep


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the rows labelled as good: what isn't selected goes."""
    model, _ = quality.choose(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.resample(docs, model)


def simhash_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: one document of each component stays."""
    return simhash.one_of_each(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash, then what it can't see: of texts whose five-word shingles have a Jaccard index of 0.8 or more one stays."""
    return minhash.one_of_each(keep(simhash_copies(spark, docs, sf_dir), "simhash"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; texts that lose nothing stay as they are."""
    found = passages.remove_repeated(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, however small a part of the text it is."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.bpe_encode_decode(docs.select("doc_id", "text"), path)
    again = F.col("decoded") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", again.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("bpe encoding", encoding),
]

#: Resampling, components and token ids are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
