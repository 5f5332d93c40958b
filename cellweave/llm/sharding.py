"""Sharding by rendezvous hashing, in DataFrame operations only.

Every shard draws a number for a record's key; the shard with the greatest weighted draw, weight / -ln(draw), takes it.
A draw depends on key and shard alone, so a new shard can only win rows for itself, and a shard's share follows its weight.

Slots number the rows of a shard from 0 without gaps.  No task sees a whole shard: its rows are dealt into chunks by hash,
numbered inside their chunk, and moved up by the counts of the chunks before it.

Cases: a null key has draws like any other; equal keys share a shard; null texts count no bytes and have the checksum of an
empty text; an empty table gives an empty table; very long texts are read for their size and checksum alone; extra columns are
not read, whatever they are called; equal rows are numbered one after the other, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

#: Rows of a chunk inside which slots are numbered, about.
CHUNK_ROWS = 4_000


def draw(key: Column, shard: int) -> Column:
    """A number between 0 and 1 (never either) that depends on the key (as text; a null is a key of its own) and the shard."""
    return (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def score(key: Column, shard: int, weight: float) -> Column:
    """What the shard bids for the key: the greatest bid wins, with a chance in proportion to the weight."""
    if not weight > 0:
        raise ValueError("weights must be positive")
    return F.lit(float(weight)) / -F.ln(draw(key, shard))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes the key; of equal bids the lowest."""
    if not weights:
        raise ValueError("there must be a shard")
    scores = F.array(*[score(key, i, w) for i, w in enumerate(weights)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def assign(df: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each row's key, size, text_crc32, shard and slot, and grown_shard: its shard with one more of mean weight.

    size is the text's bytes and 8 more.
    """
    content = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    column = F.col(key)
    shard = rendezvous(column, weights)
    grown = rendezvous(column, [*weights, sum(weights) / len(weights)])
    rows = df.select(
        column.alias("k"),
        (F.octet_length(content) + 8).cast("bigint").alias("size"),
        F.crc32(content).cast("bigint").alias("text_crc32"),
        shard.alias("shard"),
        grown.alias("grown_shard"),
    )
    rows = keep(rows, "sharded rows")  # a few numbers a row: texts are read and draws are made once
    chunks = max(1, -(-rows.count() // (chunk_rows * len(weights))))
    chunk = F.pmod(F.xxhash64(F.col("k").cast("string"), "text_crc32", "size"), F.lit(chunks))
    rows = rows.withColumn("chunk", chunk.cast("int"))
    before = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(F.col("k").asc_nulls_first(), "text_crc32", "size"))
    numbered = rows.withColumn("inside", inside)
    out = numbered.join(before, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
    return out.select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).cast("bigint").alias("slot"), "grown_shard")
