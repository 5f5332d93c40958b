import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import sharding as s


@pytest.mark.parametrize("chunk", [s.CHUNK_ROWS, 5])
def test_sizes_slots_and_growth(odd_docs, docs, chunk):
    for df, n in ((odd_docs, 3), (docs, 24)):
        rows = s.assign(df, [1.0] * n, chunk_rows=chunk).collect()
        texts = Counter((t.encode() if t is not None else b"") for (t,) in df.select("text").collect())
        assert Counter((r.size, r.text_crc32) for r in rows) == sum((Counter({(len(t) + 8, zlib.crc32(t)): k}) for t, k in texts.items()), Counter())
        for shard in range(n):
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert slots == list(range(len(slots)))
        assert all(r.grown_shard in (r.shard, n) for r in rows) and {r.shard for r in rows} <= set(range(n))
        by_key = {}
        assert all(by_key.setdefault(r.doc_id, r.shard) == r.shard for r in rows)


def test_one_more_shard_takes_its_share(spark):
    df = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = s.assign(df, [1.0] * 24).collect()
    assert 700 < sum(r.grown_shard == 24 for r in rows) < 1250
    assert all(800 < n < 1200 for n in Counter(r.shard for r in rows).values())


def test_growth_is_the_larger_assignment(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    small = {r.doc_id: r.grown_shard for r in s.assign(df, [1.0] * 24).collect()}
    assert small == {r.doc_id: r.shard for r in s.assign(df, [1.0] * 25).collect()}


def test_weights(spark):
    rows = spark.range(20_000).select(s.rendezvous(F.col("id"), [1, 3]).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in rows}[1] - 15_000) < 500
    for bad in ([], [1, 0], [-1]):
        with pytest.raises(ValueError):
            spark.range(1).select(s.rendezvous(F.col("id"), bad))


def test_empty(no_docs):
    assert s.assign(no_docs, [1.0] * 4).collect() == []


def plain_draw(key, shard):
    """Spark's XXH64 of a text and a whole number, one seeding the next."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(str(key).encode(), 42))
    return ((h >> 12) + 0.5) / (1 << 52)


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.5, 0.5, 4.0]])
def test_assignment_against_plain_python(spark, weights):
    df = spark.range(-50, 1500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("y").alias("shard"), F.lit("z").alias("k"))
    bid = lambda key, ws: max(range(len(ws)), key=lambda i: (ws[i] / -math.log(plain_draw(key, i)), -i))
    for r in s.assign(df, weights).collect():
        assert (r.shard, r.grown_shard) == (bid(r.doc_id, weights), bid(r.doc_id, [*weights, sum(weights) / len(weights)]))
