import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import blocks
from cellweave.llm import quality as q


def test_kth_greatest(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 46), 1 << 46) for _ in range(500)] + [7] * 40 + [rng.randrange(-50, 50) for _ in range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 37, 300, 320, 500, 640):
        assert q.kth_greatest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert df.where(df.key >= q.kth_greatest(df, 10_000)).count() == len(keys)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model, weighted = q.choose(docs, labels)
    rows = weighted.join(labels, "doc_id").where(q.held_out(q.F.col("doc_id"))).select("quality", (q.F.col("key") >= model.least).alias("s")).collect()
    assert sum(r.s for r in rows if r.quality) / sum(r.quality for r in rows) > 0.99
    assert sum(not r.s for r in rows if not r.quality) / sum(not r.quality for r in rows) > 0.97
    assert q.resample(docs, model).count() == weighted.where(q.F.col("key") >= model.least).count()


def test_k_and_noise(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, weighted = q.choose(docs, labels, k=100)
    assert weighted.where(q.F.col("key") >= model.least).count() == 100
    noise = [r[0] for r in weighted.select(q.F.col("key") / q._STEP - q.F.col("log_weight")).collect()]
    assert abs(np.mean(noise) - 0.5772) < 0.15 and abs(np.std(noise) - math.pi / math.sqrt(6)) < 0.2
    assert q.choose(docs, labels, k=0)[0].least > 1 << 60


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 0), (8, 1), (9, 0), (11, 1)], "doc_id bigint, quality int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    for known in (labels, none):
        model, weighted = q.choose(odd_docs, known)
        assert weighted.count() == odd_docs.count()
        odd_docs = odd_docs.withColumn("log_weight", q.F.lit("x"))
        out = q.resample(odd_docs, model)
        assert out.columns == odd_docs.columns and out.count() == weighted.where(q.F.col("key") >= model.least).count()
        model, weighted = q.choose(no_docs, known)
        assert weighted.collect() == [] and q.resample(no_docs, model).collect() == []
    assert q.resample(odd_docs, q.choose(odd_docs, none)[0]).count() == odd_docs.count()


M = (1 << 64) - 1
BASE, GRAM = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def hashed(data):
    return mix((sum((b + 1) * pow(BASE, j, 1 << 64) for j, b in enumerate(data)) + len(data) * BASE) & M)


def plain_features(text, buckets):
    """Words and pairs of words; shapes, pairs and triples of shapes; one after the other."""
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    kind = lambda c: ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
    shapes, before = [], None
    for w in words:
        runs = bytes(k for i, k in enumerate(map(kind, w)) if not i or k != kind(w[i - 1]))
        core = bytes(c for c in fold(w) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
        shapes.append(mix((hashed(runs) + (bool(core) and core == before)) & M))
        before = core
    out = []
    for values, most, salt in (([hashed(fold(w)) for w in words], 2, 1), (shapes, 3, 11)):
        for k in range(1, most + 1):
            for i in range(len(values) - k + 1):
                g = mix(sum(v * pow(GRAM, k - 1 - j, 1 << 64) for j, v in enumerate(values[i : i + k])) & M)
                out.append(mix((g + salt + k) & M) % buckets)
    return Counter(out)


def test_features_against_plain_python(odd_docs):
    texts = [r.text for r in odd_docs.collect() if len(r.text or "") < 3000] + ["The the THE, the! 12-34 a1B2 x_x Ünï ünï"]
    for block in blocks.cut(pa.RecordBatch.from_pylist([{"text": t} for t in texts])):
        bucket, of = q.features(block, 500)
        for i, t in enumerate(texts):
            assert Counter(bucket[of == i].tolist()) == plain_features(t, 500)


def test_log_weights_against_plain_python(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = docs.where("doc_id < 400 and length(text) < 4000")
    model, weighted = q.choose(docs, labels, buckets=300)
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    of = {i: plain_features(t, 300) for i, t in texts.items()}
    raw, target = (sum((of[i] for i in ids), Counter()) for ids in (texts, good))
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + q.PRIOR) / (raw[b] * share + q.PRIOR)) for b in range(300)}
    for r in weighted.collect():
        assert r.log_weight == pytest.approx(sum(ratio[b] * n for b, n in of[r.doc_id].items()), abs=1e-6)


def test_thresholds_of_very_long_texts(spark):
    rows = [(i, float(w), k) for i, (w, k) in enumerate([(-9e6, 0), (-8e5, 0), (-3000, 0), (7e4, 1), (8e4, 1), (5e6, 1)])]
    df = spark.createDataFrame(rows, "doc_id bigint, log_weight double, quality int")
    at = q.threshold(df.select("doc_id", "log_weight"), df.select("doc_id", "quality"))
    assert -3000 < at <= 7e4
