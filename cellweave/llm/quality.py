"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A text's features are n-grams hashed into `buckets`: words and pairs of words, and shapes and pairs and triples of shapes
(a word's shape has a letter for each run of small letters, capitals and digits, other bytes as they are, and tells whether
the word repeats the one before).  Raw counts are taken over all documents; target counts over a sample of rows labelled as
good, at most about `sample` (the bound holds whatever the table's size).  A document's log weight is the sum over its
features of log(target / raw).

Sampling without replacement by Gumbel top-k: each weight gets Gumbel noise (from a hash of the id, so that a run can be
repeated) and the k greatest are selected.  k is the number of documents whose weight passes the threshold that best parts
the labelled training rows; it can also be given.  The k-th greatest is found by counting, 65,536 ranges at a time, so
nothing is sorted; of rows equal at that place all are selected.

Cases: null and empty texts have weight 0; repeated rows share a fate; without labelled rows of both kinds all are selected;
a null id has noise like any other; very long texts are featured whole, and the threshold is sought among all weights; extra
columns, whatever they are called, stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, byte_class, cut, grams, mix, within, words
from .shared import keep, spare

BUCKETS = 1 << 15
#: Rows labelled as good from which the target model is counted, about.
SAMPLE_ROWS = 20_000
#: Added to a bucket's counts, seen and expected: what is rare tells nothing.
PRIOR = 5.0
#: A share of good rows lost weighs as much as so many times that share of the others kept.
KEEP = 4
#: Keys are compared in steps of 2^-20.
_STEP = 1 << 20
WEIGHT = "log_weight"
_LOWEST = -(1 << 47)

_WORDS = byte_class(lower=True, alnum=False)
_PLAIN = byte_class(lower=True, alnum=True)[0]


def _shape_bytes() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint8)
    shape[0x61:0x7B] = ord("a")
    shape[0x80:] = ord("a")
    shape[0x41:0x5B] = ord("A")
    shape[0x30:0x3A] = ord("0")
    return shape


_SHAPE = _shape_bytes()


def features(block: Block, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the block's texts, and the text of each."""
    w = words(block.data, block.offsets, _WORDS)
    if not len(w):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the first byte of each run of a class, for shapes
    shape = _SHAPE[block.data]
    first = np.ones(len(shape), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[w.start] = True
    inside = np.zeros(len(shape) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    runs = shape[first & inside]
    rank = np.concatenate([[0], np.cumsum(first & inside)])
    shapes = words(runs, np.append(rank[w.start], rank[w.end[-1]]), (np.ones(256, bool), np.arange(256, dtype=np.uint8)))
    # words without what isn't a letter or digit, to tell repeats
    bare = block.data[_PLAIN[block.data] & inside]
    at = np.concatenate([[0], np.cumsum(_PLAIN[block.data] & inside)])
    lengths = at[w.end] - at[w.start]
    core = np.zeros(len(w), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        core[some] = words(bare, np.append(at[w.start[some]], at[w.end[some[-1]]]), (np.ones(256, bool), _WORDS[1])).hash
    text = w.text_of
    again = np.zeros(len(w), np.uint64)
    again[1:] = (core[1:] == core[:-1]) & (text[1:] == text[:-1]) & (lengths[1:] > 0)
    shape_hash = mix(shapes.hash + again)
    out, of = [], []
    for values, most, salt in ((w.hash, 2, 1), (shape_hash, 3, 11)):
        for k in range(1, most + 1):
            ok = within(w.first, k, len(w))
            g = grams(values, k)[ok]
            out.append((mix(g + np.uint64(salt + k)) % np.uint64(buckets)).astype(np.int64))
            of.append(text[: len(ok)][ok])
    return np.concatenate(out), np.concatenate(of)


def _counted(source: DataFrame, buckets: int) -> np.ndarray:
    """Feature counts over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in cut(batch):
                total += np.bincount(features(block, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = source.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.float64)
    for r in rows:  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket and, once chosen, the least key that is selected."""

    ratios: bytes
    seed: int
    least: int | None = None

    def log_ratios(self) -> np.ndarray:
        return np.frombuffer(self.ratios)

    @property
    def buckets(self) -> int:
        return len(self.ratios) // 8


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row for each labelled id that is not held out; of several labels the least holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample: int = SAMPLE_ROWS, seed: int = 7) -> Model:
    """Model of log ratios from docs (doc_id, text) and training_labels()."""
    good = labels.where("quality = 1")
    n = good.count()
    target = np.zeros(buckets)
    if n:
        share = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / n))).select("doc_id")
        target = _counted(docs.select("doc_id", "text").join(F.broadcast(share), "doc_id", "left_semi"), buckets)  # about `sample` ids at most
    raw = _counted(docs, buckets)
    expected = raw * (target.sum() / max(raw.sum(), 1))  # in as much text as the target's
    ratios = np.log((target + PRIOR) / (expected + PRIOR)) if target.any() else np.zeros(buckets)
    return Model(ratios.tobytes(), seed)


def _with_weight(source: DataFrame, model: Model, name: str = WEIGHT, *, without: tuple[str, ...] = ()) -> DataFrame:
    """source with the log weight, and without some of its columns, which then needn't leave Python."""
    names = [c for c in source.columns if c not in without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.log_ratios()
        for batch in batches:
            for block in cut(batch):
                bucket, text = features(block, model.buckets)
                weight = np.bincount(text, weights=ratios[bucket], minlength=len(block)) if len(text) else np.zeros(len(block))
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(weight)], names=[*names, name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in names), T.StructField(name, T.DoubleType())]))


def key(model: Model, doc_id: Column, weight: Column) -> Column:
    """The weight with the row's Gumbel noise, in whole steps."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(model.seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    noisy = weight - F.ln(-F.ln(u))
    return F.floor(F.greatest(F.least(noisy * _STEP, F.lit(float(1 << 46))), F.lit(-float(1 << 46)))).cast("bigint")


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight, key) of each row."""
    out = _with_weight(docs.select("doc_id", "text"), model, without=("text",))
    return out.withColumn("key", key(model, F.col("doc_id"), F.col(WEIGHT)))


def kth_greatest(keys: DataFrame, k: int) -> int:
    """The k-th greatest of column key."""
    low, bits = _LOWEST, 48
    while bits:
        bits -= 16
        part = F.shiftright(F.col("key") - F.lit(low), bits)
        counts = keys.where((part >= 0) & (part < 1 << 16)).groupBy(part.alias("part")).count().collect()
        for part_no, n in sorted(((r["part"], r["count"]) for r in counts), reverse=True):
            if n >= k:
                low += part_no << bits
                break
            k -= n
        else:
            return low
    return low


def _edge(bin_: int) -> float:
    """The least number of steps that falls into a bin of threshold()."""
    if bin_ < -2000:
        return -2000 * math.exp((-bin_ - 2000) / 1000)
    return bin_ if bin_ <= 2000 else 2000 * math.exp((bin_ - 2000) / 1000)


def threshold(weighted: DataFrame, labels: DataFrame, *, step: float = 1.0) -> float | None:
    """The log weight that best parts the labelled rows: KEEP times the share of good rows above it and the share of others below it are greatest.

    It is sought in whole steps up to 2,000, beyond that (very long texts) in steps of a thousandth of the weight.
    """
    size = F.abs(F.col(WEIGHT) / step)
    far = F.lit(2000) + F.floor(1000 * F.ln(size / 2000))
    bin_of = F.when(size < 2000, F.floor(F.col(WEIGHT) / step)).otherwise(F.when(F.col(WEIGHT) < 0, -far - 1).otherwise(far))
    bin_of = bin_of.cast("bigint")
    rows = weighted.join(labels, "doc_id").groupBy(bin_of.alias("bin")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return None
    best, at, above_good, below_bad, before = -1.0, None, good, 0, None
    for r in rows:
        if (found := KEEP * above_good / good + below_bad / bad) > best:  # a little into the gap below
            best, at = found, _edge(r["bin"]) if before is None else _edge(r["bin"]) - (_edge(r["bin"]) - _edge(before + 1)) / 8
        above_good -= r["good"]
        below_bad += r["n"] - r["good"]
        before = r["bin"]
    return float(at) * step


def choose(docs: DataFrame, labels: DataFrame, *, k: int | None = None, buckets: int = BUCKETS, sample: int = SAMPLE_ROWS, seed: int = 7) -> tuple[Model, DataFrame]:
    """The model with its selection, and weights() of all rows."""
    labels = keep(training_labels(labels), "quality labels")
    model = fit(docs, labels, buckets=buckets, sample=sample, seed=seed)
    weighted = keep(weights(docs, model), "log weights")
    if k is None:
        at = threshold(weighted, labels)
        k = weighted.count() if at is None else weighted.where(F.col(WEIGHT) >= at).count()
    least = kth_greatest(weighted.select("key"), k) if k else 1 << 62
    return Model(model.ratios, seed, least), weighted


def resample(docs: DataFrame, model: Model) -> DataFrame:
    """The selected rows of docs, with its columns."""
    name = spare(docs.columns, "__log_weight")
    weighted = _with_weight(docs, model, name)
    return weighted.where(key(model, F.col("doc_id"), F.col(name)) >= model.least).drop(name)
