"""Language-model scoring: an interpolated modified Kneser-Ney model of pairs of words.

Counted in Spark, in two rounds.  The first counts words, dealt by ranges of their 64-bit hash; sorted, a word's place is its
number.  The second counts pairs of numbers, dealt by the first of the two; common first words are dealt out further by
the second, into as many parts as their counts ask for.  Tasks add up what they see before they send it, in packed arrays, and each bucket's sorted arrays go to one file
in the shared folder.  Workers map these files into memory, a bounded number at a time, and look up whole blocks of pairs.

A text's tokens are its words, A-Z in lower case, and one end.  The first word follows a begin mark, which is no token.
p(w | v) = (c(v w) - D) / c(v) + gamma(v) p(w), with the three discounts of modified Kneser-Ney, and p(w) from the number of
words that w follows, in the same way, over a uniform share for each word and one unknown.

The order is two: counts of triples, which hardly repeat in such text, would take more disk than all else together.

Cases: null and empty texts are one end; rows whose key is null are trained on; without training rows all tokens are
unknown; repeated rows count as often as they stand; very long texts are read whole; of extra columns none is read.  More than
2^32 - 1 distinct words are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .blocks import byte_class, cut, mix, words
from .shared import forget, keep, path

#: Distinct entries that a task adds up before it sends them.
HELD = 1_500_000
#: Bytes of text whose pairs a bucket gets at most, about.
BUCKET_BYTES = 32 << 20
#: First words seen more often than this, and more often than half a bucket's share, have their pairs dealt into parts.
COMMON = 1000
_TABLE = byte_class(lower=True, alnum=False)
_END = np.uint64(0x5DEECE66D1234567)
_BEGIN = 0xFFFFFFFF


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's tokens, the ends included, and where each text's tokens begin."""
    w = words(data, offsets, _TABLE)
    n = len(offsets) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(len(w) + n, np.uint64)
    end = np.zeros(len(out), bool)
    end[first[1:] - 1] = True
    out[~end] = w.hash
    out[end] = _END
    return out, first


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at, dtype=np.uint64)


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts


class _Sums:
    """Keys added up inside a task, sent in packed arrays by bucket."""

    def __init__(self, bucket_of, names: tuple[str, str, str] = ("bucket", "keys", "counts")):
        self.bucket_of, self.names, self.parts, self.n = bucket_of, names, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > 2 * HELD:
            self._compact()
            if self.n > HELD:
                yield from self.send()

    def _compact(self) -> None:
        keys, counts = _add(*(np.concatenate([p[i] for p in self.parts]) for i in (0, 1)))
        self.parts, self.n = [(keys, counts)], len(keys)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self._compact()
        keys, counts = self.parts[0]
        self.parts, self.n = [], 0
        bucket = self.bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        rows = [(int(bucket[p[0]]), keys[p].tobytes(), counts[p].astype(np.uint32).tobytes()) for p in np.split(order, at[1:])] if len(keys) else []
        if rows:
            b, k, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=list(self.names))


_PACKED = "bucket int, keys binary, counts binary"


def _unpack(table: pa.Table, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(b.as_buffer(), kind) for b in table.column("keys")]
    counts = [np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("counts")]
    return _add(np.concatenate(keys), np.concatenate(counts))


def _histogram(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Those of modified Kneser-Ney, from how many entries were seen once to four times; kept between 0 and the count."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts == 0, 0.0, np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])))


@dataclass(frozen=True)
class Vocabulary:
    """Words by ranges of their hash: a file for each bucket, with sorted hashes and counts, and one with the number of each bucket's first word."""

    folder: str
    buckets: int
    size: int = 0
    total: int = 0

    @property
    def first(self) -> np.ndarray:
        return arrays.load(f"{self.folder}/first")["first"]

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(40)) * np.uint64(self.buckets) >> np.uint64(24)).astype(np.int64)

    def _file(self, b: int) -> dict[str, np.ndarray] | None:
        return arrays.load(f"{self.folder}/words-{b}")

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        bucket, first = self.bucket_of(distinct), self.first
        for b, a, z in _runs(bucket):
            if f := self._file(b):
                at = np.searchsorted(f["keys"], distinct[a:z])
                at[at == len(f["keys"])] = 0
                known = f["keys"][at] == distinct[a:z]
                out[a:z] = np.where(known, at + first[b], -1)
                count[a:z] = np.where(known, f["counts"][at], 0)
        return out[back], count[back]


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    at = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    for a, z in zip(at, np.append(at[1:], len(sorted_values))):
        yield int(sorted_values[a]), int(a), int(z)


def count_words(docs: DataFrame, folder: str, buckets: int) -> Vocabulary:
    """Words of docs (text)."""
    shape = Vocabulary(folder, buckets)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(shape.bucket_of)
        for batch in batches:
            for block in cut(batch):
                yield from sums.add(tokens(block.data, block.offsets)[0])
        yield from sums.send()

    def store(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, counts = _unpack(table)
        arrays.save(f"{folder}/words-{b}", {"keys": keys, "counts": _narrow(counts)})
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum(dtype=np.int64))], pa.int64())})

    rows = docs.select("text").mapInArrow(see, _PACKED).groupBy("bucket").applyInArrow(store, "bucket int, n bigint, total bigint")
    n, total = np.zeros(buckets, np.int64), 0
    for r in rows.toLocalIterator():  # three numbers a bucket of BUCKET_BYTES of text
        n[r["bucket"]] = r["n"]
        total += r["total"]
    arrays.save(f"{folder}/first", {"first": np.concatenate([[0], np.cumsum(n)])})
    return Vocabulary(folder, buckets, int(n.sum()), total)


def common_words(docs: DataFrame, vocabulary: Vocabulary, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, parts) of the words whose pairs would fill a bucket, and of the begin mark, which as many words follow as there are texts.

    A part has about half a bucket's share, so there are at most twice as many parts as buckets, and words.
    """
    most = max(COMMON, vocabulary.total // (2 * vocabulary.buckets))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = vocabulary.first
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if f := vocabulary._file(b):
                    at = np.flatnonzero(f["counts"] > most)
                    yield pa.RecordBatch.from_arrays([pa.array(at + first[b]), pa.array(f["counts"][at].astype(np.int64))], names=["word", "n"])

    spark = docs.sparkSession
    rows = spark.range(vocabulary.buckets).mapInArrow(look, "word bigint, n bigint").collect()
    found = {_BEGIN: texts, **{r["word"]: r["n"] for r in rows}}
    words = np.array(sorted(found), np.uint64)
    return words, np.array([max(1, -(-found[int(w)] // most)) for w in words], np.uint64)


@dataclass(frozen=True)
class Model:
    """Pairs of word numbers, first words' sums, and how many words each word follows, by bucket."""

    words: Vocabulary
    buckets: int
    common: np.ndarray  # first words that are dealt out further
    parts: np.ndarray  # into how many parts
    common_sums: np.ndarray  # (total, once, twice, more) of the common words
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_sums: tuple[int, int, int, int]
    per_range: int

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return pair_bucket(keys, self.common, self.parts, self.buckets)

    def _follow_probability(self, w: np.ndarray) -> np.ndarray:
        """p(w) by the words that w follows; w = -1 is unknown."""
        distinct, back = np.unique(w, return_inverse=True)
        seen = np.zeros(len(distinct), np.int64)
        known = np.flatnonzero(distinct >= 0)
        for b, a, z in _runs(distinct[known] // self.per_range):
            if f := arrays.load(f"{self.words.folder}/follows-{b}"):
                seen[known[a:z]] = f["counts"][distinct[known[a:z]] - b * self.per_range]
        total, once, twice, more = self.word_sums
        d = self.word_discounts
        if not total:
            return np.full(len(w), 1.0 / (self.words.size + 1))
        left = (d[0] * once + d[1] * twice + d[2] * more) / total
        return (np.maximum(seen - _discount(seen, d), 0) / total + left / (self.words.size + 1))[back]

    def log10(self, before: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p(w | before) for word numbers; -1 is unknown, _BEGIN the begin mark."""
        lower = self._follow_probability(w)
        known = (before >= 0) & (w >= 0)
        key = np.where(before >= 0, (before.astype(np.uint64) << np.uint64(32)) | np.where(w >= 0, w, _BEGIN).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        distinct, back = np.unique(key, return_inverse=True)
        first = (distinct >> np.uint64(32)).astype(np.int64)
        count = np.zeros(len(distinct), np.int64)
        sums = np.zeros((len(distinct), 4), np.int64)
        bucket = self.bucket_of(distinct)
        order = np.argsort(bucket, kind="stable")
        for b, a, z in _runs(bucket[order]):
            if not (f := arrays.load(f"{self.words.folder}/pairs-{b}")):
                continue
            mine = order[a:z]
            for name, counts in (("once", None), ("keys", "counts")):
                if len(f[name]):
                    at = np.searchsorted(f[name], distinct[mine])
                    at[at == len(f[name])] = 0
                    hit = f[name][at] == distinct[mine]
                    count[mine[hit]] = 1 if counts is None else f[counts][at[hit]]
            if len(f["first"]):
                at = np.searchsorted(f["first"], first[mine])
                at[at == len(f["first"])] = 0
                hit = f["first"][at] == first[mine]
                sums[mine[hit]] = f["sums"].reshape(-1, 4)[at[hit]]
        if len(self.common):
            at = np.searchsorted(self.common, first.astype(np.uint64))
            at[at == len(self.common)] = 0
            hit = self.common[at] == first.astype(np.uint64)
            sums[hit] = self.common_sums[at[hit]]
        count, sums = np.where(known, count[back], 0), sums[back] * (before >= 0)[:, None]
        d = self.pair_discounts
        total = np.maximum(sums[:, 0], 1)
        left = np.where(sums[:, 0] > 0, (d[0] * sums[:, 1] + d[1] * sums[:, 2] + d[2] * sums[:, 3]) / total, 1.0)
        return np.log10(np.maximum(count - _discount(count, d), 0) / total + left * lower)


def pair_bucket(keys: np.ndarray, common: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's bucket: by its first word, and for common first words by its part."""
    first = keys >> np.uint64(32)
    at = np.searchsorted(common, first)
    at[at == len(common)] = 0
    n = np.where(common[at] == first, parts[at], np.uint64(0)) if len(common) else np.zeros(len(keys), np.uint64)
    part = np.where(n > 0, mix(keys & np.uint64(0xFFFFFFFF)) % np.maximum(n, np.uint64(1)) + np.uint64(1), np.uint64(0))
    return (mix(mix(first) + part) % np.uint64(buckets)).astype(np.int64)


def _before(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[first[:-1]] = _BEGIN
    return before


def train(docs: DataFrame, *, buckets: int | None = None) -> Model:
    """A model of docs (text); its files lie in a new folder of the shared one."""
    spark = docs.sparkSession
    folder = path(spark, "language model")
    arrays.make_folder(folder)
    total, texts = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if buckets is None:
        buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // BUCKET_BYTES))
    vocabulary = count_words(docs, folder, buckets)
    if vocabulary.size >= _BEGIN:
        raise ValueError("more distinct words than 32-bit numbers")
    common, parts = common_words(docs, vocabulary, texts)
    per_range = max(1, -(-vocabulary.size // buckets))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(lambda keys: pair_bucket(keys, common, parts, buckets))
        for batch in batches:
            for block in cut(batch):
                hashes, first = tokens(block.data, block.offsets)
                number = vocabulary.number(hashes)[0]
                yield from sums.add(_before(number, first).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))
        yield from sums.send()

    def store(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        keys, counts = _unpack(table)
        first = (keys >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.diff(first, prepend=-1))
        per_key = np.stack([counts.astype(np.int64), counts == 1, counts == 2, counts > 2], 1).astype(np.int64)
        sums = np.add.reduceat(per_key, at, axis=0)
        firsts = first[at]
        shared = np.isin(firsts.astype(np.uint64), common)
        arrays.save(f"{folder}/pairs-{b}", {"once": keys[counts == 1], "keys": keys[counts > 1], "counts": _narrow(counts[counts > 1]), "first": firsts[~shared], "sums": sums[~shared].ravel()})
        second, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        place = second.astype(np.int64) // per_range
        rows = [("range", r, second[a:z].astype(np.uint32).tobytes(), n[a:z].astype(np.uint32).tobytes(), None) for r, a, z in _runs(place)]
        rows += [("sums", int(w), None, None, x.tolist()) for w, x in zip(firsts[shared], sums[shared])]
        rows.append(("seen", -1, None, None, _histogram(counts)))
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["kind", "bucket", "keys", "counts", "n"])

    rows = docs.select("text").mapInArrow(see, _PACKED).groupBy("bucket").applyInArrow(store, "kind string, bucket bigint, keys binary, counts binary, n array<bigint>")
    rows = keep(rows, "pair counts")
    seen, sums = np.zeros(4, np.int64), np.zeros((len(common), 4), np.int64)
    added = rows.where("kind <> 'range'").groupBy("kind", "bucket").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(4)])
    for kind, word, *values in map(tuple, added.collect()):  # a row a common word, and one
        if kind == "seen":
            seen += values
        else:
            sums[np.searchsorted(common, np.uint64(word))] += values

    def follow(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        word, n = _unpack(table, np.uint32)
        counts = np.zeros(per_range, np.uint32)
        counts[word.astype(np.int64) - b * per_range] = n
        arrays.save(f"{folder}/follows-{b}", {"counts": counts})
        values = [int(n.sum(dtype=np.int64)), *_histogram(n), int((n > 2).sum())]
        return pa.table([pa.array([x], pa.int64()) for x in values], names=[f"n{i}" for i in range(6)])

    done = rows.where("kind = 'range'").select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(follow, ", ".join(f"n{i} bigint" for i in range(6)))
    n = [int(x or 0) for x in done.agg(*[F.sum(f"n{i}") for i in range(6)]).first()]
    forget(rows)
    return Model(vocabulary, buckets, common, parts, sums, discounts(seen.tolist()), discounts(n[1:5]), (n[0], n[1], n[2], n[5]), per_range)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text): log10 probabilities of the text by word counts plus one, and by the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.words
        for batch in batches:
            for block in cut(batch):
                hashes, first = tokens(block.data, block.offsets)
                number, count = v.number(hashes)
                base = np.log10((count + 1) / (v.total + v.size + 1))
                own = model.log10(_before(number, first), number)
                at = first[:-1]  # every text has a token
                columns = [np.diff(first), np.add.reduceat((count > 0).astype(np.int64), at), np.full(len(at), v.total), np.add.reduceat(base, at), np.add.reduceat(own, at)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def perplexity(n_tokens: Column, score: Column) -> Column:
    """Of a scored text, a token."""
    return F.pow(F.lit(10.0), -score / n_tokens)
