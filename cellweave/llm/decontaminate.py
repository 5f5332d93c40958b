"""Benchmark decontamination by winnowing.

Words are hashed (two independent 64-bit hashes), k-grams of words get a rolling hash, and of each window of `span` words
only the k-gram with the least hash (rightmost of equals) is a fingerprint.  Two equal windows have the same least k-gram,
so every span of `span` shared words shares a fingerprint.  Document fingerprints are joined with those of the benchmark;
a hit is extended to the windows around it, whose 128-bit hashes are joined with the benchmark's windows.

The benchmark's fingerprints and windows go to all workers as sorted arrays, but only in parts of at most `part_windows`
windows: a larger benchmark is dealt into parts, and the documents are passed over once for each, with the words hit
written as bit sets to the shared folder and united.

Cases: null or wordless texts have no words, no hits; items without words have no windows; items of fewer than `span` words
are one window each; repeated rows and texts are judged alike; of repeated item ids each counts once; a null item id is
written as an empty string; very long texts are searched whole; extra columns stay, whatever they are called, but for three that
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, byte_class, cut, grams, window_minima, within, words
from .shared import keep, spare

SPAN = 13
GRAM = 5
#: Windows of the benchmark held by a worker at a time; about 60 bytes each.
PART_WINDOWS = 1_000_000

_TABLE = byte_class(lower=True, alnum=True)


def _gather(values: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """grams(values, m)[start], computed at those places only."""
    if m == 1:
        return grams(values[start], 1)
    columns = values[start[:, None] + np.arange(m)]
    return grams(columns.T.copy(), m)[0] if len(start) else np.empty(0, np.uint64)


def _minima(hashes: np.ndarray, first: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes, the starts of windows of m words inside one text, and the k-gram that stands for each window."""
    k = min(k, m)
    g = grams(hashes, k)
    start = np.flatnonzero(within(first, m, len(hashes)))
    return g, start, window_minima(g, m - k + 1)[start] if len(start) else start


class Index:
    """Fingerprints and windows of (a part of) the benchmark, as sorted arrays by window length."""

    def __init__(self, rows: list[tuple], k: int):
        self.k = k
        self.by_length: dict[int, tuple] = {}
        ids = sorted({r[0] for r in rows})
        self.ids = ids
        number = {x: i for i, x in enumerate(ids)}
        lengths: dict[int, list] = {}
        for item, m, anchors, one, two in rows:
            lengths.setdefault(m, []).append((number[item], np.frombuffer(anchors, np.uint64), np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)))
        for m, parts in lengths.items():
            anchors = np.unique(np.concatenate([p[1] for p in parts]))
            one, two = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            item = np.concatenate([np.full(len(p[2]), p[0], np.int64) for p in parts])
            order = np.lexsort((item, two, one))
            one, two, item = one[order], two[order], item[order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            at = np.flatnonzero(new)
            self.by_length[m] = (anchors, one[at], two[at], np.append(at, len(one)), item)


def _windows_of(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in cut(batch):
            a, b = (words(block.data, block.offsets, _TABLE, salt=s) for s in (0, 1))
            ids, out = block.column("item_id").to_pylist(), []
            for i, (p, q) in enumerate(zip(a.first, a.first[1:])):
                if q > p:
                    m, ends = min(span, int(q - p)), np.array([0, q - p])
                    g, start, least = _minima(a.hash[p:q], ends, m, k)
                    out.append((ids[i] or "", m, np.unique(g[least]).tobytes(), grams(a.hash[p:q], m).tobytes(), grams(b.hash[p:q], m).tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["item", "m", "anchors", "one", "two"])


def _hits(block: Block, index: Index) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First words of the texts, words hit, and the items of each text (as numbers)."""
    a = words(block.data, block.offsets, _TABLE)
    second = None
    edge = np.zeros(len(a) + 1, np.int64)
    found_text, found_items = [], []
    for m, (anchors, one, two, at, item) in index.by_length.items():
        g, start, least = _minima(a.hash, a.first, m, index.k)
        if not len(start):
            continue
        chosen = np.unique(least)
        place = np.searchsorted(anchors, g[chosen])
        place[place == len(anchors)] = 0
        hit = np.zeros(len(g), bool)
        hit[chosen] = anchors[place] == g[chosen]
        start = start[hit[least]]
        if not len(start):
            continue
        h1 = _gather(a.hash, start, m)
        place = np.searchsorted(one, h1)
        place[place == len(one)] = 0
        same = one[place] == h1
        start, place, h1 = start[same], place[same], h1[same]
        if not len(start):
            continue
        if second is None:
            second = words(block.data, block.offsets, _TABLE, salt=1).hash
        h2 = _gather(second, start, m)
        while True:  # windows of the same first hash stand side by side
            more = (two[place] != h2) & (place + 1 < len(one))
            more[more] = one[place[more] + 1] == h1[more]
            if not more.any():
                break
            place[more] += 1
        same = two[place] == h2
        start, place = start[same], place[same]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + m, -1)
        text = np.searchsorted(a.first, start, "right") - 1
        pairs = np.unique(np.stack([text, place], 1), axis=0)
        if len(pairs):
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for group in np.split(pairs, cuts):
                found_text.append(int(group[0, 0]))
                n = at[group[:, 1] + 1] - at[group[:, 1]]
                spread = np.repeat(at[group[:, 1]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found_items.append(np.unique(item[spread]))
    items: list[np.ndarray] = [np.empty(0, np.int64)] * len(block)
    for t, x in zip(found_text, found_items):
        items[t] = np.union1d(items[t], x) if len(items[t]) else x
    return a.first, np.cumsum(edge[:-1]) > 0, items


def _sum_by_text(first: np.ndarray, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[first[1:]] - total[first[:-1]]


def contamination(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM, part_windows: int = PART_WINDOWS, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, others) with n_words, n_hit (words in a window that occurs in the benchmark) and items (ids, sorted as strings).

    benchmark has item_id and text.  Columns of docs with the three names are replaced.  Without keep_text the text is left out.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be from 1 to span")
    columns = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    source = docs.select(*[F.col(f"`{c}`") for c in columns])
    bench = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(lambda it: _windows_of(it, span, k), "item string, m int, anchors binary, one binary, two binary")
    total = bench.agg(F.sum(F.octet_length("one") / 8)).first()[0] or 0
    parts = int(-(-total // part_windows)) or 1
    if parts > 1:
        bench = keep(bench, "benchmark windows")

    def index_of(part: int):
        rows = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        return docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows.toLocalIterator()], k))

    more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    shown = [c for c in columns if keep_text or c != "text"]
    if parts == 1:
        index = index_of(0)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in cut(batch):
                    first, hit, items = _hits(block, index.value)
                    lists = [[index.value.ids[i] for i in x] for x in items]
                    yield pa.RecordBatch.from_arrays([*map(block.column, shown), pa.array(np.diff(first)), pa.array(_sum_by_text(first, hit)), pa.array(lists, pa.list_(pa.string()))], names=[*shown, "n_words", "n_hit", "items"])

        return source.mapInArrow(judge, T.StructType([*(source.schema[c] for c in shown), *more]))

    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = source.select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = None
    for part in range(parts):
        index = index_of(part)

        def mark(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in cut(batch):
                    first, hit, items = _hits(block, index.value)
                    some = [i for i, x in enumerate(items) if len(x)]
                    bits = [np.packbits(hit[first[i] : first[i + 1]]).tobytes() for i in some]
                    lists = [[index.value.ids[i] for i in items[t]] for t in some]
                    rows = block.batch.take(pa.array(some, pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.string()))], names=["id", "key", "bits", "found"])

        rows = keep(keyed.mapInArrow(mark, f"id {kind}, key bigint, bits binary, found array<string>").dropDuplicates(["id", "key"]), "decontamination part")
        found = rows if found is None else found.unionByName(rows)
        index.destroy()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in row])).sum()) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3)], names=["id", "key", "hits", "found"])

    # as many bit sets a text as there are parts, at most
    united = found.groupBy("id", "key").agg(F.collect_list("bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    united = united.mapInArrow(unite, f"id {kind}, key bigint, hits bigint, found array<string>")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch):
                yield pa.RecordBatch.from_arrays([*block.batch.columns, pa.array(np.diff(words(block.data, block.offsets, _TABLE).first))], names=[*columns, "n_words"])

    counted = source.mapInArrow(count, T.StructType([*source.schema.fields, more[0]]))
    id_, key, hits, items = (spare(columns, f"__{c}") for c in ("id", "key", "hits", "found"))
    joined = counted.join(united.select(F.col("id").alias(id_), F.col("key").alias(key), F.col("hits").alias(hits), F.col("found").alias(items)), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in shown], "n_words", F.coalesce(hits, F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """Whether a row of contamination() is hit, in one word of twenty at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdict(found: DataFrame) -> DataFrame:
    """contamination() with the items counted and digested."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
