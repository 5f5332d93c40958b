"""Near copies by five-word shingles: MinHash bands find candidates, an exact check decides.

A text's shingles are its runs of `shingle` words (split at ASCII white space, A-Z as a-z).  It gets BANDS * ROWS least
hashes.  Candidates are texts that share all hashes of a band; those whose sets of shingles have a Jaccard index of `least` or
more are linked.  A band's group is compared in two rounds.  The first costs a text (NEIGHBOURS + 1) * BANDS comparisons at most:

* its texts are sorted by their hashes of the next band, which puts the nearest side by side, and each is compared with the
  NEIGHBOURS after it, so that groups of up to NEIGHBOURS + 1 have all their pairs compared;
* in larger ones each is compared with the group's hub as well: the text that stands in the largest groups, over all bands.
  Copies that were edited apart from each other are nearer to what they were made from than to each other, and that is the hub.

The second is the rest, exactly: where the first leaves a large group in several components, all pairs of different components
whose sizes allow the index are compared.  The group is dealt into parts of about PART shingles, by numbers of shingles and
hash, and each two parts that can hold a pair are a piece of work of their own, so a hot group is cut anywhere between tasks.
Parts of the group's greatest component are compared with the others only, so it costs its texts times those outside it.  All
texts that share a band and are near each other end up in one component; links inside a component need not all be listed.

Two texts of index s have no band in common with probability (1 - s^ROWS)^BANDS: 3 in 100,000 at 0.8.

Cases: texts of fewer words than a shingle, null ones too, are near no other; equal texts count as one, and copies of a text that
is near no other stay: SimHash takes them out before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, byte_class, cut, grams, mix, released, within, words
from .components import components
from .shared import forget, keep, spare

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
#: Texts of a band's group that each is compared with in the first round, besides the group's hub.
NEIGHBOURS = 4
#: Shingles of a part of a large group in the second round, about.
PART = 1 << 17
#: Keys up to this many (16 bytes each) are sent to all tasks, so that the texts they are looked up for stay where they are.
FEW_KEYS = 1_000_000

_WORDS = byte_class(lower=True, alnum=False)
_SALTS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)


def shingles(block: Block, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a block, by text."""
    w = words(block.data, block.offsets, _WORDS)
    ok = within(w.first, shingle, len(w))
    hashed, text = grams(w.hash, shingle)[ok], w.text_of[: len(ok)][ok]
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    return text[new], hashed[new]


def sketches(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(text_key, size, bands) of each row with a shingle: how many distinct ones, and a hash for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch):
                text, hashed = shingles(block, shingle)
                some, start = np.unique(text, return_index=True)
                bands = np.zeros((len(some), BANDS), np.uint64)
                for i in range(BANDS * ROWS if len(some) else 0):
                    least = np.minimum.reduceat((hashed ^ _SALTS[0, i]) * (_SALTS[1, i] | np.uint64(1)), start)
                    bands[:, i // ROWS] = mix(bands[:, i // ROWS] + least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                size = pa.array(np.diff(np.append(start, len(text))), pa.int64())
                yield pa.RecordBatch.from_arrays([block.column("text_key").take(pa.array(some)), size, lists], names=["text_key", "size", "bands"])

    return docs.select("text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "text_key bigint, size bigint, bands array<bigint>")


def sets(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(text_key, shingles): the distinct shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch):
                text, hashed = shingles(block, shingle)
                at = np.searchsorted(text, np.arange(len(block) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(hashed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column("text_key"), lists], names=["text_key", "shingles"])

    return docs.select("text", "text_key").mapInArrow(run, "text_key bigint, shingles array<bigint>")


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (u, v) among rows (bucket, order, text_key) sorted that way: neighbours in a bucket."""
    held = [np.empty(0, np.int64)] * 2  # the last rows, which the next batch goes on from
    for batch in batches:
        fresh = len(held[0])
        bucket, key = (np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for h, i in zip(held, (0, 2)))
        found = [(key[:0], key[:0])]
        for step in range(1, NEIGHBOURS + 1):
            same = np.flatnonzero(bucket[step:] == bucket[:-step]) if len(bucket) > step else np.empty(0, np.int64)
            same = same[same + step >= fresh]
            found.append((key[same], key[same + step]))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
        held = [bucket[-NEIGHBOURS:], key[-NEIGHBOURS:]]


def _hubs(members: DataFrame) -> DataFrame:
    """Candidates (u, v) of each text in a large group, members being (bucket, n, text_key), and the group's hub."""
    score = keep(members.groupBy("text_key").agg(F.sum("n").alias("score")), "texts in large groups")
    scored = members.select("bucket", "text_key").join(score, "text_key")
    hub = keep(scored.groupBy("bucket").agg(F.max(F.struct("score", "text_key")).alias("hub")).select("bucket", F.col("hub.text_key").alias("hub")), "hubs")
    pairs = members.join(hub, "bucket").where(F.col("text_key") != F.col("hub"))
    pairs = keep(pairs.select(F.least("text_key", "hub").alias("u"), F.greatest("text_key", "hub").alias("v")).distinct(), "texts and hubs")
    forget(score, hub)
    return pairs


def across(table: pa.Table, least: float) -> pa.Table:
    """Links (u, v) of texts of different roots, rows being (text_key, root, side, shingles): between the sides, or within the only one."""
    key, root, side = (np.array(table.column(c)) for c in ("text_key", "root", "side"))
    order = np.argsort(side, kind="stable")
    lists = table.column("shingles").combine_chunks().take(pa.array(order))
    key, root, side = key[order], root[order], side[order]
    code = np.unique(np.asarray(lists.values), return_inverse=True)[1]
    first = np.asarray(lists.offsets, np.int64)
    size = np.diff(first)
    left = int(np.searchsorted(side, 1))
    found, mark = [(key[:0], key[:0])], np.zeros(int(code.max(initial=-1)) + 1, bool)
    for i in range(left):
        other = left if left < len(key) else i + 1
        if other == len(key):
            break
        mine = code[first[i] : first[i + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[code[first[other] :]], first[other:-1] - first[other], dtype=np.int64)
        mark[mine] = False
        near = other + np.flatnonzero((root[other:] != root[i]) & (common >= least * (size[i] + size[other:] - common)))
        found.append((np.full(len(near), key[i]), key[near]))
    a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])


def _rest(members: DataFrame, near: DataFrame, of: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that the first round, which found `near`, left out: of texts of different components in large groups, members being (bucket, n, text_key, size)."""
    found = keep(components(near), "components of the first round")
    members = members.join(found, F.col("text_key") == F.col("node"), "left")
    members = keep(members.select("bucket", "n", "text_key", "size", F.coalesce("root", "text_key").alias("root")), "components in large groups")
    groups = members.groupBy("bucket", "n", "root").agg(F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("text_key")).alias("told"))
    groups = groups.groupBy("bucket", "n").agg(F.max(F.struct("many", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.bit_xor("told").alias("told"))
    groups = groups.where("roots > 1").groupBy("n", "told").agg(F.min(F.struct("bucket", F.col("main.root").alias("main"))).alias("group"))  # of groups of the same texts one
    groups = keep(groups.select("group.bucket", "group.main"), "groups of several components")
    # texts whose sizes differ by more than the index allows are two steps apart or more
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(1.001 / least))
    cell = ("bucket", "main", "step")
    texts = members.join(groups, "bucket").select("bucket", (F.col("root") == F.col("main")).alias("main"), step.alias("step"), "text_key", "size", "root")
    cells = texts.groupBy(*cell).agg(F.ceil(F.sum("size") / PART).alias("parts"))
    cells = keep(cells, "cells of large groups")
    texts = texts.join(cells, list(cell)).withColumn("part", F.pmod(F.xxhash64("text_key", F.lit(1)), F.col("parts")))
    parts = cells.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    a, b = (parts.select("bucket", F.struct("main", "step", "part").alias(name)) for name in ("a", "b"))
    work = a.join(b, "bucket").where((F.col("a") <= F.col("b")) & ~(F.col("a.main") & F.col("b.main")) & (F.abs(F.col("a.step") - F.col("b.step")) <= 1))
    work = work.select("bucket", F.xxhash64("bucket", "a", "b").alias("work"), "a", "b")
    sides = work.select("bucket", "work", F.lit(0).alias("side"), "a.*").union(work.where("a < b").select("bucket", "work", F.lit(1).alias("side"), "b.*"))
    asked = texts.join(sides, [*cell, "part"]).select("work", "side", "text_key", "root").join(of, "text_key")
    links = keep(asked.groupBy("work").applyInArrow(lambda t: released(across(t, least)), "u bigint, v bigint").distinct(), "links of the rest")
    forget(found, members, groups, cells)
    return links


def _few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are counted to be few; more are joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def links(docs: DataFrame, *, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(u, v): text keys, u < v, of texts that are near each other: as many links as their components need."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = sketches(docs, shingle=shingle).dropDuplicates(["text_key"])
    banded = sketched.select("text_key", "size", "bands", F.posexplode("bands").alias("band", "value"))
    banded = banded.select(F.xxhash64("band", "value").alias("bucket"), F.get("bands", (F.col("band") + 1) % BANDS).alias("order"), "text_key", "size")
    banded = keep(banded, "bands")
    dealt = banded.select("bucket", "order", "text_key").repartitionByRange(n, "bucket", "order", "text_key").sortWithinPartitions("bucket", "order", "text_key")
    large = keep(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NEIGHBOURS + 1), "large groups")
    members = keep(banded.select("bucket", "text_key", "size").join(large, "bucket"), "members of large groups")
    hubs = _hubs(members)
    pairs = keep(dealt.mapInArrow(_side_by_side, "u bigint, v bigint").union(hubs).distinct(), "candidates")
    forget(banded, large, hubs)
    wanted = pairs.select(F.col("u").alias("text_key")).union(pairs.select("v")).distinct()
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(_few(wanted), "text_key", "left_semi").dropDuplicates(["text_key"])
    of = keep(sets(texts, shingle=shingle), "shingles of candidates")
    a, b = (of.select(F.col("text_key").alias(k), F.col("shingles").alias(f"s_{k}")) for k in ("u", "v"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("s_u", "s_v")))
    first = keep(both.where(F.col("common") >= least * (F.size("s_u") + F.size("s_v") - F.col("common"))).select("u", "v"), "near links")
    rest = _rest(members, first, of, least)
    near = keep(first.union(rest), "all links")
    forget(members, pairs, of, first, rest)
    return near


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without near copies: of each component the row of the least doc_id stays (null last; of several texts under that id one)."""
    near = links(docs, **settings)
    found = keep(components(near), "near copies")
    id_, key = spare(docs.columns, "__id"), spare(docs.columns, "__key")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(found, F.col("text_key") == F.col("node"))
    rows = keep(rows.select("doc_id", "text_key", "root"), "rows of near copies")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row"))
    gone = rows.join(chosen, "root").where(~(F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("text_key") == F.col("row.text_key"))))
    gone = keep(gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)), "near copies that go")
    forget(near, found, rows)
    return docs.join(_few(gone), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")
