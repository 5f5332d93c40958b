"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit for each of 64 that is set in over half of its shingles' XXH64 hashes.  Distinct fingerprints
are cut into `distance + 3` blocks: two that differ in `distance` bits at most agree in three whole blocks at least.  Each
fingerprint goes out once for every choice of three blocks, and those that share a choice and its bits are compared.

A group of fingerprints that share their blocks never yields all its pairs.  In small groups each pair is compared and a
spanning forest of the links goes on.  In large ones each choice of `distance` of the other bits is blanked in turn: what is
equal then is linked, and every link shows up that way.  So a group of m costs m log m, and gives m - 1 links at most.
Copies count as one fingerprint throughout.

Cases: null and wordless texts have fingerprint zero, linked like any other; texts of fewer words than a shingle are one
shingle; repeated rows stay and share a component; a component of null ids alone has a null id; of equal least ids
one_of_each() keeps one text, told by its hash; very long texts are read whole; extra columns stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, cut
from .components import components
from .shared import forget, keep, spare

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Blocks that a choice holds.
SHARED = 3
#: Groups up to these sizes are compared pair by pair: row against row, and as a square.
FEW, SQUARE = 16, 512


def block_fingerprints(block: Block, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of a block's texts."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(block), np.int64)
    for i, text in enumerate(block.texts()):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= shingle:
            hashes.append(digest(b" ".join(words), seed))
            counts[i] = 1
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            hashes += [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
            counts[i] = len(words) - shingle + 1
    values = np.array(hashes, np.uint64)
    set_bits = np.zeros((len(block), BITS), np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(counts)
    if len(some):
        set_bits[some] = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
    majority = 2 * set_bits > counts[:, None]
    return np.packbits(majority, axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp): text_key is a 64-bit hash that tells rows of equal id apart, fp the 64 bits as a signed long."""
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in cut(batch):
                fp = block_fingerprints(block, shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_key"), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def choices(distance: int) -> list[int]:
    """Masks of all choices of SHARED from distance + SHARED blocks."""
    n = distance + SHARED
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, SHARED)]


def _forest(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Links (root, member) that span the same components."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(n)]
    members = [i for i in range(n) if roots[i] != i]
    return [roots[i] for i in members], members


def links_in_group(fps: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of distinct fingerprints that differ in bits of `free` only."""
    if len(fps) <= SQUARE:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
    else:
        found = []
        places = [1 << b for b in range(BITS) if free >> b & 1]
        for blank in combinations(places, min(distance, len(places))):
            left = fps & ~np.uint64(sum(blank))
            order = np.argsort(left, kind="stable")
            equal = np.flatnonzero(left[order[1:]] == left[order[:-1]])
            found.append(np.unique(np.sort(np.stack([order[equal], order[equal + 1]], 1), axis=1), axis=0))
        a, b = np.unique(np.concatenate(found), axis=0).T if found else (np.empty(0, int),) * 2
    a, b = _forest(a, b, len(fps))
    return fps[a], fps[b]


def _compare(choice: np.ndarray, fps: np.ndarray, masks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups; rows are sorted by choice, shared bits and fingerprint."""
    key = fps & masks[choice]
    new = np.ones(len(fps), bool)
    new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fps)))
    group = np.cumsum(new) - 1
    out_a, out_b = [], []
    few = size[group] <= FEW
    for step in range(1, FEW):
        i = np.flatnonzero(few[:-step] & (group[:-step] == group[step:])) if len(fps) > step else []
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + step]) <= distance
        out_a.append(fps[i[near]])
        out_b.append(fps[i[near] + step])
    for s, n in zip(start[size > FEW], size[size > FEW]):
        a, b = links_in_group(fps[s : s + n], ~int(masks[choice[s]]) & ((1 << BITS) - 1), distance)
        out_a.append(a)
        out_b.append(b)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links(distinct: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links between the distinct fingerprints in column fp that span all components of those within `distance` bits."""
    masks = np.array(choices(distance), np.uint64)
    rows = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))) for m in masks])).alias("choice", "shared"))
    rows = rows.repartition("choice", "shared").sortWithinPartitions("choice", "shared", "fp").select("choice", "shared", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_k, held_f = [], [], []

        def done(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _compare(c, f, masks, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            c, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.view(np.uint64)
            if not len(c):
                continue
            if held_c and (held_c[-1][-1] != c[0] or held_k[-1][-1] != k[0]):
                yield done(np.concatenate(held_c), np.concatenate(held_f))
                held_c, held_k, held_f = [], [], []
            last = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if (c[0] != c[-1] or k[0] != k[-1]) else 0
            if last:  # the last group may go on in the next batch
                yield done(np.concatenate([*held_c, c[:last]]), np.concatenate([*held_f, f[:last]]))
                held_c, held_k, held_f = [], [], []
            held_c.append(c[last:])
            held_k.append(k[last:])
            held_f.append(f[last:])
        if held_c:
            yield done(np.concatenate(held_c), np.concatenate(held_f))

    return rows.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of each row: component_id is the least doc_id reachable over links, root the least fingerprint."""
    of_docs = keep(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    least = keep(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct fingerprints")
    found = components(links(least, distance=distance)).select(F.col("node").alias("fp"), "root")
    linked = keep(least.join(found, "fp"), "linked fingerprints")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = keep(linked.join(of_root, "root").select("fp", "root", "component_id"), "components")
    forget(linked)
    mapping = least.join(moved, "fp", "left").select(F.col("fp").alias("k"), F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    mapping = keep(mapping, "component of fingerprint")
    forget(moved, least)
    return of_docs.join(mapping, of_docs.fp == mapping.k).select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without near duplicates: of each component the row of the least doc_id stays (of several texts under that id one, of equal rows one)."""
    found = keep(near_duplicates(docs, **settings), "near duplicates")
    id_, key = spare(docs.columns, "__id"), spare(docs.columns, "__key")
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("row"))
    chosen = chosen.select(F.col("row.doc_id").alias(id_), F.col("row.text_key").alias(key))
    left = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key))).select(*[F.col(f"`{c}`") for c in docs.columns])
    if found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return left
    return left.dropDuplicates(["doc_id", "text"])


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of the signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
