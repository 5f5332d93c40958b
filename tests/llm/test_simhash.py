import re

import numpy as np
import pytest
import xxhash

from cellweave.llm import simhash as s
from cellweave.llm.components import components


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = roots({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return [(i, f"{f:016x}", least.get(root[f])) for i, f in fps]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("name", ["odd_docs", "docs"])
def test_matches_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in s.near_duplicates(docs).select("doc_id", s.hex_digits(s.F.col("fp")), "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_links_span_the_components_of_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = {b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(38, 64, (120, 3))} | {int(x) for x in rng.integers(0, 1 << 63, 300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = roots(set(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    for square in (s.SQUARE, 20):
        monkeypatch.setattr(s, "SQUARE", square)
        edges = [tuple(r) for r in s.links(df).collect()]
        linked = {frozenset(e) for e in edges}
        assert roots(set(signed), lambda a, b: frozenset((a, b)) in linked) == want
        a, b = s.links_in_group(np.array(sorted(fps), np.uint64), (1 << 64) - 1, 2)
        ends = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
        assert len(set(roots(fps, lambda x, y: frozenset((x, y)) in ends).values())) == len(set(want.values()))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 450)] + [(500, i) for i in range(600, 700)]
    both = {frozenset(e) for e in edges}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == roots(nodes, lambda a, b: frozenset((a, b)) in both)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_empty(no_docs):
    assert s.near_duplicates(no_docs).collect() == []
