import hashlib
import re

import pytest
import xxhash

from cellweave.llm import winnow as w


def signed_xx(s):
    return xxhash.xxh64_intdigest(s.encode(), 42)


def pieces(text):
    out = []
    for s in re.findall(r"[^\x20\x09-\x0D]{1,4}", text):
        h = signed_xx(s)
        h -= (1 << 64) if h >> 63 else 0
        out.append(h % w._P)
    return out


def kept(text, k=w.K, window=w.WINDOW):
    p = pieces(text)
    if not p:
        return []
    gram = lambda xs: __import__("functools").reduce(lambda a, x: (a * w._BASE + x) % w._P, xs, 0)
    g = [gram(p[i : i + k]) for i in range(len(p) - k + 1)] or [gram(p)]
    out = []
    for i in range(max(1, len(g) - window + 1)):
        part = list(enumerate(g))[i : i + window]
        at, h = min(part, key=lambda x: (x[1], -x[0]))
        if (at, h) not in out:
            out.append((at, h))
    return out


def unpack(packed):
    return [(w._LAST - (x & w._LAST), x >> 31) for x in packed]


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_matches_brute_force(odd_docs, parts):
    rows = [(i, t or "") for i, t in odd_docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)
    ranked = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    want = []
    for n, (i, t) in enumerate(ranked):
        nxt = ranked[(n + 1) % len(ranked)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), edited, kept(t), kept(edited), likeness(kept(t), kept(edited)), likeness(kept(t), kept(nxt))))
    got = [(r.doc_id, r.n_chars, r.edited, unpack(r.fingerprint), unpack(r.edited_fingerprint), r.near_edited, r.near_next) for r in w.edited_fingerprints(odd_docs, parts=parts).collect()]
    key = lambda r: (str(r[0]), r[1], hashlib.sha256(r[2].encode()).hexdigest(), r[6])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_shared_spans_share_a_hash(spark):
    shared = " ".join(f"word{i}" for i in range(10))
    df = spark.createDataFrame([(1, "alpha beta " + shared + " gamma"), (2, shared + " delta epsilon")], "doc_id long, text string")
    a, b = ({h for _, h in unpack(r.f)} for r in w.with_fingerprint(df, "text", "f").collect())
    assert a & b


def test_empty_and_single(spark, no_docs):
    assert w.edited_fingerprints(no_docs).collect() == []
    (r,) = w.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert (r.edited, r.near_next) == ("abcabc", 1.0)
    (r,) = w.edited_fingerprints(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()
    assert (r.n_chars, r.edited, r.near_edited, r.near_next) == (0, "", 1.0, 1.0)
