import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.llm import arrays, lm

from .conftest import crc


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def brute(train, texts):
    """Base scores and interpolated modified Kneser-Ney of order two, word by word."""
    lines = [tokens(t) for t in train]
    words = Counter(w for line in lines for w in line)
    pairs = Counter(p for line in lines for p in zip(["<"] + line, line))
    n, v = sum(words.values()), len(words)
    follows = Counter(w for _, w in pairs)
    after = defaultdict(list)
    for (a, _), c in pairs.items():
        after[a].append(c)
    d2 = lm.discounts([sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = lm.discounts([sum(c == i for c in follows.values()) for i in (1, 2, 3, 4)])
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    total = sum(follows.values())
    rest = sum(cut(c, d1) for c in follows.values()) / total if total else 1

    def lower(w):
        return (max(follows[w] - cut(follows[w], d1), 0) / total if total else 0) + rest / (v + 1)

    def p(a, w):
        if a not in after:
            return lower(w)
        s = sum(after[a])
        c = pairs[a, w]
        return max(c - cut(c, d2), 0) / s + sum(cut(x, d2) for x in after[a]) / s * lower(w)

    out = []
    for t in texts:
        line = tokens(t)
        out.append((len(line), sum(words[w] > 0 for w in line), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in line), sum(math.log10(p(a, w)) for a, w in zip(["<"] + line, line))))
    return out, p, words


@pytest.mark.parametrize("name,buckets", [("odd_docs", None), ("docs", None), ("docs", 300)])
def test_matches_brute_force(request, monkeypatch, name, buckets):
    """With 300 buckets there are about 900 files, and more common words."""
    monkeypatch.setattr(lm, "COMMON", 1000 if buckets is None else 20)
    docs = request.getfixturevalue(name)
    if name == "docs":
        docs = docs.where("doc_id < 300")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    train = [t for i, t in rows if i is None or crc(i, 7) != 2]
    model = lm.train(docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"), buckets=buckets)
    assert buckets is None or len(model.common) > 10 and model.parts.max() > 1
    got = {}
    for r in lm.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want, p, words = brute(train, [t for _, t in rows])
    expected = {}
    for (i, _), w in zip(rows, want):
        expected.setdefault(i, []).append(w)
    assert got.keys() == expected.keys()
    for i in got:
        for a, b in zip(sorted(got[i]), sorted(expected[i])):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
    for before in [*list(words)[:5], "<", "never seen"]:
        assert sum(p(before, w) for w in words) + p(before, "unknown word") == pytest.approx(1)


def test_better_than_word_counts_on_held_out_text(docs):
    model = lm.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"))
    held = lm.score(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"), model)
    base, own = held.selectExpr("sum(base_score)", "sum(score)").first()
    assert own > base


def test_nothing_to_learn_from(no_docs, odd_docs):
    model = lm.train(no_docs)
    assert {r.n_known for r in lm.score(odd_docs, model).collect()} == {0}
    assert lm.score(no_docs, model).collect() == []


def test_files_of_arrays(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "OPEN_FILES", 3)
    arrays._open.clear()
    for i in range(9):
        arrays.save(f"file://{tmp_path}/{i}", {"a": np.arange(i), "b": np.full(i, 7, np.uint32)})
    for i in [*range(9), 3, 8, 3]:
        got = arrays.load(f"{tmp_path}/{i}")
        assert got["a"].tolist() == list(range(i)) and got["b"].tolist() == [7] * i and len(arrays._open) <= 3
    assert arrays.load(f"{tmp_path}/none") is None
