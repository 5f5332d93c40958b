import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cellweave.llm import passages


def brute(rows, span=13):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    rank = lambda i: float("inf") if i is None else i
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - span + 1):
            first[tuple(w[j : j + span])] = min(first[tuple(w[j : j + span])], rank(i))
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for j in range(len(w) - span + 1):
            if first[tuple(w[j : j + span])] < rank(i):
                gone.update(range(j, j + span))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("name,settings", [("odd_docs", {}), ("odd_docs", {"group_bytes": 2000, "k": 3}), ("docs", {"group_bytes": 100_000}), ("docs", {"group_bytes": 20_000, "k": 13})])
def test_matches_brute_force(request, monkeypatch, name, settings):
    monkeypatch.setattr(passages, "AUTOMATON_WINDOWS", 500)
    monkeypatch.setattr(passages, "COMMON_GROUPS", 3)
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in passages.remove_repeated(docs, **settings).select("doc_id", "n_words", "n_removed", "kept").collect()]
    key = lambda r: tuple(map(str, r))
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] for r in want)


def test_columns_stay(odd_docs, no_docs):
    out = passages.remove_repeated(odd_docs.withColumn("kept", odd_docs.text).withColumn("start", odd_docs.doc_id).withColumn("__group", odd_docs.text).withColumn("__passages_group", odd_docs.text))
    assert out.columns == [*odd_docs.columns, "start", "__group", "__passages_group", "n_words", "n_removed", "kept"]
    assert out.count() == odd_docs.count()
    assert passages.remove_repeated(no_docs).collect() == []


@pytest.mark.parametrize("letters", [0, 4, passages.LETTERS])
def test_letters_and_numbers_alike(monkeypatch, letters):
    monkeypatch.setattr(passages, "LETTERS", letters)
    rng = random.Random(4)
    words = [b"w%d" % i for i in range(40)]
    phrases = list({b" ".join(rng.choice(words[:3]) for _ in range(rng.randrange(3, 9))) for _ in range(60)})
    first = [rng.randrange(90) for _ in phrases]
    many = [rng.random() < 0.3 for _ in phrases]
    holders = defaultdict(list)
    for p, f, m in zip(phrases, first, many):
        w = p.split()
        for i in range(len(w) - 2):
            holders[tuple(w[i : i + 3])].append((p, f, m))
    want = []
    for p in phrases:
        w = p.split()
        held = [holders[tuple(w[i : i + 3])] for i in range(len(w) - 2)]
        want.append([min(f for _, f, _ in h) if len({q for q, _, _ in h}) > 1 or any(m for _, _, m in h) else passages._NONE for h in held])
    assert passages.locate(phrases, first, many, 3) == want


def test_more_words_than_characters():
    words = [b"%d" % i for i in range(passages.LETTERS + 50)]
    phrases = [b" ".join(words[i : i + 2000]) for i in range(0, len(words), 1990)]
    found = passages.locate(phrases, list(range(len(phrases))), [False] * len(phrases), 5)
    assert all(x[-6:] == [n] * 6 and x[6] == passages._NONE for n, x in enumerate(found[:-2]) if n)


def test_a_window_in_all_groups(spark):
    line = " ".join(f"licence{i}" for i in range(13))
    rows = [(i, f"own{i} a{i} b{i} {line} c{i} d{i}") for i in range(400)]
    got = passages.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string"), group_bytes=400).select("doc_id", "n_removed").collect()
    assert {r.n_removed for r in got if r.doc_id} == {13} and [r.n_removed for r in got if not r.doc_id] == [0]


def test_automaton_finds_overlapping_windows():
    phrases = [b"a b c d", b"b c d e", b"x y z", b"b c d"]
    assert passages.locate(phrases, [5, 3, 1, 9], [False] * 4, 3) == [[passages._NONE, 3], [3, passages._NONE], [passages._NONE], [3]]


def test_words_of_a_group_are_told_a_block_at_a_time(monkeypatch):
    """A group needs no tables many times its own bytes, and the words are the same however it is cut."""
    texts = [b"", b"a bb  ccc", b" ", b"x" * 50, b"one two three four five", b"", b"end"]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    seen, whole, plain = [], passages._words(data, offsets), passages.words
    monkeypatch.setattr(passages, "BLOCK_BYTES", 12)
    monkeypatch.setattr(passages, "words", lambda d, *a: seen.append(len(d)) or plain(d, *a))
    cut = passages._words(data, offsets)
    assert len(seen) > 3 and max(seen) == 51 and all((a == b).all() for a, b in zip(whole, cut))
    assert whole[0].tolist() == [0, 0, 3, 3, 4, 9, 9, 10] and whole[2].tolist() == [1, 2, 3, 50, 3, 3, 5, 4, 4, 3]
    none = passages._words(data[:0], offsets[:1])
    assert [len(x) for x in none] == [1, 0, 0]
