import random
import re
from itertools import combinations

import pytest

import corpus_pipeline as p
from cellweave.llm import minhash as m

from .test_simhash import roots

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")) if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4))


def near(a, b):
    return bool(a | b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)


def rows(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def test_matches_brute_force(docs):
    docs = docs.groupBy("text").agg(m.F.min("doc_id").alias("doc_id"))
    before = sorted(rows(docs))
    of = {t: shingles(t) for _, t in before}
    root = roots(set(of), lambda a, b: near(of[a], of[b]))
    seen, want = set(), set()
    for i, t in before:
        if root[t] not in seen:
            want.add((i, t))
        seen.add(root[t])
    assert len(want) < len(of) and rows(m.one_of_each(docs)) == want


def test_stage_leaves_no_near_copies(spark, docs):
    left = [shingles(t) for _, t in rows(p.STAGES[1][1](spark, docs, SF))]
    assert not [1 for a, b in combinations(left, 2) if near(a, b)]


@pytest.mark.parametrize("few", [m.FEW_KEYS, 0])
def test_odd_rows(spark, monkeypatch, odd_docs, no_docs, few):
    """With few keys to look up, and with more than can be sent to all tasks."""
    monkeypatch.setattr(m, "FEW_KEYS", few)
    before = rows(odd_docs)
    left = rows(m.one_of_each(odd_docs))
    sets = {t: shingles(t) for _, t in left}.values()
    assert left < before and not [1 for a, b in combinations(sets, 2) if near(a, b)]
    assert {x for x in before if not shingles(x[1])} <= left
    assert m.one_of_each(no_docs).collect() == []


def test_copies_edited_apart_from_each_other(spark):
    """Each is near the one they were made from, and hardly any near another: none stays beside it."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    source = [rng.choice(words) for _ in range(250)]
    texts = [" ".join(source)]
    for _ in range(400):
        own = list(source)
        for i in rng.sample(range(250), 5):
            own[i] = rng.choice(words)
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    assert all(near(sets[0], x) for x in sets) and sum(near(a, b) for a, b in combinations(sets[1:60], 2)) < 20
    rows = [(i + 1, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(1000 + i, " ".join(rng.sample(words, 200))) for i in range(50)]
    left = {r.doc_id for r in m.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert left == {1} | set(range(1000, 1050))


@pytest.mark.parametrize("part", [m.PART, 10_000])
def test_pairs_of_a_large_group_away_from_its_hub(spark, monkeypatch, part):
    """Two bands of one hash make groups of many texts that are alike by half, and in them pairs that are near each other alone: none is missed, in groups of one part and of several."""
    for name, value in (("PART", part), ("BANDS", 2), ("ROWS", 1)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    source = [rng.choice(words) for _ in range(250)]

    def edited(line, n):
        own = list(line)
        for i in rng.sample(range(250), n):
            own[i] = rng.choice(words)
        return own

    lines = [edited(source, 11) for _ in range(150)]
    texts = [" ".join(x) for line in lines for x in (line, edited(line, 3))]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    bands = {r.text: r.bands for r in m.sketches(docs).join(docs.withColumn("text_key", m.F.xxhash64("text")), "text_key").collect()}
    of = {t: shingles(t) for t in texts}
    root = roots(set(of), lambda a, b: any(x == y for x, y in zip(bands[a], bands[b])) and near(of[a], of[b]))
    want: dict = {}
    for i, t in rows:
        want.setdefault(root[t], i)
    left = {r.doc_id for r in m.one_of_each(docs).collect()}
    assert left == set(want.values()) and 150 <= len(left) < 200
