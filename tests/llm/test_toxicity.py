import math
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import toxicity as t

NAMES = dict(zip(t.MARKS, t.KINDS))


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("You are an idiot.", ["personal"]),
        ("What a worthless plan", ["plain"]),
        ("You are not an idiot.", ["negated"]),
        ("Not today. You idiot!", ["personal"]),
        ("They said he was a moron", ["reported"]),
        ("I will kill you", ["threatening"]),
        ("They said you idiot. They said nothing! A moron came; we kill time", ["reported", "plain"]),
        ("Such idiots and morons, all day long", ["personal"]),
        ("We kill time", []),
        ("Nice weather", []),
        ("", []),
    ],
)
def test_clauses(text, kinds):
    assert [NAMES[k] for k in t.Grammar().kinds(text)] == kinds


def interpreted(line):
    """What the rules say of a line of symbols, clause by clause."""
    out = []
    for clause in line.split("."):
        best = None
        for i, s in enumerate(clause):
            if s not in "ish":
                continue
            near = "t" in clause[max(0, i - t.TARGET_WORDS) : i] or "t" in clause[i + 1 : i + 1 + t.TARGET_WORDS]
            if s == "h" and not near:
                continue
            weak = "weak " if s == "s" else ""
            if "n" in clause[max(0, i - t.NEGATED_WORDS) : i]:
                kind = weak + "negated"
            elif "r" in clause[:i]:
                kind = weak + "reported"
            elif s == "h":
                kind = "threatening"
            else:
                kind = (weak + "personal" if near else "weak" if weak else "plain")
            if best is None or t.KINDS.index(kind) < t.KINDS.index(best):
                best = kind
        if best:
            out.append(best)
    return out


@given(st.text(alphabet=t.SYMBOLS, max_size=60))
@settings(max_examples=1500, deadline=None)
def test_machines_against_the_rules(line):
    assert [NAMES[k] for k in t.Grammar()._kinds(line)] == interpreted(line)
    backward, forward = t.machines()
    whole, weight = forward.run(backward.run(f".{line}."[::-1])[0][::-1])
    assert [NAMES[k] for k in whole] == interpreted(line)
    assert weight == pytest.approx(sum(t.PRIOR_WEIGHTS[t.KINDS.index(k)] for k in interpreted(line)))


@given(st.text(alphabet=t.SYMBOLS, max_size=40))
@settings(max_examples=300, deadline=None)
def test_composed_is_one_after_the_other(line):
    for a, b in ((t.near_target(), t.negation()), (t.negation(), t.reported()), (t.reported(), t.clause())):
        one, w1 = a.run(line)
        two, w2 = b.run(one)
        assert t.compose(a, b).run(line) == (two, pytest.approx(w1 + w2))


@pytest.mark.parametrize("machine,line,want", [(t.near_target(), "twiwwwwi", "twpwwwwi"), (t.near_target(2), "twis.i", "twps.i".replace("s", "s")), (t.negation(), "nwiwi", "nwxwi"), (t.negation(), "n.i", "n.i"), (t.reported(), "irish.i", "iruvu.i".replace("vu", "vh")), (t.clause(), "wpix.s.x.", "psx")])
def test_each_transducer(machine, line, want):
    assert machine.run(line)[0] == want


def test_families_of_words():
    g = t.sort_out({"^badw": (50, 400.0), "^badwo": (30, 500.0), "^odds": (60, 6.0), "^oddst": (55, 400.0), "^oddsx": (9, 90.0), "bad": (8, 999.0), "^weak": (9, 5.0)})
    assert g.fronts == {"badw", "oddst"} and g.suspects == {"odds", "weak"} and "bad" in g.words


def learned(docs, labels, **kw):
    labels = t.training_labels(labels)
    grammar = t.lexicon_of(docs, labels, **kw)
    counted = t.count(docs, grammar)
    return t.score(counted, t.weigh(grammar, counted, labels))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    rows = learned(docs, labels).join(labels, "doc_id").where(t.held_out(t.F.col("doc_id"))).select("toxic", "predicted", "score").collect()
    found = sum(r.toxic and r.predicted for r in rows) / sum(r.toxic for r in rows)
    wrong = sum(not r.toxic and r.predicted for r in rows) / sum(not r.toxic for r in rows)
    assert found > 0.85 and wrong < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 0), (8, 0), (9, 1)], "doc_id bigint, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for known in (labels, none):
        rows = learned(odd_docs, known).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert learned(no_docs, known).collect() == []


def plain_score(grammar, counts):
    z, kinds = grammar.bias, [c.bit_length() for c in counts]
    for i, places in enumerate(t.HOLDS):
        level = max(kinds[p] for p in places)
        if level:
            z += grammar.weights[2 * i] + grammar.weights[2 * i + 1] * (level - 1)
    if any(x for k, x in zip(t.KINDS, kinds) if k.startswith("weak")):
        z += grammar.weights[-1] * kinds[-1]
    return 1 / (1 + math.exp(-z))


def test_scores_against_plain_python(spark, odd_docs):
    rng = random.Random(3)
    grammar = t.Grammar(suspects=frozenset({"w123", "even"}), bias=-1.5, weights=tuple(rng.uniform(-1, 2) for _ in range(2 * len(t.KINDS) + 1)))
    texts = [r.text for r in odd_docs.collect()] + ["You are an idiot. " * 9, "They said even you idiots. Not evenings! Even so: evening, you.", "I kill you " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("clauses", t.F.lit("x")).withColumn("score", t.F.lit("x"))
    rows = {r.doc_id: r for r in t.score(t.count(docs, grammar), grammar).collect()}
    for i, text in enumerate(texts):
        line = grammar.symbols(text or "")
        found = interpreted(line)
        counts = [*map(found.count, t.KINDS), line.count(".") + 1]
        assert rows[i].clauses == counts
        assert rows[i].score == pytest.approx(plain_score(grammar, counts))
    assert len({tuple(r.clauses[:-1]) for r in rows.values()}) > 3


def test_features_against_plain_python():
    texts = [("Alphabet soup, alphabets", 1), ("alpha x", 0), (None, 1), ("", 0)]
    batch = pa.RecordBatch.from_pylist([{"text": x, "toxic": y} for x, y in texts])
    got = {f: (a, b) for r in t._features(iter([batch])) for f, a, b in zip(*(r.column(i).to_pylist() for i in range(3)))}
    want = {}
    for text, label in texts:
        words = {w for w in re.findall(r"\w+", (text or "").lower()) if len(w) > 2}
        for f in words | {"^" + w[:n] for w in words for n in t.FRONTS if n <= len(w)}:
            a, b = want.get(f, (0, 0))
            want[f] = (a + label, b + 1 - label)
    assert got == want


def test_copies_count_once(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    near = [x.replace(x.split()[3], "other", 1) for x in texts[:10]]
    rows = [(i, x, i % 2) for i, x in enumerate([*texts, *texts[:5], *near, "a b", "c d", "a b"])]
    left = {r.text for r in t._one_of_copies(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")).collect()}
    assert left >= {*texts, "a b", "c d"} and len(left) < len(texts) + 2 + 5


def test_fit_finds_the_weights():
    none, one = [0] * 10, [0, 0, 1, *[0] * 7]
    bias, weights = t.fit([(none, 10, 990), (one, 95, 5)])
    assert bias < -4 and weights[4] > 5
