import hashlib
import re

import pytest

from cellweave.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, span=13):
    windows = {}
    for item, text in items:
        w = fold(text)
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = fold(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("part", [d.PART_WINDOWS, 40])
def test_matches_brute_force(spark, odd_docs, part):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    long = next(t for _, t in rows if t and len(t.split()) > 1000)
    words = long.split()
    items = [(1, " ".join(words[50:80])), (2, " ".join(words[10:20]) + "!"), (3, "One"), (4, None), (5, "..."), (None, " ".join(words[60:90])), (1, "unseen words only here"), (7, "the " * 30), (8, "日本語" * 300), (9, "A b c d e f g h i j k l m n o p")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in d.verdict(d.contamination(odd_docs.withColumn("items", odd_docs.text), bench, part_windows=part)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, items), key=key)


def test_test_data(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = [tuple(r) for r in d.verdict(d.contamination(docs, bench)).collect()]
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] for r in got)


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.verdict(d.contamination(no_docs, none)).collect() == []
    assert {r.n_hit for r in d.contamination(odd_docs, none).collect()} == {0}
