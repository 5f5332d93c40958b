import re

import pytest

from cellweave.llm import winnow as w

from . import test_winnow as t
from .test_winnow import likeness, unpack


def overlapping(text):
    runs = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [r[i : i + 4] for r in runs for i in range(max(1, len(r) - 3))]


def overlapping_in_long_runs(text, n=w.LONG_RUN):
    out = []
    for r in re.findall(r"[^\x20\x09-\x0D]+", text):
        i = 0
        while i < len(r):
            out.append(r[i : i + 4])
            i += 1 if len(r) - i > n else 4
    return out


def fingerprints(spark, texts, overlap=True):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [unpack(r.f) for r in w.with_fingerprint(df, "text", "f", overlap=overlap).orderBy("i").collect()]


def test_overlapping_pieces(spark, odd_docs, monkeypatch):
    own = lambda s: t.signed_xx(s) - (1 << 64) * (t.signed_xx(s) >> 63)
    monkeypatch.setattr(t, "pieces", lambda text: [own(s) % w._P for s in overlapping(text)])
    texts = [r.text or "" for r in odd_docs.collect()] + ["a😀b", "😀" * 9, "ab😀 cd😀ef 😀😀😀 x", "abcd abcde"]
    assert fingerprints(spark, texts) == [t.kept(x) for x in texts]


def test_overlap_in_long_runs_only(spark, odd_docs, monkeypatch):
    own = lambda s: t.signed_xx(s) - (1 << 64) * (t.signed_xx(s) >> 63)
    monkeypatch.setattr(t, "pieces", lambda text: [own(s) % w._P for s in overlapping_in_long_runs(text)])
    texts = [r.text or "" for r in odd_docs.collect()] + ["x" * 16 + " " + "abcdefghijklmnopqrstu" * 3 + " y", "😀" * 40 + " z"]
    assert fingerprints(spark, texts, w.LONG_RUN) == [t.kept(x) for x in texts]


@pytest.mark.parametrize("overlap", [True, w.LONG_RUN])
def test_unspaced_text_moved_by_some_characters(spark, overlap):
    text = "".join(chr(0x4E00 + i * i * 7919 % 5003) for i in range(2000))
    own, *moved = fingerprints(spark, [text, "一" + text, "一二" + text, "一二三" + text], overlap)
    assert all(likeness(own, x) > 0.95 for x in moved)
