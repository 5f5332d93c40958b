import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.ByteBPE(PATH)


def ids(texts):
    return OWN.encode_all(texts).to_pylist()


def library(texts):
    return [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    assert ids(texts) == library(texts)
    assert OWN.count_all(texts) == [len(x) for x in library(texts)]
    assert OWN.decode_all(OWN.encode_all(texts)).to_pylist() == texts


@given(st.lists(st.sampled_from(["the", " The", "ing", "tion", "'s", "é", "  ", "\n", "<|endoftext|>", "12", "aaaa", "ab", "-" * 9, "日本"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_texts_that_merge_a_lot(parts):
    text = "".join(parts)
    assert ids([text]) == library([text])


def test_every_character(spark):
    codes = [*range(0x0, 0xD800, 7), *range(0xE000, 0x110000, 211)]
    texts = ["a" + chr(c) + "1" + chr(c) + " " + chr(c) + "!" + chr(c) for c in codes]
    assert ids(texts) == library(texts)


def test_border_check_agrees_with_plain_merging():
    rng = random.Random(2)
    tokens = [i for i in OWN.bytes if i < 50256 and len(OWN.bytes[i]) < 12]
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens[: rng.choice([300, len(tokens)])])
        assert OWN.stays_apart(a, b) == (OWN.merge(OWN.bytes[a] + OWN.bytes[b]) == [a, b])


def test_small_memories(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 10)
    own = bpe.ByteBPE(PATH)
    texts = [f"some words and number {i}, thereafter {i * i} others" for i in range(50)]
    for t in texts + texts:
        assert own.encode_all([t]).to_pylist() == library([t]) and own.count_all([t]) == [len(library([t])[0])]


def test_bytes_that_are_no_text():
    import pyarrow as pa

    rows = pa.array([[127], [], None, [50256, 127, 128]], pa.list_(pa.int32()))
    assert OWN.decode_all(rows).to_pylist() == [LIBRARY.decode(r or [], skip_special_tokens=False) for r in rows.to_pylist()]


@pytest.mark.parametrize("name", ["odd_docs", "docs", "no_docs"])
def test_operators(request, name):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = library([t or "" for _, t in rows])
    out = bpe.token_counts(bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH), PATH)
    assert out.columns == [*docs.columns, "ids", "decoded", "n_tokens"]
    got = [(r.doc_id, r.text or "", r.ids, r.decoded, r.n_tokens) for r in out.collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(((i, t or "", w, t or "", len(w)) for (i, t), w in zip(rows, want)), key=key)


def test_digest_of_the_query(spark):
    from cellweave.llm.queries import op9_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_bpe(spark, sf).collect():
        want = library([texts[r.doc_id]])[0]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBPE(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_column_is_replaced(odd_docs):
    out = bpe.token_counts(odd_docs.withColumn("n_tokens", F.lit("x")).withColumn("special", F.lit("x")).withColumn("pack", F.lit("y")), PATH)
    assert dict(out.dtypes)["n_tokens"] == "bigint"
    assert {(r.special, r.pack) for r in out.collect()} == {("x", "y")}
    short = bpe.token_counts(odd_docs, PATH, keep_text=False)
    assert short.columns == [c for c in odd_docs.columns if c != "text"] + ["n_tokens"]
    key = lambda r: (str(r.doc_id), r.n_tokens)
    assert sorted(map(key, short.collect())) == sorted(map(key, out.collect()))


def test_common_pre_tokens_and_many_packs(spark, monkeypatch):
    """Packs and buckets of a few documents, and one word in all of them."""
    docs = spark.createDataFrame([(i, f"the the end of{i} the{i % 7}") for i in range(300)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 200)
    got = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs, PATH).collect()}
    assert got == {i: len(x) for i, x in enumerate(library([f"the the end of{i} the{i % 7}" for i in range(300)]))}


def test_encoding_and_decoding_in_one_pass(odd_docs, no_docs):
    """One worker a task: the plan has a single step of Python, and the rows are those of the two operators."""
    both = bpe.bpe_encode_decode(odd_docs, PATH)
    two = bpe.bpe_decode(bpe.bpe_encode(odd_docs, PATH), PATH)
    assert both.schema == two.schema
    key = lambda r: str(tuple(r))
    assert sorted(both.collect(), key=key) == sorted(two.collect(), key=key)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    short = bpe.bpe_encode_decode(no_docs, PATH, keep_text=False)
    assert short.columns == [c for c in both.columns if c != "text"] and short.collect() == []
