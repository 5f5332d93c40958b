"""What the registered queries return."""

import duckdb
import pytest

from cellweave.llm import queries as q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_quality": {"doc_id": "bigint", "held_out": "boolean", "log_weight": "double", "selected": "boolean"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_columns_and_rows(spark, name):
    out = q.QUERIES[name](spark, SF)
    assert {c: k for c, k in out.dtypes if c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    needed = [c for c in COLUMNS[name]]
    assert all(r[c] is not None for r in rows for c in needed)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.sql(q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_equal_texts_have_equal_fingerprints(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_text: dict = {}
    for r in q.op5_fingerprints(spark, SF).collect():
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
    assert len(set(by_text.values())) > 0.9 * len(by_text)
