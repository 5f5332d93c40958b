"""The registered queries against their SQL."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave import catalogue

SF = "/root/testdata/sf0.001"


def plain(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert plain(got) == plain(db.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    root = pathlib.Path(entry.__file__).parent / "cellweave"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read_text(), re.M), f


ROOT = pathlib.Path(entry.__file__).parent


def registered(code: str, folder: pathlib.Path) -> set[str]:
    run = subprocess.run([sys.executable, "-B", "-W", "ignore", "-c", f"{code}\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def test_without_the_corpus_folders(tmp_path):
    shutil.copytree(ROOT / "cellweave", tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert registered("", tmp_path) == set(catalogue.QUERIES)


def test_with_a_package_that_is_missing(tmp_path):
    assert registered("import sys; sys.modules['ahocorasick'] = None", ROOT) == set(catalogue.QUERIES)


def test_without_the_pipeline(tmp_path):
    names = registered("import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, No())", ROOT)
    assert "pipeline" not in names and names >= set(catalogue.QUERIES)
