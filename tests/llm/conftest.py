import random
import zlib

import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, counts string, h string, part string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in all columns, empty and long texts, repeated rows, ties, and extra columns with clashing names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本語", "you", "idiot", "don't", "<|endoftext|>", "a b"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(40)
    texts = [None, "", "   \n\t", "one", "one two", shared, shared, shared + " " + line(5), line(30) + "\n" + shared, "x" * 5000, line(4000), "日本語" * 300, "the the the the " * 50, shared.upper(), "A b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p"]
    texts += [line(rng.randrange(1, 60)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or ""), "c", "h", "p") for i, t in enumerate(texts)]
    rows += [(6, shared, None, None, None, None, None, None), (6, shared, None, None, None, None, None, None), (None, shared, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, "another text with the same id", "en", "s", 1, "c", "h", "p")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m
