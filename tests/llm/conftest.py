"""Small tables with every odd case: nulls, empty and long texts, ties, repeats, extra columns."""

import os
import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("draw", T.StringType()),
        T.StructField("target", T.StringType()),
    ]
)


def doc_rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "日本語"]

    def prose(n: int) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(n)) + "."

    passage = prose(60)
    texts: list[str | None] = [None, "", " \t\n", "one", "two words", "<|endoftext|> a <|endoftext|>"]
    texts += [prose(r.randint(1, 120)) for _ in range(40)]
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)]
    copy = prose(50)
    texts += [copy, copy, copy.replace("w1", "w2", 1), copy.upper()]
    texts += ["a b c \x0b d\x0ce\r\nf", "x " * 400, prose(30_000), "y" * 20_000]
    texts += ["line one.\nline one.\n\nline two.\nHome | About | Login | Search\nno end"]
    rows = [
        (i, t, "en", r.choice(["a", "b", "c", None, "é"]), None if t is None else len(t), "s", "k", "h", "w")
        for i, t in enumerate(texts)
    ]
    rows += [rows[10], rows[10], (None, copy, None, None, None, None, None, None, None)]
    rows += [(None, None, None, "a", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
