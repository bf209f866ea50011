"""Awkward tables: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

#: Names that operators use themselves; the tables hold them as extra columns.
CLASHES = ["row", "at", "key", "score", "words", "whole", "n_lines", "kept_text", "hub", "h1", "doc", "start", "size", "target", "taken", "bucket", "weight", "ts", "rule", "host"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def with_clashes(df):
    from pyspark.sql import functions as F

    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(f"extra {k}") if k % 2 else F.lit(k))
    return df


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward_texts():
    base = sentence(1, 120)
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(base.split()))
    passage = sentence(2, 60)
    return [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, "  \t\n "), (6, "one two"), (7, "One two"),
        (8, sentence(3, 20) + " " + passage + " " + sentence(4, 20)), (9, sentence(5, 30) + "\n" + passage + "\n" + sentence(6, 10)),
        (10, sentence(7, 30_000)), (11, "a b a b a b a b " * 40), (12, "Üñï çödé 　wide space " * 30),
        (None, base), (None, None), (13, sentence(8, 55)), (13, sentence(8, 55)), (13, sentence(9, 70)),
        (14, "\n\n\nline\r\n LINE \nline\n"), (15, "x" * 5000), (16, passage + " " + sentence(10, 49)), (17, passage),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(awkward_texts())]
    return with_clashes(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(0, 1, 0), (1, 1, 1), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 0, 0), (99, 1, 1), (13, 1, 0), (8, 1, 0), (9, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
