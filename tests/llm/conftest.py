import random

import pytest

DOCS = "doc_id long, text string, source string, uid string, term string, node string, n int, block string, _id string, least string"


@pytest.fixture(scope="session")
def invented():
    """word(), prose(words) of a seeded random generator."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(800)]
    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))
    prose.random = r
    return prose


@pytest.fixture(scope="session")
def messy(spark, invented):
    """Rows with nulls in every column, empty, odd and very long texts, repeated rows and ids, and columns of clashing names."""
    long = invented(30_000)
    texts = [
        (1, "A plain text, with Some words."), (1, "A plain text, with Some words."), (1, "another text of the same id"), (2, None), (3, ""), (4, " \n\t "), (None, "no id at all here"), (None, "no id at all here"), (None, None),
        (5, long), (6, long + " more"), (7, "x"), (8, "\x00 odd ﻿ 𝒳 日本語 Éé"), (9, "a b"), (10, "a b"), (11, "word " * 500), (12, "<|endoftext|>"), (13, "!!! *** ### |||"), (14, "password = hunter2hunter"),
    ]
    return spark.createDataFrame([(i, t, "s" if k % 3 else None, "u", "t", "n", k, None, "i", None) for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
