import random

import pytest
from plainly import SCHEMA

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta", "of", "the", "it"]) + random.Random(i).choice("xyz") for i in range(30_000))
def odd_rows():
    texts = [None, "", "   \n\t ", "a", "A", "é", "12 34", "one two three four five six", "one two three four five six",
             "One two\tthree  four five SIX", LONG, LONG, "x" * 70_000, "\u2581 <0x0A> \U0001f600 日本", "one two three four five seven",
             "!!! ??? ***", 'he said "idiot" there', "a b c d e"]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    rows += [(None, "one two three four five six", "en"), (3, "a", "en"), (None, None, None)]
    return [(i, t, lang, "s", None, 0.5, "p", "i", 7, "w", 1, "c", "q", "z", "y", "l", 9) for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long and repeated texts, null and repeated keys, and columns whose names clash."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def result(spark, small):
    """Rows of a registered query by its name's beginning, computed once."""
    from coincide.llm.queries import QUERIES

    held = {}

    def rows(name):
        full = next(q for q in QUERIES if q.startswith(name + "_"))
        if full not in held:
            held[full] = QUERIES[full](spark, small).collect()
        return held[full]

    return rows
