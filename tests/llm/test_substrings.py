"""Removed words against a plain version, with groups large and small."""

import hashlib
import random
import re

import numpy as np
import pytest
from plainly import SCHEMA
from pyspark.sql import functions as F

from coincide.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plainly(rows, window=20):
    """rows: (key, text); {row number: (words, words that go, what is left)}."""
    place = lambda key, at: (key is None, key if key is not None else 0, at)
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (key, _), w in zip(rows, texts):
        for at in range(len(w) - window + 1):
            seen = tuple(w[at : at + window])
            first[seen] = min(first.get(seen, place(key, at)), place(key, at))
    out = []
    for (key, _), w in zip(rows, texts):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < place(key, at):
                gone.update(range(at, at + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def corpus(seed=1, n=60):
    """Shared passages, near copies, copies, loops and one passage that a third of the rows hold."""
    draw = random.Random(seed)
    word = lambda k: " ".join(draw.choice(["wa", "wb", "wc"]) + str(draw.randrange(k)) for _ in range(draw.randrange(5, 90)))
    hot, parts = word(40) + " " + word(40), [word(30) for _ in range(8)]
    rows = []
    for i in range(n):
        text = " ".join([word(500), draw.choice(parts), word(500)] + ([hot] if i % 3 == 0 else []) + [draw.choice(parts)])
        rows.append((i * 7 % n, text))
    rows += [(n + i, rows[i][1]) for i in range(5)] + [(n + 9, "la " * 70), (n + 10, "la la lo " * 30), (n + 11, "\t\n"), (n + 12, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("group, sample, parts", [(1 << 16, 64, 1), (8, 1, 7)])
def test_plain_version(spark, rows, monkeypatch, group, sample, parts):
    """Also with groups so small that prefixes grow to whole windows."""
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "SAMPLE", sample)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    assert got(substrings.deduplicated(df)) == plainly(rows)


def test_windows_of_all_depths_are_used(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 8)
    monkeypatch.setattr(substrings, "SAMPLE", 1)
    df = spark.createDataFrame(rows, "_key bigint, text string").repartition(4)
    counted = substrings._counted(df, "text", 20)
    bits = spark.sparkContext.broadcast(substrings._bitmap(counted.where("kind = 0")))
    made = substrings._suffixes(df, "_key", "text", 20, bits, spark.sparkContext.broadcast(substrings._frequent(counted)))
    depths = {r[0] for r in made.select("depth").distinct().collect()}
    assert {0, substrings.WHOLE} < depths and len(depths) >= 4


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = substrings.deduplicated(odd)
    assert got(found) == plainly(rows) and "odd name" in found.columns


def test_shared_and_text_keys(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [("b", passage), ("b", "x " + passage), ("a", "y z " + passage), (None, passage), (None, passage), ("c", passage + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    order = {"a": 0, "b": 1, "c": 2}
    want = plainly([(order.get(k), t) for k, t in rows])
    back = {v: k for k, v in order.items()}
    assert got(substrings.deduplicated(df)) == sorted([(back.get(r[0]), *r[1:]) for r in want], key=repr)


def test_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_follow_from_the_window_alone():
    draw = np.random.default_rng(3)
    h = draw.integers(0, 6, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, low, high, _, doc = substrings.anchors(h, np.array([0, 10, 10, 200, 500]), 20)
    seen = {}
    for a, b, c, d in zip(at, low, high, doc):
        for offset in range(b, c + 1):
            window = tuple(h[a - offset : a - offset + 20])
            assert seen.setdefault(window, offset) == offset
    assert sum(high - low + 1) == 190 - 19 + 300 - 19


def test_query_digest(result, documents):
    want = {(k, n, gone, hashlib.sha256(left.encode()).hexdigest()) for k, n, gone, left in plainly(documents)}
    assert {tuple(r) for r in result("op11")} == want


def test_column_names(spark):
    df = spark.createDataFrame([(1, "a b", "q")], "doc_id bigint, text string, kept string")
    assert substrings.deduplicated(df).select(F.col("kept")).first()[0] == "a b"
