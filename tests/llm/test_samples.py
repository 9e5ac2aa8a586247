"""What is learned from given tables: discounts of the language model, the labelled sample of toxicity."""

import collections
import zlib

import numpy as np
import pytest
from plainly import words
from pyspark.sql import functions as F

from coincide.llm import katz, toxicity


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_counts_are_discounted_by_good_turing(spark, size):
    """Words and pairs of the given tables: estimates at the highest usable cut-off, never a flat half."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    lists = [[*words(r.text), "\0"] for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    one = collections.Counter(w for t in lists for w in t)
    two = collections.Counter(p for t in lists for p in zip(["\1", *t], t))
    for counts in (one, two):
        met = collections.Counter(counts.values())
        turing = lambda r: (r + 1) * met[r + 1] / met[r]  # noqa: E731, B023
        got = katz.discounted(np.array([met[r] for r in range(1, katz.KATZ + 2)], float))
        cut = max(r for r in range(1, katz.KATZ + 1) if got[r - 1] != r - katz.REST)
        assert cut >= 3 and all(0 < x < r for r, x in enumerate(got, 1))
        share = (cut + 1) * met[cut + 1] / met[1]
        for r in range(1, cut + 1):  # Katz: discounts proportional to Turing's, their mass that of the types met once
            assert got[r - 1] == pytest.approx((turing(r) - r * share) / (1 - share))
        assert sum(met[r] * (r - got[r - 1]) for r in range(1, cut + 1)) == pytest.approx(met[1])
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    lower = katz.summary(katz.word_counts(train, "text")).lower
    met = collections.Counter(one.values())
    assert np.allclose(lower, katz.discounted(np.array([met[r] for r in range(1, katz.KATZ + 2)], float)))


def test_discounts_without_usable_estimates():
    assert np.array_equal(katz.discounted(np.zeros(6)), np.arange(1, 6) - 0.5)
    assert np.array_equal(katz.discounted(np.array([0, 5, 4, 3, 2, 1.0])), np.arange(1, 6) - 0.5)
    assert np.array_equal(katz.discounted(np.array([1, 1, 1, 1, 1, 1.0])), np.arange(1, 6) - 0.5)


def test_sample_does_not_depend_on_partitions(spark):
    """Short texts are told apart by all their words; of equal ones the same row stays, whatever the partitions."""
    texts = [f"word{i}" for i in range(60)] + [f"two word{i}" for i in range(60)] + ["", None, "...", "word7", "two word7", "Two  word7"]
    texts += [f"a longer text number{i} of some words" for i in range(20)] + ["a longer text number3 of some words"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id bigint, toxic int")
    seen = []
    for n in (1, 4, 50):
        rows = toxicity.sampled(docs.repartition(n), labels.repartition(n), "doc_id", "text", "toxic", 1000)
        seen.append(sorted((r.doc_id, r._label, r._part) for r in rows.collect()))
    assert seen[0] == seen[1] == seen[2]
    kept = [i for i, _, _ in seen[0]]
    assert sum(i < 60 or i == 123 for i in kept) == 60 and sum(60 <= i < 120 or i in (124, 125) for i in kept) == 60
    assert sum(i in (120, 121, 122) for i in kept) == 1 and all(label == i % 2 for i, label, _ in seen[0])
    assert 1 <= sum(i >= 126 for i in kept) <= 20
