import collections

import numpy as np
import pytest
from plainly import components, shingles
from test_results import near_copies

from coincide.llm import jaccard
from coincide.llm.queries import QUERIES


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    out = collections.Counter()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                out[i] += 1
                out[j] += 1
    return [out[i] for i in range(len(docs))]


@pytest.mark.parametrize("block, nbytes, shared", [(1024, 16 << 20, 4096), (4, 16 << 20, 7), (1024, 2000, 4096)])
def test_every_link_of_large_groups(spark, monkeypatch, block, nbytes, shared):
    """Links within groups of more near copies than a short list holds, exact copies among them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", nbytes)
    monkeypatch.setattr(jaccard, "SHARED", shared)
    rng = np.random.default_rng(4)
    texts = near_copies(rng, 40, 100, 6) + near_copies(rng, 30, 40, 5) + ["", None, "a b", "a b", "alone in here"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    want, least = brute([(k, t or "") for k, t in docs]), components([(k, t or "") for k, t in docs])[0]
    rows = {r.doc_id: r for r in jaccard.links(frame).collect()}
    assert [rows[k].n_links for k, _ in docs] == want and max(want) > jaccard.SHORT
    assert [rows[k].component_id for k, _ in docs] == [least[i] for i in range(len(docs))]
    sets, some, root = jaccard.join(frame)
    pairs = [tuple(r) for r in jaccard.every_link(frame, sets, root, pairs=True).collect()]
    one = {frozenset(s): None for _, t in docs if (s := shingles(t or ""))}
    assert len(pairs) == len(set(pairs)) == sum(brute_pair(x, y) for k, x in enumerate(one) for y in list(one)[:k])
    assert {tuple(r) for r in some.collect()} < set(pairs)  # those that connect are fewer


def brute_pair(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


def test_links_of_the_query(spark, small, documents):
    rows = {r.doc_id: r.n_links for r in QUERIES["op4_ngram_links"](spark, small).collect()}
    assert [rows[k] for k, _ in documents] == brute(documents)
