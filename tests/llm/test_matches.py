"""Matches of decontamination: longest ones from left to right, and many equal items in many places."""

import hashlib
import resource
import time

import numpy as np
import pyarrow as pa
import pytest

from coincide.llm import contamination


def tiles(items, text, window):
    """(at, length) from all pairs: short items where they occur; windows covered by longest matches."""
    found = set()
    for i in items:
        if 0 < len(i) < window:
            found |= {(k, len(i)) for k in range(len(text) - len(i) + 1) if text[k : k + len(i)] == i}

    def run(k):
        best = 0
        for i in items:
            for o in range(len(i)):
                n = 0
                while o + n < len(i) and k + n < len(text) and i[o + n] == text[k + n]:
                    n += 1
                best = max(best, n)
        return best if best >= window else 0

    k = end = 0
    while k < len(text):
        n = run(k)
        if n and k + window > end:
            found.add((k, n))
            end = k + n
            k = end - window
        k += 1
    return sorted(found)


@pytest.mark.parametrize("group_words", [15, 10_000])
def test_longest_matches(spark, monkeypatch, group_words):
    rng = np.random.default_rng(8)
    text = lambda n: [str(x) for x in rng.choice(list("abc"), n)]
    items, docs = [text(int(rng.integers(0, 12))) for _ in range(12)], [text(int(rng.integers(0, 50))) for _ in range(30)]
    monkeypatch.setattr(contamination, "GROUP_WORDS", group_words)
    frames = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "id bigint, text string") for rows in (docs, items)]
    rows = contamination.contamination(*frames, item_key="id", window=4, matches="longest").collect()
    none = {r.id: tuple(r) for r in contamination.contamination(*frames, item_key="id", window=4, matches=None).drop("text").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        for m in r.matches:
            assert docs[r.id][m["at"] : m["at"] + m.length] == items[int(m.item_id)][m.item_at : m.item_at + m.length]
        if group_words > 1000:
            assert sorted((m["at"], m.length) for m in r.matches) == tiles(items, docs[r.id], 4)
        hit = {k for m in r.matches for k in range(m["at"], m["at"] + m.length)}
        assert none[r.id] == (r.id, len(docs[r.id]), len(hit), r.n_items, r.items_sha256, bool(hit)) and r.n_hit == len(hit)


@pytest.mark.parametrize("matches", [None, "longest"])
def test_equal_items_and_repeated_passages_stay_linear(matches):
    """4,000 equal items, 4,000 more that share their window, and 4,000 texts that hold it."""
    passage = " ".join(f"w{k}" for k in range(10))
    texts = [passage, *(f"{passage} end{k}" for k in range(4000))]
    ids = [[f"same{k}" for k in range(4000)], *([f"item{k}"] for k in range(4000))]
    hashed = [np.frombuffer(x, np.uint64) for x in contamination._packed(pa.array(texts)).to_pylist()]
    items = contamination.Items(ids, hashed, 10)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    column = pa.array([f"before {passage} after {k}" for k in range(4000)])
    n_words, n_hit, sets, found, first = contamination.judge(column, items, matches, {})
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000 and time.time() - began < 10
    names = sorted(x for some in ids for x in some)
    assert set(n_hit) == {10} and {(n, sha) for n, sha, _ in sets} == {(8000, hashlib.sha256(",".join(names).encode()).hexdigest())}
    assert len(found) == (4000 if matches else 0)
