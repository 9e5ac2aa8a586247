import numpy as np
import pyarrow as pa
from plainly import LOWER, PLAIN, SPACED
from hypothesis import given, settings
from hypothesis import strategies as st

from coincide.llm import text as tx

texts = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB \n\t.9é", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(rows):
    column = pa.array(rows, pa.string())
    for kind, pattern in ((tx.SPACED, SPACED), (tx.PLAIN, PLAIN)):
        buf, off = tx.as_bytes(column)
        buf = tx.LOWER[buf]
        starts, ends, first = tx.words(buf, off, kind)
        found = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert [found[a:b] for a, b in zip(first, first[1:])] == [pattern.findall((r or "").translate(LOWER)) for r in rows]
        h = tx.hashes(buf, starts, ends)
        assert len(set(zip(found, h.tolist()))) == len(set(found)) == len(set(h.tolist()))


def test_long_words_hash_by_content_only():
    for size in (7, 8, 9, 16, 4095, 4096, 4097, 9000):
        column = pa.array(["q" * size, "x " + "q" * size, "q" * (size - 1) + "r"])
        h, first = tx.lowered(column, tx.SPACED)
        assert h[0] == h[2] != h[3]


def test_chunks_keep_all_rows_and_their_bounds():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 30, 1, 1, 100)] + [None])], names=["t"])
    parts = list(tx.chunks([batch], "t", 32))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 32 for p in parts)


def test_grams():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(tx.grams(h, 5)) == 3 and len(tx.grams(h, 9)) == 0
    assert tx.grams(h, 3)[2] == tx.grams(h[2:5], 3)[0]
