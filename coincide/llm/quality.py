"""Quality by nearest-neighbour voting over latent-semantic vectors.

The terms of a text are of two kinds. Its form: runs of one to three character classes (a run of
small letters counts as one, and a word equal to the word before is a class of its own), and lines
seen before in the same text. Its content: words (A-Z lowered) and runs of four bytes, hashed.
Term counts are damped and weighted by inverse document frequency, each kind to a length of its own
(``CONTENT`` is the share of content in a cosine); a truncated SVD of a bounded
sample of labelled rows gives the latent space. The sample's vectors are broadcast (their number
and width are parameters), and every document is compared with all of them in blocks of exact
cosine products. The nearest ``NEIGHBOURS`` vote with the similarity as weight.

Edge cases: null and empty texts have no vector; their score is the share of label 1 in the sample.
With no training row every score is 0.5. Ties among neighbours are broken by their order in the
sample (hashed key). Repeated rows get equal results; of training rows that share a key, the one whose
text has the lowest hash is learnt from, at any partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import bounded_sample
from coincide.llm.text import LOWER, SPACED, as_bytes, hashes, lists, mix, with_columns, words

#: Widths of the hashed term spaces (form, content) and of the latent space, and bound of the sample.
TERMS, WORDS, LATENT, PER_LABEL = 4096, 4096, 96, 1000
CONTENT = 0.3
NEIGHBOURS, BLOCK = 25, 512
OUTPUT = "score double, predicted int"

#: Classes: small letters and all beyond ASCII, capitals, digits, white space, line ends, the rest singly.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[[9, 11, 12, 13, 32]] = 32
CLASS[97:123] = CLASS[128:] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48
#: The class of all bytes of a word that equals the word before it.
REPEATED = 1
RUNS = np.zeros(256, bool)
RUNS[[REPEATED, 32, 48, 65, 97]] = True
LINE = np.ones(256, bool)
LINE[10] = False


class Model(NamedTuple):
    idf: np.ndarray  # TERMS + WORDS
    basis: np.ndarray  # (TERMS + WORDS) x width
    vectors: np.ndarray  # sample x width, unit length
    labels: np.ndarray  # sample
    prior: float


def counts(column: pa.Array) -> np.ndarray:
    """Term counts of each text: ``TERMS`` numbers for its form, then ``WORDS`` for its content."""
    buf, off = as_bytes(column)
    n = len(off) - 1
    both = np.zeros((n, TERMS + WORDS), np.float32)
    out = both[:, :TERMS]
    if len(buf):
        kind, low = CLASS[buf], LOWER[buf]
        starts, ends, first = words(buf, off, SPACED)
        h = hashes(low, starts, ends)
        both[:, TERMS:] += tally(np.repeat(np.arange(n), np.diff(first)), h, n, WORDS)
        four = np.ndarray((max(len(low) - 3, 0),), "<u4", np.ascontiguousarray(low).data, strides=(1,)).astype(np.uint64)
        doc = np.repeat(np.arange(n), np.diff(off))
        same = doc[: len(four)] == doc[3:]
        both[:, TERMS:] += tally(doc[: len(four)][same], mix(four[same] + np.uint64(1)), n, WORDS)
        again = same_as_before(h, first)
        within = np.zeros(len(buf) + 1, np.int32)
        within[starts[again]] += 1
        within[ends[again]] -= 1
        kind[np.cumsum(within[:-1]) > 0] = REPEATED
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | ~RUNS[kind[1:]]
        keep[off[(off > 0) & (off < len(buf))]] = True
        kind = kind[keep].astype(np.uint64)
        first = np.concatenate(([0], np.cumsum(keep)))[off]
        doc = np.repeat(np.arange(n), np.diff(first))
        key = np.zeros(len(kind), np.uint64)
        for size in (1, 2, 3):
            key = (key[:-1] if size > 1 else key) * np.uint64(256) + kind[size - 1 :] + np.uint64(1)
            same = doc[: len(key)] == doc[size - 1 :]
            out[:, : TERMS - 1] += tally(doc[: len(key)][same], mix(key[same]), n, TERMS - 1)
        starts, ends, first = words(buf, off, LINE)
        out[:, TERMS - 1] = seen_before(hashes(buf, starts, ends), first)
    return both


def tally(doc: np.ndarray, h: np.ndarray, n: int, width: int) -> np.ndarray:
    """How often each hash, modulo ``width``, occurs in each of ``n`` texts."""
    place = doc * width + (h % np.uint64(width)).astype(np.int64)
    return np.bincount(place, minlength=n * width).reshape(n, width)


def same_as_before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which items equal the item before in the same text."""
    equal = np.zeros(len(h), bool)
    equal[1:] = h[1:] == h[:-1]
    equal[first[:-1][first[:-1] < len(h)]] = False
    return equal


def seen_before(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, how many items occurred before in it."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=len(first) - 1)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf; form and content get their shares of the squared length."""
    out = np.log1p(tf)
    out *= idf
    for part, share in ((out[:, :TERMS], 1 - CONTENT), (out[:, TERMS:], CONTENT)):
        size = np.linalg.norm(part, axis=1, keepdims=True)
        part *= np.float32(np.sqrt(share)) / np.where(size > 0, size, 1)
    return out


def blocks(column: pa.Array):
    """Term counts of ``BLOCK`` texts at a time."""
    for at in range(0, len(column), BLOCK):
        yield counts(column.slice(at, BLOCK))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        per_label: int = PER_LABEL) -> Model:
    """Latent space and labelled vectors from at most ``per_label`` rows of each label."""
    chosen = bounded_sample(labels.select(key, F.col(label).cast("int").alias("_label")), key, "_label", per_label)
    chosen = chosen.groupBy(key).agg(F.max("_label").alias("_label"))
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    one = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("text"), "_label")).alias("one")
    rows = rows.groupBy(key).agg(one).select(key, F.col("one.text").alias("_text"), F.col("one._label").alias("_label"))
    found = with_columns(
        rows, "_text", "tf binary", lambda: lambda chunk: [sparse(chunk.column(chunk.schema.get_field_index("_text")))],
        keep=[key, "_label"],
    ).orderBy(F.xxhash64(F.col(key).cast("string")), key).collect()
    width = TERMS + WORDS
    if not found:
        return Model(np.zeros(width), np.zeros((width, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    tf = np.zeros((len(found), width), np.float32)
    for row, r in zip(tf, found):
        at, n = np.frombuffer(r["tf"], np.int32).reshape(2, -1)
        row[at] = n
    label01 = np.array([r["_label"] for r in found], np.float64)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32)
    m = weighted(tf, idf)
    del tf
    values, left = np.linalg.eigh((m @ m.T).astype(np.float64))
    top = np.argsort(-values)[:LATENT]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)]
    basis = (m.T @ left[:, top] / np.sqrt(values[top])).astype(np.float32)
    return Model(idf, basis, unit(m @ basis), label01, float(label01.mean()))


def sparse(column: pa.Array) -> pa.Array:
    """Places and values of the term counts that are not 0, as two rows of 32-bit numbers."""
    found = []
    for tf in blocks(column):
        for row in tf:
            at = np.flatnonzero(row)
            found.append(np.stack([at, row[at]]).astype(np.int32).tobytes())
    return pa.array(found, pa.binary())


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 1e-12, size, 1)).astype(np.float32)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest vectors of the sample."""
    out = np.full(len(vectors), model.prior)
    k = min(NEIGHBOURS, len(model.vectors))
    for at in range(0, len(vectors), BLOCK) if k else ():
        similar = vectors[at : at + BLOCK] @ model.vectors.T
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        good = total > 1e-9
        out[at : at + BLOCK][good] = (weight * model.labels[near]).sum(1)[good] / total[good]
    return np.clip(out, 0.0, 1.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
            threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to each row."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        model = Model(*held.value)

        def work(chunk):
            found = [vote(unit(weighted(tf, model.idf) @ model.basis), model)
                     for tf in blocks(chunk.column(chunk.schema.get_field_index(text)))]
            score = np.concatenate([*found, np.zeros(0)])
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return work

    return with_columns(docs, text, OUTPUT, make, keep)
