"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On each level runs of equal symbols are folded, and deterministic
coin tossing (the lowest bit in which a symbol differs from the one before, and that bit's value)
shrinks the alphabet to a few labels that still differ between neighbours. Local maxima of the labels
begin phrases; a phrase's name is a hash of its symbols, and the names are the next level's symbols.
Where a phrase begins depends on a few symbols around it only, so equal substrings get the same
interior phrases at any offset. The fingerprint holds the ``SIZE`` lowest hashes among the names of
all phrases from level ``FROM_LEVEL`` on and of the whole text; likeness is the Jaccard index of the
phrase sets as the lowest hashes of both estimate it (exact for texts of fewer phrases).

Edge cases: null and empty texts have the empty fingerprint; its likeness is 1 to itself and 0 to any
other. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.substrings import as_number
from coincide.llm.text import CHUNK_BYTES, as_bytes, mapped, mix, plain, with_columns

SIZE, FROM_LEVEL, HEX = 64, 2, 8
NOTHING = np.uint64(1 << 32)  # beyond every 32-bit hash
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)


def _tossed(bits: int) -> np.ndarray:
    """By (symbol before, symbol) of so many bits: twice the lowest differing bit's place, plus its value."""
    x = np.arange(1 << bits)
    differ = x[:, None] ^ x[None, :]
    low = differ & -differ
    place = np.bitwise_count(np.maximum(low, 1) - 1).astype(np.int64)
    return (2 * place + ((x[None, :] & low) > 0)).astype(np.uint8).ravel()


#: For symbols of 8, 7, 4 and 3 bits.
TOSS = {bits: _tossed(bits) for bits in (8, 7, 4, 3)}


def _shrunk(label: np.ndarray, bits: int, head: np.ndarray) -> np.ndarray:
    """One round of coin tossing on small labels; a text's first symbol gives its lowest bit."""
    pair = np.zeros(len(label), np.uint16)
    pair[1:] = label[:-1]
    pair <<= np.uint16(bits)
    pair |= label
    out = TOSS[bits][pair]
    out[head] = label[head] & 1
    return out


def _labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols (bytes or 64-bit names) that differ from their neighbours."""
    if x.dtype == np.uint8:
        label, steps = _shrunk(x, 8, head), (4, 3)
    else:
        differ = np.empty(len(x), _U)
        differ[:1], differ[1:] = 1, x[1:] ^ x[:-1]
        with np.errstate(over="ignore"):
            low = differ & (~differ + _U(1))
            label = (np.bitwise_count(low - _U(1)) << 1) & 127
        label = (label | ((x & low) > 0)).astype(np.uint8)
        label[head] = (x[head] & _U(1)).astype(np.uint8)
        steps = (7, 4, 3)
    for bits in steps:
        label = _shrunk(label, bits, head)
    return label


def _level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and where each text's phrases begin. Texts aren't empty."""
    change = np.ones(len(x), bool)
    change[1:] = x[1:] != x[:-1]
    change[first[:-1]] = True
    if change.all():
        run, symbol, head = None, x, first[:-1]
    else:
        place = np.flatnonzero(change)
        run, symbol = np.diff(np.append(place, len(x))).astype(_U), x[place]
        head = np.searchsorted(place, first[:-1])
    label = _labels(symbol, head)
    begin = np.zeros(len(symbol), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    if len(head) > 1:
        begin[head[1:] - 1] = False  # a phrase of one symbol at a text's end would depend on the next text
    begin[head] = True
    begin = np.flatnonzero(begin)
    with np.errstate(over="ignore"):
        value = NAMES[symbol] if symbol.dtype == np.uint8 else symbol
        if run is not None:
            value = value * (run * _U(2) - _U(1))
        size = np.diff(np.append(begin, len(symbol)))
        offset = np.arange(len(symbol), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        value = value * POWERS[offset] if offset.max() < len(POWERS) else value * mix(offset.astype(_U) | _U(1))
        names = mix(np.add.reduceat(value, begin) + size.astype(_U) * _K)
    return names, np.append(np.searchsorted(begin, head), len(begin))


with np.errstate(over="ignore"):
    NAMES = mix(np.arange(1, 257, dtype=_U) * _K) | _U(1)
    POWERS = mix(np.arange(1, 65, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def sketches(column: pa.Array) -> np.ndarray:
    """The lowest phrase hashes of each text, ascending, one row each; NOTHING fills the rest."""
    buf, off = as_bytes(column)
    n = len(off) - 1
    out = np.full((n, SIZE), NOTHING, _U)
    doc = np.flatnonzero(np.diff(off))
    if not len(doc):
        return out
    x, first = buf, np.append(off[:-1][doc], len(buf))
    owners, found, level = [], [], 0
    while len(doc):
        x, first = _level(x, first)
        level += 1
        size = np.diff(first)
        whole = size == 1  # the text's own name
        take = np.repeat(whole | (level >= FROM_LEVEL), size)
        owners.append(np.repeat(doc, size)[take])
        found.append(x[take])
        going = np.repeat(~whole, size)
        x, doc = x[going], doc[~whole]
        first = np.concatenate(([0], np.cumsum(size[~whole])))
    owner, h = np.concatenate(owners), np.concatenate(found) >> _U(32)
    key = np.unique(owner.astype(_U) << _U(32) | h)
    owner, h = (key >> _U(32)).astype(np.int64), key & _U(0xFFFFFFFF)
    rank = np.arange(len(h)) - np.searchsorted(owner, owner)
    low = rank < SIZE
    out[owner[low], rank[low]] = h[low]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index of the phrase sets behind each row of two arrays of sketches."""
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    real = both < NOTHING
    new = real.copy()
    new[:, 1:] &= both[:, 1:] != both[:, :-1]
    again = real & ~new
    place = np.cumsum(new, axis=1)
    union = np.minimum(place[:, -1], SIZE)
    shared = (again & (place <= SIZE)).sum(axis=1)
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def as_text(sketch: np.ndarray) -> list[str]:
    """Hexadecimal digits of the hashes, one after another."""
    digits = sketch.astype(">u4").tobytes().hex()
    width = SIZE * HEX
    used = (sketch < NOTHING).sum(axis=1) * HEX
    return [digits[i * width : i * width + k] for i, k in enumerate(used)]


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint`` of each whole text."""

    def make():
        return lambda chunk: [pa.array(as_text(sketches(chunk.column(chunk.schema.get_field_index(text)))), pa.string())]

    return with_columns(docs, text, "fingerprint string", make, keep)


OUTPUT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, and that of the text edited with the next document's beginning.

    Documents follow one another by descending key (null keys last, equal keys by text); after the
    last comes the first. Keys are cut into ranges, each range is sorted in one task, and a range's
    last document gets its follower from a second copy of the first document of the next range, so
    texts are shuffled once. Keys that are no integers are numbered in their order first."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    number, _ = as_number(docs.select(F.col(key), F.col(text)), key, "k")
    rows = number.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"),
                         F.when(F.col(key).isNull(), lowest).otherwise(F.col("k")).alias("k"))
    cuts = rows.stat.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})  # a range begins above each cut
    spread = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(k):
        import pandas as pd

        return pd.Series(len(spread.value) - np.searchsorted(spread.value, k.to_numpy()), dtype="int32")

    rows = rows.withColumn("part", range_of("k"))
    head = {r[0]: r[1] for r in rows.groupBy("part").agg(F.max("k")).collect()}  # one row per range
    if not head:
        return rows.select(key).limit(0).mapInArrow(lambda batches: iter(()), f"{_ddl(rows, key)}, {OUTPUT}")
    order = sorted(head)
    before = {head[p]: order[i - 1] for i, p in enumerate(order)}  # first key of a range: the range before
    target = F.create_map(*[x for k, p in before.items() for x in (F.lit(int(k)).cast("bigint"), F.lit(int(p)))])
    place = F.array(F.struct("part", F.lit(False).alias("extra")), F.struct(target[F.col("k")].alias("part"), F.lit(True).alias("extra")))
    dealt = rows.withColumn("place", F.explode(place)).select(key, "text", "k", "place.part", "place.extra").where("part is not null")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "extra", F.desc("k"), "text")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0), plain(batch.column(1)).to_pylist()
            for row in zip(range(batch.num_rows), texts, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                held.append((ids[row[0]], *row[1:]))
                size += len(row[1])
                if size > CHUNK_BYTES // 2 or len(held) > 4096:
                    yield from judge(held)
                    held, size = held[-1:], len(row[1])
        yield from judge(held)

    def judge(held):
        """Rows but the last, each with the row after it."""
        own = [i for i in range(len(held) - 1) if not held[i][3] and held[i][2] == held[i + 1][2]]
        if not own:
            return
        texts = [h[1] for h in held]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        mine, other = sketches(pa.array(texts, pa.string())), sketches(pa.array(changed, pa.string()))
        at = np.array(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[i][0].as_py() for i in own], held[0][0].type), pa.array([len(texts[i]) for i in own], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
             pa.array(as_text(mine[at])), pa.array(as_text(other)),
             pa.array(likeness(mine[at], other)), pa.array(likeness(mine[at], mine[at + 1]))],
            names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return mapped(dealt, run, f"{_ddl(rows, key)}, {OUTPUT}")


def _ddl(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"
