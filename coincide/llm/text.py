"""Arrow batches of texts as byte arrays: bounded chunks, word spans and word hashes.

All work on words is done on whole arrays: a text column becomes one byte array with document
offsets, words become ``(start, end)`` pairs, and a word is known by a 64-bit hash of its bytes.
Two of ``n`` distinct words share a hash with a chance of about n² / 2^65 (3e-6 for ten million).
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4096
LONG_WORD = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: every byte but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, lower-case letters and everything beyond ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def once(name: str, make: Callable):
    """What ``make()`` returns, made once per process (functions that are pickled by value get module
    globals of their own in every task)."""
    held = sys.modules.setdefault("_held_by_process", types.ModuleType("_held_by_process")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers hand back the memory that a task no longer needs: workers live on
    for other tasks, and what their allocators keep counts against the executor."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def crc_part(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _K2
        x = (x ^ (x >> _U(27))) * _K3
        return x ^ (x >> _U(31))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text begins (one entry more than texts)."""
    column = plain(column)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[off[0] : off[-1]], off - off[0]


def chunks(batches, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text and ``CHUNK_ROWS`` rows; a longer text comes alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = as_bytes(batch.column(batch.schema.get_field_index(text)))[1]
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + limit, "right")) - 1)
            end = min(end, n, begin + CHUNK_ROWS)
            yield batch.slice(begin, end - begin)
            begin = end


def with_columns(
    df: DataFrame, text: str, new: str, make: Callable[[], Callable[[pa.RecordBatch], list]],
    keep: list[str] | None = None, limit: int = CHUNK_BYTES, using: tuple[str, ...] = (),
) -> DataFrame:
    """Add the columns of DDL ``new``, computed chunk by chunk in the task that reads the rows.

    ``make()`` runs once per task and returns the function from a chunk to the new columns.
    ``keep`` names the columns that stay (None: all), ``using`` those that only ``make`` reads. A column whose name is among the new ones
    is replaced, so names that clash do no harm.
    """
    added = T._parse_datatype_string(new).fields
    names = {f.name for f in added}
    stay = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    need = [f.name for f in stay] + [c for c in (text, *using) if c not in {f.name for f in stay}]

    def run(batches):
        work = make()
        for chunk in chunks(batches, text, limit):
            out = [chunk.column(chunk.schema.get_field_index(f.name)) for f in stay] + [
                x if isinstance(x, pa.Array) else pa.array(x) for x in work(chunk)
            ]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in stay] + [f.name for f in added])

    return mapped(df.select(*[F.col(f"`{c}`") for c in need]), run, T.StructType(stay + added))


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of the first word of each text.

    ``kind`` says of each byte whether it belongs to words. A word never spans two texts.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = off[(off > 0) & (off < len(buf))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes in every task."""
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(_U) * _K1)
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        view = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
        at, left = starts, size
        live = None
        if len(size) and size.max() > LONG_WORD:
            for i in np.flatnonzero(size > LONG_WORD):
                h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].data)
            live = np.flatnonzero(size <= LONG_WORD)
            at, left = starts[live], size[live]
        first = live is None
        while len(at):
            word = view[at]
            short = left < 8
            word = np.where(short, word & ((_U(1) << (np.minimum(left, 7) * 8).astype(_U)) - _U(1)), word)
            if first:
                h = mix(h ^ (word * _K1))
            else:
                h[live] = mix(h[live] ^ (word * _K1))
            more = np.flatnonzero(left > 8)
            live = more if first else live[more]
            at, left, first = at[more] + 8, left[more] - 8, False
    return h


def lowered(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts with A-Z lowered, and each text's first word."""
    buf, off = as_bytes(column)
    buf = LOWER[buf]
    starts, ends, first = words(buf, off, kind)
    return hashes(buf, starts, ends), first


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` numbers (runs over text borders included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, size):
            out = mix(out * _K1 + _U(k)) + h[k : k + n]
        return mix(out)


def lists(flat: pa.Array | np.ndarray, first: np.ndarray) -> pa.ListArray:
    """A list column from its values and where each list begins."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), flat if isinstance(flat, pa.Array) else pa.array(flat))
