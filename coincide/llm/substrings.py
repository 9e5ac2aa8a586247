"""Removal of repeated word sequences with prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. A word goes if any window that covers it
has an equal window that starts earlier, at a smaller (key, place).

Which suffixes. Of each window, the word sequences of ``SEED`` words in it are ranked by a hash, and
the lowest (leftmost) one is the window's *anchor*. Equal windows have equal anchors at equal offsets, so
it is enough to compare suffixes that begin at anchors, about one place in seven. A suffix holds the words
that its windows need: up to ``window`` after its start, and the few before it.

1. Count the seeds at anchors. A suffix whose seed is met once has no deep node and is left out; a
   bitmap of fixed size says which seeds are met again (its false hits only bring suffixes that turn out
   to be alone). In the same pass every 64th anchor counts its prefixes of several lengths.
2. The group of a suffix is its shortest prefix (of 1, 2, 4 or ``SEED`` words) that leads to at most
   ``GROUP`` suffixes by that count. Where even the seed leads to more, the suffix is split into its
   windows, whose prefix is the whole window. Only the prefixes that are too frequent are broadcast, and of
   these the ``MOST`` most frequent; any other leads to at most 4 / ``MOST`` of all suffixes. Within a chunk of documents, equal suffixes are sent once: all but
   the first of them are known to repeat.
3. Groups are dealt by prefix and packed into batches of about ``GROUP`` rows. A batch's suffixes are sorted,
   neighbours' common prefixes are the depths of the tree's internal nodes, and so are those of the words
   before the anchors, read backwards. A window is a pair of nodes, one that its words after the
   anchor lead to and one that its words before it lead to; all but its first occurrence go.
   A group of whole windows is a single leaf: its first row in order stays.
4. Spans that go are gathered per document; documents without any keep their words as they come.

Edge cases: null and empty texts have no words and keep the empty text. Rows that share a key count as
one document: places are compared by (key, word number), and equal places don't remove each other. Null
keys come last and count as one key. Keys of any type that sorts are numbered first. Words are known by
64-bit hashes, the words of a suffix by 32 bits of each (20 of them and a 64-bit seed must agree).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coincide.llm.jaccard import wanted
from coincide.llm.merkle import numbered
from coincide.llm.stage import written
from coincide.llm.text import SPACED, as_bytes, chunks, grams, hashes, mapped, mix, with_columns, words

SEED = 8
PREFIXES = (1, 2, 4, SEED)
GROUP, MOST = 1 << 14, 1 << 20
SAMPLE = 64
BITS = 1 << 26
WHOLE = 255
_U = np.uint64
_SALT = _U(0x5BD1E9955BD1E995)
LAST = (1 << 63) - 1
SUFFIX = "key bigint, row bigint, prefix bigint, depth smallint, at bigint, low smallint, high smallint, before binary, after binary"


def anchors(h: np.ndarray, first: np.ndarray, window: int):
    """Anchors of all windows of the texts whose words ``h`` are: places, the first and last window of each
    (as offsets back from the anchor), the seeds of all places, and each anchor's text."""
    span = window - SEED + 1
    seeds = grams(h, SEED)
    last = first[1:] - window  # the last window of each text
    begin, n = first[:-1], np.maximum(last - first[:-1] + 1, 0)
    if not n.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, seeds, none
    rank = mix(seeds ^ _SALT)
    # The leftmost lowest of every run of ``span`` ranks, by doubling the runs' lengths.
    best, size = np.arange(len(rank)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(rank[right] < rank[left], right, left)
        size += step
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    place = best[start]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(place)])) - 1
    at = place[head]
    return at, at - start[tail], at - start[head], seeds, text[head]


def prefix_hashes(h: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """Hash of the prefix of each length of ``PREFIXES`` at the given places."""
    out = []
    for size in PREFIXES[:-1]:
        x = h[at]
        for k in range(1, size):
            x = mix(x * _U(0x9E3779B97F4A7C15) + _U(k)) + h[at + k]
        out.append(mix(x + _U(size)))
    return [*out, seeds[at]]


def _words(chunk: pa.RecordBatch, text: str):
    buf, off = as_bytes(chunk.column(chunk.schema.get_field_index(text)))
    starts, ends, first = words(buf, off, SPACED)
    return hashes(buf, starts, ends), first


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _counted(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(kind, code, n): seeds at anchors (kind 0; met more than once) and sampled prefixes (their length)."""

    def run(batches):
        for chunk in chunks(batches, text):
            h, first = _words(chunk, text)
            at, _, _, seeds, _ = anchors(h, first, window)
            seed, n = np.unique(seeds[at], return_counts=True)
            kind, code, count = [np.zeros(len(seed), np.int8)], [seed], [n]
            some = at[mix(at.astype(_U) + seeds[at]) % _U(SAMPLE) == 0]
            for size, x in zip(PREFIXES, prefix_hashes(h, some, seeds)):
                x, n = np.unique(x, return_counts=True)
                kind.append(np.full(len(x), size, np.int8))
                code.append(x)
                count.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kind)), pa.array(_signed(np.concatenate(code))), pa.array(np.concatenate(count).astype(np.int64))],
                names=["kind", "code", "n"])

    rows = mapped(docs.select(text), run, "kind tinyint, code bigint, n bigint")
    total = rows.groupBy("kind", "code").agg(F.sum("n").alias("n"))
    return written(total.where(f"kind = 0 and n > 1 or kind > 0 and n > {GROUP // SAMPLE}"), "seeds")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed that is met again: ``BITS`` bits, however many seeds there are."""
    place = F.col("code").bitwiseAND(BITS - 1)
    found = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return bits


def _frequent(counted: DataFrame) -> list[np.ndarray]:
    """Prefixes of each length that lead to more than ``GROUP`` suffixes, sorted; ``MOST`` of them at most."""
    found = counted.where("kind > 0").orderBy(F.desc("n"), "code").limit(MOST).select("kind", "code").toArrow()
    kind, code = np.asarray(found.column(0)), np.asarray(found.column(1)).view(_U)
    return [np.sort(code[kind == size]) for size in PREFIXES]


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = np.searchsorted(held, x)
    return (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == x) if len(held) else np.zeros(len(x), bool)


def _bodies(h32: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words from ``begin`` on, ``size`` of each, as one binary value each."""
    off = np.concatenate(([0], np.cumsum(size)))
    pick = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    data = h32[pick]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(data)])


def _suffixes(docs: DataFrame, key: str, text: str, window: int, bits, frequent) -> DataFrame:
    """Suffixes to compare, and spans that are known to go (depth 0; from ``at``, ``low`` words)."""

    def run(batches):
        for chunk in chunks(batches, "text"):
            h, first = _words(chunk, "text")
            at, low, high, seeds, doc = anchors(h, first, window)
            seed = seeds[at]
            p = _signed(seed) & (BITS - 1)
            keep = np.flatnonzero((bits.value[p >> 6] >> (p & 63)) & 1)
            if not len(keep):
                continue
            at, low, high, doc, seed = at[keep], low[keep], high[keep], doc[keep], seed[keep]
            ids, row = (np.asarray(chunk.column(k))[doc] for k in (0, 1))
            place = at - first[doc]
            prefix, depth = np.zeros(len(at), _U), np.zeros(len(at), np.int16)
            left = np.ones(len(at), bool)
            for size, x, held in zip(PREFIXES, prefix_hashes(h, at, seeds), frequent.value):
                fits = left & ~_among(x, held)
                prefix[fits], depth[fits] = x[fits], size
                left &= ~fits
            # Even the seed leads to too many: each window by itself, with all its words as prefix.
            if left.any():
                rest = np.flatnonzero(left)
                n = (high - low + 1)[rest]
                rest = np.repeat(rest, n)
                offset = high[rest] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                whole = grams(h, window)[at[rest] - offset]
                own = np.flatnonzero(~left)
                at, place, ids, row = (np.concatenate((x[own], x[rest])) for x in (at, place, ids, row))
                prefix, depth = np.concatenate((prefix[own], whole)), np.concatenate((depth[own], np.full(len(rest), WHOLE, np.int16)))
                seed = np.concatenate((seed[own], whole))
                low, high = np.concatenate((low[own], offset)), np.concatenate((high[own], offset))
            # Equal suffixes of this chunk: the first stays, the others' windows are known to go.
            whole = depth == WHOLE
            left_words, right_words = np.where(whole, 0, high), np.where(whole, 0, window - low)
            same = mix(seed ^ mix(low.astype(_U) * _U(31) + high.astype(_U)))
            for k in range(SEED, window):  # words after the seed
                inside = k < right_words
                same = np.where(inside, mix(same + h[np.minimum(at + k, len(h) - 1)] + _U(k)), same)
            for k in range(1, window - SEED + 1):  # words before it
                inside = k <= left_words
                same = np.where(inside, mix(same * _U(3) + h[np.maximum(at - k, 0)] + _U(k)), same)
            order = np.lexsort((place, ids, same))
            again = np.concatenate(([False], same[order][1:] == same[order][:-1]))
            equal = again & np.concatenate(([False], (ids[order][1:] == ids[order][:-1]) & (place[order][1:] == place[order][:-1])))
            sent, known = order[~again | equal], order[again & ~equal]
            if len(known):
                n = len(known)
                none = pa.array([b""] * n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[known]), pa.array(row[known]), pa.array(ids[known]), pa.array(np.zeros(n, np.int16)),
                     pa.array(place[known] - high[known]), pa.array((window + high - low)[known].astype(np.int16)), pa.array(np.zeros(n, np.int16)), none, none],
                    schema=schema)
            h32 = (h & _U(0xFFFFFFFF)).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[sent]), pa.array(row[sent]), pa.array(_signed(prefix[sent])), pa.array(depth[sent]), pa.array(place[sent]),
                 pa.array(low[sent].astype(np.int16)), pa.array(high[sent].astype(np.int16)),
                 _bodies(h32, (at - left_words)[sent], left_words[sent]), _bodies(h32, at[sent], right_words[sent])],
                schema=schema)

    kinds = {"bigint": pa.int64(), "smallint": pa.int16(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in SUFFIX.split(", "))])
    return mapped(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text")), run, SUFFIX)


def nodes(body: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of the rows of a matrix of words, as a sorted order and the depth at which each row
    parts from the one before it (-1: another group)."""
    width = body.shape[1]
    row = np.concatenate((group.astype(">u8").view(np.uint8).reshape(len(group), 8), body.view(np.uint8).reshape(len(body), -1)), axis=1)
    order = np.argsort(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel())
    ordered = body[order]
    differ = ordered[1:] != ordered[:-1]
    depth = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    depth[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate(([-1], depth))


def _at_depth(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """Number of the node of depth ``least`` above each row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(depth < least)
    return out


def _matrix(column: pa.Array, width: int, backwards: bool) -> np.ndarray:
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    held = np.frombuffer(data, ">u4") if data is not None and data.size else np.zeros(0, ">u4")
    size = np.diff(off)
    out = np.zeros((len(column), width), ">u4")
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    if backwards:
        col = np.repeat(size, size) - 1 - col
    out[row, col] = held[off[0] : off[-1]] if len(size) else held[:0]
    return out


def repeated(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and offsets of the windows that are not the first of their node, in whole groups of suffixes."""
    key, prefix, at, low, high = (np.asarray(batch.column(k)) for k in ("key", "prefix", "at", "low", "high"))
    after = nodes(_matrix(batch.column("after"), window, False), prefix)
    before = nodes(_matrix(batch.column("before"), window - SEED, True), prefix)
    rows, offsets = [], []
    for offset in range(window - SEED + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        if len(own) < 2:
            continue
        node = _at_depth(*after, window - offset)[own] * (len(key) + 1) + _at_depth(*before, offset)[own]
        order = np.lexsort((at[own], key[own], node))
        node, k, a = node[order], key[own][order], at[own][order]
        new = np.concatenate(([True], node[1:] != node[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (k != k[head]) | (a != a[head])
        rows.append(own[order][later])
        offsets.append(np.full(later.sum(), offset))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *offsets])


def _spans(suffixes: DataFrame, window: int) -> DataFrame:
    """(key, row, at, size): spans of words that go."""
    schema = pa.schema([(name, pa.int64()) for name in ("key", "row", "at", "size")])

    def out(key, row, begin, size):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, row, begin, np.broadcast_to(size, len(key)).astype(np.int64))], schema=schema)

    def solve(table):
        """Spans of whole groups."""
        found, offset = repeated(table, window)
        if not len(found):
            return
        key, row, at = (np.asarray(table.column(k))[found] for k in ("key", "row", "at"))
        begin = at - offset
        # Neighbouring windows of a document are one span.
        order = np.lexsort((begin, row, key))
        key, row, begin = key[order], row[order], begin[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + window)))
        tail = np.concatenate((np.flatnonzero(new)[1:], [len(key)])) - 1
        yield out(key[new], row[new], begin[new], begin[tail] + window - begin[new])

    def single(batch, hot):
        """Spans of windows in order, and the last window with its first place; ``hot``: that of the rows before."""
        key, row, name, at = (np.asarray(batch.column(k)) for k in ("key", "row", "prefix", "at"))
        begin = at - np.asarray(batch.column("low"))
        goes_on = hot is not None and hot[0] == name[0]
        new = np.concatenate(([not goes_on], name[1:] != name[:-1]))
        places = np.flatnonzero(new)
        heads = np.concatenate((np.array([hot[1:]] if goes_on else [], np.int64).reshape(-1, 2), np.stack((key, begin), axis=1)[places]))
        which = np.cumsum(new) - (not goes_on)
        later = (key != heads[which, 0]) | (begin != heads[which, 1])
        return out(key[later], row[later], begin[later], window), (name[-1], *heads[-1])

    def run(batches):
        held, size, hot = [], 0, None
        for batch in batches:
            depth = np.asarray(batch.column("depth"))
            known = batch.filter(pa.array(depth == 0))
            if known.num_rows:
                yield out(*(np.asarray(known.column(k)) for k in ("key", "row", "at", "low")))
            whole = batch.filter(pa.array(depth == WHOLE))
            if whole.num_rows:
                found, hot = single(whole, hot)
                yield found
            some = batch.filter(pa.array((depth > 0) & (depth < WHOLE)))
            if not some.num_rows:
                continue
            held.append(some)
            size += some.num_rows
            if size >= GROUP:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                name = np.asarray(table.column("prefix"))
                if name[0] != name[-1]:
                    cut = int(np.flatnonzero(name != name[-1])[-1]) + 1
                    yield from solve(table.slice(0, cut))
                    table = table.slice(cut)
                held, size = [table], table.num_rows
        if size:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = suffixes.repartition("prefix", "depth").sortWithinPartitions("depth", "prefix", "key", "at")
    return mapped(dealt, run, "key bigint, row bigint, at bigint, size bigint")


def as_number(docs: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a number for the key that sorts like it, null keys last."""
    if isinstance(docs.schema[key].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return docs.withColumn(name, F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST))), None
    ids = docs.select(F.col(f"`{key}`").alias("_id"), F.lit(0).alias("_one")).where("_id is not null").distinct()
    place, _ = numbered(ids, "_one", ["_id"])
    place = written(place.select("_id", "number"), "numbers")
    out = docs.join(place, docs[f"`{key}`"] == place["_id"], "left")
    return out.withColumn(name, F.coalesce("number", F.lit(LAST))).drop("_id", "number"), place


def spans(docs: DataFrame, key: str = "_key", text: str = "text", window: int = 20) -> DataFrame:
    """(key, row, at, size): the words that go, as spans per document; spans may overlap. ``key`` is a
    number, ``row`` tells texts apart that share it."""
    spark = docs.sparkSession
    counted = _counted(docs, text, window)
    bits = spark.sparkContext.broadcast(_bitmap(counted.where("kind = 0")))
    frequent = spark.sparkContext.broadcast(_frequent(counted))
    return _spans(_suffixes(docs, key, text, window, bits, frequent), window)


OUTPUT = "n_words bigint, n_removed bigint, kept string"


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, keep: list[str] | None = None) -> DataFrame:
    """Add the number of words, of words that go, and ``kept``, the others joined by one blank."""
    columns = docs.columns if keep is None else keep
    numbers, _ = as_number(docs, key, "_key")
    gone = spans(numbers.select("_key", F.col(f"`{text}`").alias("_text")), "_key", "_text", window)
    gone = written(gone.groupBy("key", "row").agg(F.collect_list(F.struct("at", "size")).alias("_spans")), "spans")
    rows = numbers.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own"), F.col(f"`{text}`").alias("_text"), "_key",
                          F.xxhash64(F.col(f"`{text}`")).alias("_row"))
    # Texts without spans stay where they are.
    maybe = wanted(gone.select(F.xxhash64("key", "row").alias("k")), F.xxhash64("_key", "_row"))
    marked = rows.withColumn("_maybe", maybe)
    met = marked.where("_maybe").join(gone, (F.col("_key") == gone["key"]) & (F.col("_row") == gone["row"]), "left")
    none = F.expr("cast(null as array<struct<at:bigint,size:bigint>>)")
    every = met.select("_own", "_text", "_spans").unionByName(marked.where("not _maybe").select("_own", "_text", none.alias("_spans")))

    def make():
        def work(chunk):
            buf, off = as_bytes(chunk.column(chunk.schema.get_field_index("_text")))
            starts, ends, first = words(buf, off, SPACED)
            n = np.diff(first)
            held = chunk.column(chunk.schema.get_field_index("_spans"))
            kept = _kept(held, first, len(starts))
            count = np.add.reduceat(np.concatenate((kept, [False])).astype(np.int64), first[:-1]) if len(n) else n
            count = np.where(n > 0, count, 0)
            return [pa.array(n), pa.array(n - count), _joined(buf, starts, ends, first, kept)]

        return work

    out = with_columns(every, "_text", OUTPUT, make, ["_own"], using=("_spans",))
    return out.select(*[F.col(f"_own.`{c}`") for c in columns if c not in ("n_words", "n_removed", "kept")], "n_words", "n_removed", "kept")


def _kept(spans: pa.ListArray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words no span covers."""
    at = np.asarray(spans.offsets)[: len(spans) + 1]
    flat = spans.values
    begin, size = np.asarray(flat.field("at"))[at[0] : at[-1]], np.asarray(flat.field("size"))[at[0] : at[-1]]
    begin = begin + np.repeat(first[:-1], np.diff(at))
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + size, -1)
    return np.cumsum(step)[:n] == 0


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank."""
    own = np.flatnonzero(kept)
    cut = np.searchsorted(own, first)  # each text's first kept word
    lead = np.ones(len(own), np.int64)  # a blank before every word but a text's first
    lead[cut[:-1][cut[:-1] < cut[1:]]] = 0
    size = ends[own] - starts[own] + lead
    off = np.concatenate(([0], np.cumsum(size)))
    pick = np.repeat(starts[own] - lead - off[:-1], size) + np.arange(off[-1])
    data = buf[pick]
    data[off[:-1][lead == 1]] = 0x20
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(off[cut].astype(np.int32)), pa.py_buffer(data)])
