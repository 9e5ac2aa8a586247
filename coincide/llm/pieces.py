"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text becomes ``▁`` + text with blanks as ``▁``. No piece holds a ``▁`` after another character, so
the lattice of a text falls apart into segments, each from a run of blanks to the next one; line ends
that no piece holds cut further. Segments are deduplicated in a task's chunk: the lattice of a
distinct segment is built and filtered forward once (log-sum of all ways to reach a place), and each
occurrence then walks backward on its own, choosing the last piece with its exact conditional
probability. The draw depends only on the seed, the row's key, the segment's number in the text and
the step, so a row gets the same pieces wherever and whenever it is processed.

The weight of a piece is its log probability times ``theta``. Models that store merge ranks instead
of log probabilities get Zipf's law over the ranks. A character without a piece of its own becomes
byte pieces. Decoding joins the pieces and is lossless: blanks, line ends, byte pieces and a literal
``▁`` or ``<0x0A>`` come back as they were.

Edge cases: null and empty texts have no pieces and decode to the empty text. A null key draws as
the empty text. Repeated rows (same key and text) get equal pieces.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.text import as_bytes, hashes, lists, mapped, mix, once, plain, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, LITERAL = 0x2581, 0x110000
#: Bytes of text whose distinct segments share lattices.
CHUNK = 1 << 20
FILTER_SHIFT = np.uint64(46)
_K = np.uint64(0x9FB21C651E98DF25)


class Vocabulary(NamedTuple):
    prefixes: list[np.ndarray]  # by length: sorted hashes of all beginnings of pieces
    filters: list[np.ndarray]  # by length and top bits of a hash: whether any beginning has them
    ids: list[np.ndarray]  # by length: the piece that each beginning is, or -1
    weight: np.ndarray  # by id: log probability
    byte_ids: np.ndarray  # by byte
    data: np.ndarray  # bytes of all pieces, one after another
    begin: np.ndarray  # by id: where its bytes begin
    line_cuts: bool  # no piece holds a line end


def extended(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a run of characters followed by one more."""
    with np.errstate(over="ignore"):
        return mix(h * _K + code.astype(np.uint64) + np.uint64(1))


def vocabulary(model: str) -> Vocabulary:
    """The model's pieces, read once per worker process."""
    return once(f"pieces {model}", lambda: _read(model))


def _read(model: str) -> Vocabulary:
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=model)
    n = held.get_piece_size()
    normal = [i for i in range(n) if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i))]
    names = {i: held.id_to_piece(i) for i in normal}
    if any("▁" in name.lstrip("▁") for name in names.values()):
        raise ValueError("a piece holds a blank after other characters: segments can't be cut at blanks")
    byte_ids = np.array([held.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    score = np.array([held.get_score(i) for i in range(n)])
    own = score[normal]
    if len(own) and np.all(own == np.round(own)):  # merge ranks
        weight = -np.log(np.arange(n) + 1.0)
    else:
        weight = score.astype(float)
    chosen = np.zeros(n, bool)
    chosen[normal] = True
    chosen[byte_ids] = True
    weight[byte_ids] = weight[normal].min() - 1.0
    weight -= np.log(np.exp(weight[chosen]).sum())
    longest = max(map(len, names.values()))
    size = np.array([len(names[i]) for i in normal])
    code = np.zeros((len(normal), longest), np.int64)
    for row, i in enumerate(normal):
        code[row, : size[row]] = [ord(c) for c in names[i]]
    prefixes, filters, ids = [np.zeros(0, np.uint64)], [np.zeros(1 << 18, bool)], [np.zeros(0, np.int64)]
    h, live = np.zeros(len(normal), np.uint64), np.array(normal)
    for k in range(1, longest + 1):
        going = size >= k
        live, size, code, h = live[going], size[going], code[going], extended(h[going], code[going, k - 1])
        starts, whole = np.unique(h), np.flatnonzero(size == k)
        found = np.full(len(starts), -1)
        found[np.searchsorted(starts, h[whole])] = live[whole]
        has = np.zeros(1 << 18, bool)
        has[starts >> FILTER_SHIFT] = True
        prefixes, filters, ids = [*prefixes, starts], [*filters, has], [*ids, found]
    content = [b""] * n
    for i, name in names.items():
        content[i] = name.replace("▁", " ").encode()
    for b, i in enumerate(byte_ids):
        content[i] = bytes([b])
    return Vocabulary(
        prefixes, filters, ids, weight, byte_ids,
        np.frombuffer(b"".join(content), np.uint8), np.concatenate(([0], np.cumsum([len(c) for c in content]))),
        not any("\n" in name for name in names.values()))


def member(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of many ranges, one after another."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + size, size)


class Lattice(NamedTuple):
    """Edges of the lattices of distinct segments, sorted by the node where they end."""

    first: np.ndarray  # by node: its first incoming edge
    start: np.ndarray  # by edge: node where it starts
    piece: np.ndarray  # by edge: piece, or -1 - character for byte pieces
    upto: np.ndarray  # by edge: summed probability of the node's edges up to this one
    chance: np.ndarray  # by edge: log of its probability given the node
    end: np.ndarray  # by segment: last node; the first nodes are 0, 1, ... in some order


def utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F) + (code > 0x7FF) + ((code > 0xFFFF) & (code != LITERAL))


def lattice(code: np.ndarray, size: np.ndarray, v: Vocabulary, theta: float) -> Lattice:
    """``code``: characters of all segments one after another, longest segment first; ``size``: their
    lengths (1 and up).

    Node numbers go by depth, then by segment, so edges sorted by the node where they end can be
    filtered forward depth by depth, and segment ``s`` begins at node ``s``.
    """
    n = len(code)
    deepest = int(size[0])
    base = np.concatenate(([0], np.cumsum(np.searchsorted(-size, -np.arange(deepest + 1), "right"))))
    segment = np.repeat(np.arange(len(size), dtype=np.int32), size)
    depth = (np.arange(n) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    left = size[segment] - depth
    live, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
    starts, lengths, ids = [], [], []
    single = np.zeros(n, bool)
    for k in range(1, len(v.prefixes)):
        if k > 1:
            fits = left[live] >= k
            live, h = live[fits], h[fits]
        if not len(live):
            break
        h = extended(h, code[live + k - 1])
        maybe = v.filters[k][h >> FILTER_SHIFT]
        live, h = live[maybe], h[maybe]
        known, at = member(v.prefixes[k], h)
        live, h, found = live[known], h[known], v.ids[k][at[known]]
        whole = found >= 0
        starts.append(live[whole])
        lengths.append(np.full(len(starts[-1]), k, np.int32))
        ids.append(found[whole].astype(np.int32))
        if k == 1:
            single[live[whole]] = True
    bare = np.flatnonzero(~single).astype(np.int32)
    starts.append(bare)
    lengths.append(np.ones(len(bare), np.int32))
    ids.append((-1 - code[bare].astype(np.int64)).astype(np.int32))
    start, length, piece = map(np.concatenate, (starts, lengths, ids))
    del starts, lengths, ids, live, h, left, single
    weight = theta * v.weight[np.maximum(piece, 0)]
    byte = np.flatnonzero(piece < 0)
    weight[byte] = theta * v.weight[v.byte_ids[0]] * utf8_bytes(-1 - piece[byte])
    target = (base[depth[start] + length] + segment[start]).astype(np.int32)
    source = (base[depth[start]] + segment[start]).astype(np.int32)
    del start, length
    order = np.argsort(target)
    source, piece, weight, target = source[order], piece[order], weight[order], target[order]
    del order
    nodes = int(base[-1])
    first = np.concatenate(([0], np.cumsum(np.bincount(target, minlength=nodes))))
    alpha = np.zeros(nodes)
    total = np.empty(len(target))
    for d in range(1, deepest + 1):
        a, b = first[base[d]], first[base[d + 1]]
        x = alpha[source[a:b]] + weight[a:b]
        total[a:b] = x
        group = first[base[d] : base[d + 1]] - a
        most = np.maximum.reduceat(x, group)
        np.exp(x - most[target[a:b] - base[d]], out=x)
        alpha[base[d] : base[d + 1]] = most + np.log(np.add.reduceat(x, group))
    chance = total
    chance -= alpha[target]
    summed = np.concatenate(([0.0], np.cumsum(np.exp(chance))))
    upto = summed[1:] - summed[first[target]]
    upto[first[1:][np.diff(first) > 0] - 1] = 2.0  # the node's last edge takes what rounding leaves
    return Lattice(first, source, piece, upto, chance, base[size] + np.arange(len(size)))


def sample(column: pa.Array, draw: np.ndarray, v: Vocabulary, theta: float):
    """Ids of all texts one after another, each text's first id, and its log probability."""
    texts = plain(column).to_pylist()
    joined = "".join([" " + t for t in texts if t])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.zeros(len(texts))
    blank = code == 32
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    if v.line_cuts:
        line = np.flatnonzero(code == 10)
        cut[line] = True
        cut[line[line + 1 < len(code)] + 1] = True
    cut[off[:-1][size > 0]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(code))
    code = np.where(blank, BLANK, np.where(code == BLANK, LITERAL, code)).astype(np.uint32)
    h = hashes(code.view(np.uint8), begin * 4, end * 4)
    _, example, kind = np.unique(h, return_index=True, return_inverse=True)
    by_length = np.argsort(begin[example] - end[example], kind="stable")
    rank = np.empty(len(by_length), np.int64)
    rank[by_length] = np.arange(len(by_length))
    kind, example = rank[kind], example[by_length]
    length = (end - begin)[example]
    made = lattice(code[ranges(begin[example], length)], length, v, theta)

    doc = np.searchsorted(off, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, off)[doc]
    with np.errstate(over="ignore"):
        stream = mix(draw[doc] + number.astype(np.uint64) * _K)
    live, node = np.arange(len(begin)), made.end[kind]
    who, edges, step = [], [], 0
    while len(live):
        with np.errstate(over="ignore"):
            u = (mix(stream[live] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        edge = made.first[node]
        open_ = np.flatnonzero(made.upto[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[made.upto[edge[open_]] <= u[open_]]
        who.append(live.astype(np.int32))
        edges.append(edge.astype(np.int32))
        node = made.start[edge]
        more = node != kind[live]
        live, node, step = live[more], node[more], step + 1
    steps = np.zeros(len(begin), np.int64)
    for x in who:
        steps[x] += 1
    head = np.cumsum(steps) - steps
    chosen = np.empty(int(steps.sum()), np.int32)
    for k, (x, e) in enumerate(zip(who, edges)):
        chosen[head[x] + steps[x] - 1 - k] = e
    piece = made.piece[chosen]
    owner = np.repeat(doc, steps)
    logp = np.bincount(owner, made.chance[chosen], minlength=len(texts))
    count = np.ones(len(piece), np.int64)
    byte = np.flatnonzero(piece < 0)
    count[byte] = utf8_bytes(-1 - piece[byte])
    place = np.concatenate(([0], np.cumsum(count)))
    ids = np.repeat(piece, count)
    for k in byte[count[byte] > 1]:
        raw = chr(BLANK if -1 - piece[k] == LITERAL else -1 - piece[k]).encode()
        ids[place[k] : place[k + 1]] = v.byte_ids[np.frombuffer(raw, np.uint8)]
    one = ids < 0
    ids[one] = v.byte_ids[-1 - ids[one]]
    return ids, place[np.searchsorted(owner, np.arange(len(texts) + 1))], logp


def joined(ids: np.ndarray, first: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids of all texts stand for, without each text's leading blank."""
    size = (v.begin[1:] - v.begin[:-1])[ids]
    data = v.data[ranges(v.begin[:-1][ids], size)]
    off = np.concatenate(([0], np.cumsum(size)))[first]
    keep = np.ones(len(data), bool)
    keep[off[:-1][np.diff(off) > 0]] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _draw(key: str, seed: int):
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_draw")


def _sampler(text: str, model: str, theta: float):
    v = vocabulary(model)

    def run(chunk):
        draw = np.asarray(chunk.column(chunk.schema.get_field_index("_draw"))).view(np.uint64)
        return v, *sample(chunk.column(chunk.schema.get_field_index(text)), draw, v, theta)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
           model: str = MODEL, theta: float = 0.5, seed: int = 0) -> DataFrame:
    """Add ``ids`` (the sampled pieces) and ``log_prob`` (of the segmentation, given the text)."""

    def make():
        run = _sampler(text, model, theta)

        def work(chunk):
            _, ids, first, logp = run(chunk)
            return [lists(ids.astype(np.int32), first), pa.array(logp)]

        return work

    keep = docs.columns if keep is None else keep
    return with_columns(docs.withColumn("_draw", _draw(key, seed)), text, "ids array<int>, log_prob double", make, keep,
                        limit=CHUNK, using=("_draw",))


def decode(encoded: DataFrame, ids: str = "ids", output: str = "text", model: str = MODEL) -> DataFrame:
    """The texts that lists of ids stand for, as column ``output``; the other columns stay."""
    from pyspark.sql import types as T

    stay = [f for f in encoded.schema.fields if f.name != output]

    def run(batches):
        v = vocabulary(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            size = np.asarray(column.value_lengths().fill_null(0), np.int64)
            data, off = joined(np.asarray(column.flatten(), np.int64), np.concatenate(([0], np.cumsum(size))), v)
            texts = [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in stay] + [pa.array(texts, pa.string())],
                names=[f.name for f in stay] + [output])

    return mapped(encoded, run, T.StructType([*stay, T.StructField(output, T.StringType())]))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
               model: str = MODEL, theta: float = 0.5, seed: int = 0) -> DataFrame:
    """Encode and decode each text in the task that reads it, and add digests of both: ``n_pieces``,
    ``ids_sha256`` (of the ids as little-endian 32-bit integers), ``log_prob``, ``lossless``."""

    def make():
        run = _sampler(text, model, theta)

        def work(chunk):
            v, ids, first, logp = run(chunk)
            flat = ids.astype("<i4")
            data, off = joined(ids, first, v)
            raw, at = as_bytes(chunk.column(chunk.schema.get_field_index(text)))
            same = [np.array_equal(data[a:b], raw[c:d]) for a, b, c, d in zip(off, off[1:], at, at[1:])]
            sha = [hashlib.sha256(flat[a:b].data).hexdigest() for a, b in zip(first, first[1:])]
            return [pa.array(np.diff(first), pa.int64()), pa.array(sha, pa.string()), pa.array(logp), pa.array(same, pa.bool_())]

        return work

    keep = docs.columns if keep is None else keep
    return with_columns(docs.withColumn("_draw", _draw(key, seed)), text,
                        "n_pieces bigint, ids_sha256 string, log_prob double, lossless boolean", make, keep,
                        limit=CHUNK, using=("_draw",))
