"""Katz backoff language model: Good-Turing discounted bigram counts with exactly normalised weights.

P(w | v) is the discounted count of ``v w`` over the count of ``v`` where the pair was seen, else
weight(v) P(w), and P(w) is the discounted count of ``w`` over all tokens, or for words never seen
the mass that the discounts leave. weight(v) is the mass that the pairs of ``v`` leave, over the mass
that P gives to words not seen after ``v``. Tokens are words and one end; a text begins after START.
Counts up to a cut-off (``KATZ``, or lower where an estimate would not lie between 0 and its count) are
discounted by Good-Turing's estimate with Katz's correction, for words and pairs apart; larger ones
lose ``REST`` of a count, so that every context keeps mass for unseen words (see :func:`discounted`).

How it runs. Word counts are a table of their own. Words with at least 1 / ``HEAD`` of all tokens
(there can't be more than ``HEAD``) are broadcast with their counts and serve as a short code. Each
task turns its documents into packed pairs for the tasks that own the second word (pairs of
broadcast words are spread by both words, so no word gathers in one task). An owner then has all
occurrences of its pairs: it counts them, evaluates pairs that were seen, sends (document, context)
for the others to the owner of the context, and for every context its share of the sums that fix the
weight. Logarithms are additive, so what a document gets from each owner is a few numbers: sums, and
how often a discounted count was met, as discounts follow only from the counts of all owners. Word
counts, owners' answers and context masses are stage tables in the shared folder, partitioned by kind.

``docs`` must be a table that reads the same way twice (a file scan); write it first if it isn't.

Edge cases: null and empty texts are one end token. Null keys stay null; they are in the training set
like the empty text. Without training rows every token is unknown with probability 1. Repeated rows
are separate documents with equal scores. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import written
from coincide.llm.text import SPACED, chunks, lists, lowered, mapped, mix

KATZ, REST, HEAD = 5, 0.05, 1 << 21
CHUNK, FLUSH = 4 << 20, 1 << 21
_U = np.uint64
START, END = _U(0x5354415254535441), _U(0x454E44454E44454E)
#: Per document: occurrences of pairs counted 1..KATZ, of backed-off words counted 1..KATZ, of unknown
#: words, of words known.
CELLS = 2 * KATZ + 2
UNKNOWN, KNOWN = 2 * KATZ, 2 * KATZ + 1
SCHEMA = "kind string, part int, chunk bigint, blob binary, held array<boolean>, n_tokens array<bigint>"
_K = _U(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, bytes of equal place together."""
    head = " ".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    data, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + size :]), 0, []
    for part in blob[4 : 4 + size].decode().split():
        kind, n = part.split(":")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each, and where each text begins."""
    h, first = lowered(column, SPACED)
    n = np.diff(first)
    out = np.full(len(h) + len(n), END, _U)
    begin = np.concatenate(([0], np.cumsum(n + 1)))
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = h
    return out, begin


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of all tokens; every task adds up its own counts first."""

    def count(batches):
        held, total = [], 0
        for chunk in chunks(batches, text, CHUNK):
            word, n = np.unique(sequences(chunk.column(0))[0], return_counts=True)
            held.append((word, n))
            total += len(word)
            if total > FLUSH:
                held = [_added(held)]
                total = len(held[0][0])
                if total > FLUSH // 2:
                    yield from rows(*held.pop())
                    total = 0
        if held:
            yield from rows(*_added(held))

    def rows(word, n, step=1 << 16):
        for k in range(0, len(word), step):
            yield pa.RecordBatch.from_arrays([pa.array(word[k : k + step].view(np.int64)), pa.array(n[k : k + step].astype(np.int64))], names=["word", "n"])

    return mapped(docs.select(text), count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    word, n = (np.concatenate(x) for x in zip(*held))
    word, which = np.unique(word, return_inverse=True)
    return word, np.bincount(which, n).astype(np.int64)


def discounted(met: np.ndarray) -> np.ndarray:
    """Discounted counts 1..KATZ from how many types were met 1..KATZ+1 times.

    Katz leaves counts above a cut-off as they are, because estimates from few types are poor. The cut-off
    is ``KATZ``, or the next lower one at which every estimate lies between 0 and its count; counts above
    it lose ``REST`` like all large ones. It is 2 at least (below, nothing is left for unseen words): without
    a usable one, as where no type was met once, counts lose one half.
    """
    r = np.arange(1, KATZ + 1)
    for cut in range(KATZ, 1, -1):
        if np.all(met[: cut + 1] > 0):
            common = (cut + 1) * met[cut] / met[0]
            if common < 1:
                out = ((r[:cut] + 1) * met[1 : cut + 1] / met[:cut] - r[:cut] * common) / (1 - common)
                if np.all((out > 0) & (out < r[:cut])):
                    return np.append(out, r[cut:] - REST)
    return r - 0.5


class Words(NamedTuple):
    """Totals of the word counts, and the broadcast words."""

    tokens: int
    types: int
    texts: int  # training documents
    lower: np.ndarray  # discounted counts 1..KATZ
    unseen: float  # probability of an unknown word
    names: np.ndarray  # broadcast words: sorted hashes
    code: np.ndarray  # and their codes, 1 and up, the most frequent first
    by_code: np.ndarray  # hash by code (0: none)
    count: np.ndarray  # count by code


def summary(counts: DataFrame) -> Words:
    """Totals and the broadcast words of a word table (at most ``HEAD`` rows come to the driver)."""
    big = F.col("n") > KATZ
    found = counts.agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("n"))).alias("texts"),
        F.sum(F.when(big, F.col("n"))).alias("large"), F.count(F.when(big, 1)).alias("n_large"),
        *[F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, KATZ + 2)]).first()
    n = found["tokens"] or 0
    met = np.array([found[f"n{r}"] for r in range(1, KATZ + 2)], float)
    lower = discounted(met)
    left = 1 - ((met[:KATZ] * lower).sum() + (found["large"] or 0) - REST * found["n_large"]) / n if n else 1.0
    head = counts.where(F.col("n") * HEAD >= n).toArrow()
    word, count = (np.asarray(head.column(k).combine_chunks()) for k in (0, 1))
    word = word.view(_U)
    order = np.lexsort((word, -count))
    by_code, count = np.append(_U(0), word[order]), np.append(0, count[order])
    names = np.sort(by_code[1:])
    code = np.empty(len(names), np.uint32)
    code[np.searchsorted(names, by_code[1:])] = np.arange(1, len(by_code))
    return Words(int(n), found["types"], found["texts"] or 0, lower, float(left), names, code, by_code, count)


def coded(words: Words, h: np.ndarray) -> np.ndarray:
    """Codes of word hashes, 0 for words that aren't broadcast."""
    if not len(words.names):
        return np.zeros(len(h), np.uint32)
    at = np.minimum(np.searchsorted(words.names, h), len(words.names) - 1)
    return np.where(words.names[at] == h, words.code[at], 0).astype(np.uint32)


def decoded(words: Words, code: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = words.by_code[code]
    out[code == 0] = rest
    return out


def pair_rows(text: str, words, parts: int):
    """Packed pairs of each block of documents for each owner, and each block's documents."""

    def run(batches):
        w = Words(*words.value)
        number, size, docs, rows, listed = 0, 0, 0, [], []
        for chunk in chunks(batches, text, CHUNK):
            h, begin = sequences(chunk.column(0))
            n_tokens = np.diff(begin)
            rows.append(pairs(w, h, begin, docs))
            listed.append((np.asarray(chunk.column(1).fill_null(False)), np.asarray(chunk.column(2).fill_null(False)), n_tokens, chunk.column(3)))
            docs += len(n_tokens)
            size += len(rows[-1][0])
            if size > FLUSH:
                yield block(rows, listed, number)
                number, size, docs, rows, listed = number + 1, 0, 0, [], []
        if listed:
            yield block(rows, listed, number)

    def pairs(w, h, begin, docs):
        """Each distinct pair of each document, with its count: word, word before, document, codes."""
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        before, code = np.empty_like(h), coded(w, h)
        code_before = np.zeros_like(code)
        before[1:], code_before[1:] = h[:-1], code[:-1]
        before[begin[:-1]], code_before[begin[:-1]] = START, 0
        with np.errstate(over="ignore"):
            key = (doc.astype(_U) << _U(51)) | (mix(h * _K + before) >> _U(13))
        order = np.argsort(key)
        h, before, doc, code, code_before = (x[order] for x in (h, before, doc, code, code_before))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (before[1:] != before[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(h))).astype(np.uint32)
        return h[head], before[head], (doc[head] + docs).astype(np.int32), code[head], code_before[head], n

    def block(rows, listed, number):
        """The pairs of a block of documents by owner, and the block's documents."""
        name = TaskContext.get().partitionId() << 32 | number
        h, before, doc, code, code_before, n = (np.concatenate(x) for x in zip(*rows))
        rows.clear()
        train, held, n_tokens = (np.concatenate(x) for x in list(zip(*listed))[:3])
        ids = pa.concat_arrays([x[3] for x in listed])
        with np.errstate(over="ignore"):
            owner = (mix(np.where(code > 0, h + before * _K, h)) % _U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(parts + 1))
        out = []
        for p, a, b in zip(range(parts), cuts, cuts[1:]):
            if a < b:
                at = order[a:b]
                c, cb, size = code[at], code_before[at], n[at]
                step = np.diff(doc[at], prepend=0).astype(np.uint32)
                more = np.flatnonzero(size > 1).astype(np.uint32)
                out.append((p, packed(np.array([len(n_tokens)]), np.packbits(train[doc[at]]), step, c, cb, h[at][c == 0], before[at][cb == 0], more, size[more])))
        mine = int(mix(np.array([name], _U))[0] % _U(parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(["pairs"] * len(out) + ["docs"]), pa.array([p for p, _ in out] + [mine], pa.int32()),
             pa.array([name] * (len(out) + 1), pa.int64()), pa.array([b for _, b in out] + [None], pa.binary()),
             pa.array([None] * len(out) + [held], pa.list_(pa.bool_())), pa.array([None] * len(out) + [n_tokens], pa.list_(pa.int64())),
             pa.concat_arrays([pa.nulls(len(out), pa.list_(ids.type)), lists(ids, np.array([0, len(ids)]))])],
            names=["kind", "part", "chunk", "blob", "held", "n_tokens", "ids"])

    return run


def _grouped(h: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)


def owners(words, parts: int):
    """Answers of the task that owns some pairs: counts, seen pairs, unseen pairs, context masses."""

    def run(batches):
        w = Words(*words.value)
        names, sizes, cols, docs = [], [], [], 0
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            passed = pa.array([k == "docs" for k in kinds])
            if passed.true_count:
                yield batch.filter(passed)
            for kind, chunk, blob in zip(kinds, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if kind == "pairs":
                    (n_docs,), train, step, c, cb, rest, rest_before, more, size = unpacked(blob)
                    doc = np.cumsum(step.astype(np.int64))
                    n = np.ones(len(c), np.int32)
                    n[more] = size
                    train = np.unpackbits(train, count=len(c)).astype(bool)
                    cols.append((decoded(w, c, rest), decoded(w, cb, rest_before), doc + docs, n, train, c))
                    names.append(chunk)
                    sizes.append(int(n_docs))
                    docs += int(n_docs)
        if cols:
            whole = [np.concatenate(x) for x in zip(*cols)]
            cols.clear()
            yield from _answers(w, parts, *whole, names, np.array(sizes))

    return run


def _answers(w: Words, parts: int, h, before, doc, n, train, code, names, sizes):
    known_docs, doc = np.unique(doc, return_inverse=True)  # only those that have a pair here
    order = np.lexsort((before, h))
    h, before = h[order], before[order]
    learnt, doc, n = np.where(train, n, 0)[order], doc[order].astype(np.int32), n[order].astype(np.int32)
    new_word = np.concatenate(([True], h[1:] != h[:-1]))
    new_pair = new_word.copy()
    new_pair[1:] |= before[1:] != before[:-1]
    by_word, by_pair = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    of = (np.cumsum(new_pair) - 1).astype(np.int32)  # by row: its pair
    c2 = np.add.reduceat(learnt, by_pair)
    code = code[order][by_word]
    c1 = np.where(code > 0, w.count[code], np.add.reduceat(learnt, by_word))
    c1 = c1[(np.cumsum(new_word) - 1)[by_pair]]
    h, context = h[by_pair], before[by_pair]
    del order, learnt, before, new_word, new_pair
    known, unseen = c1 > 0, c2 == 0
    gain, cell = np.zeros(len(c2)), np.full(len(c2), -1, np.int64)
    has = c2 > KATZ
    gain[has] = np.log10(c2[has] - REST)
    has = known & (h != END)  # the word is a context once, of the token after it
    gain[has] -= np.log10(c1[has])
    has = unseen & (c1 > KATZ)
    gain[has] += np.log10(c1[has] - REST)
    gain[unseen & known] -= np.log10(max(w.tokens, 1))
    has = ~unseen & (c2 <= KATZ)
    cell[has] = c2[has] - 1
    has = unseen & known & (c1 <= KATZ)
    cell[has] = KATZ + c1[has] - 1
    cell[~known] = UNKNOWN
    total = len(known_docs)
    base = np.bincount(doc, np.log10(c1 + 1.0)[of] * n, minlength=total)
    score = np.bincount(doc, gain[of] * n, minlength=total)
    rows = np.flatnonzero((cell >= 0)[of])
    cells = np.bincount(doc[rows] * np.int64(CELLS) + cell[of[rows]], n[rows], minlength=total * CELLS).reshape(total, CELLS)
    cells[:, KNOWN] = np.bincount(doc, np.where(known[of], n, 0), minlength=total)
    at = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.searchsorted(known_docs, at)
    for name, begin, a, b in zip(names, at, cuts, cuts[1:]):
        yield _row("answer", int(mix(np.array([name], _U))[0] % _U(parts)), name,
                   packed((known_docs[a:b] - begin).astype(np.uint32), base[a:b], score[a:b], cells[a:b].astype(np.uint32).ravel()))
    yield _row("met", 0, 0, packed(np.array([(c2 == r).sum() for r in range(1, KATZ + 2)], np.int64)))

    rows = np.flatnonzero(unseen[of])
    place = known_docs[doc[rows]]
    chunk = np.searchsorted(at, place, "right") - 1
    yield from _dealt("unseen", parts, w, context[of[rows]], [chunk.astype(np.uint32), (place - at[chunk]).astype(np.uint32),
                      n[rows].astype(np.uint32)], np.array(names))
    del of, doc, n, rows, chunk, place
    kept = np.flatnonzero(~unseen)
    kept = kept[np.argsort(context[kept])]
    v, c, low = context[kept], c2[kept], c1[kept]
    head = _grouped(v)
    if len(head):
        sums = [np.add.reduceat(c, head)]
        for x in (c, low):
            sums += [np.add.reduceat((x == r).astype(np.int64), head) for r in range(1, KATZ + 1)]
            sums.append(np.add.reduceat(np.where(x > KATZ, x, 0), head))
            sums.append(np.add.reduceat((x > KATZ).astype(np.int64), head))
        yield from _dealt("contexts", parts, w, v[head], [s.astype(np.uint64 if k in (0, 6, 13) else np.uint32) for k, s in enumerate(sums)], np.zeros(0, np.int64))


def _row(kind: str, part: int, chunk: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["kind", "part", "chunk", "blob"])


def _dealt(kind: str, parts: int, w: Words, context: np.ndarray, columns: list[np.ndarray], names: np.ndarray):
    """Rows by context, packed for the task that owns it; ``names`` are those of blocks, if any."""
    owner = (mix(context ^ _U(0xC0)) % _U(parts)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    context, columns = context[order], [c[order] for c in columns]
    cuts = np.searchsorted(owner[order], np.arange(parts + 1))
    code = coded(w, context)
    for p, a, b in zip(range(parts), cuts, cuts[1:]):
        if a < b:
            c, mine, part = code[a:b], names, [x[a:b] for x in columns]
            if len(names):  # the first column numbers the blocks: only those that occur are named
                used, part[0] = np.unique(part[0], return_inverse=True)
                mine, part[0] = names[used], part[0].astype(np.uint32)
            yield _row(kind, p, 0, packed(mine, c, context[a:b][c == 0], *part))


def weights(words, higher: np.ndarray, parts: int):
    """What unseen pairs add to their documents, from the masses of their contexts."""

    def run(batches):
        w = Words(*words.value)
        masses, asked = [], []
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                names, code, rest, *columns = unpacked(blob)
                (masses if kind == "contexts" else asked).append((names, decoded(w, code, rest), columns))
        if not asked:
            return
        v, value = np.zeros(0, _U), np.zeros(0)
        if masses:
            v = np.concatenate([m[1] for m in masses])
            columns = [np.concatenate(c).astype(float) for c in zip(*[m[2] for m in masses])]
            order = np.argsort(v)
            v, head = v[order], _grouped(v[order])
            sums = [np.add.reduceat(c[order], head) for c in columns]
            v = v[head]
            seen = sum(sums[r] * higher[r - 1] for r in range(1, KATZ + 1)) + sums[6] - REST * sums[7]
            low = sum(sums[7 + r] * w.lower[r - 1] for r in range(1, KATZ + 1)) + sums[13] - REST * sums[14]
            value = np.log10(sums[0]) + np.log10(1 - seen / sums[0]) - np.log10(1 - low / w.tokens)
        chunk, doc, add = [], [], []
        for names, context, (which, at_doc, n) in asked:
            at = np.minimum(np.searchsorted(v, context), max(0, len(v) - 1))
            add.append(np.where(v[at] == context, value[at], 0.0) * n if len(v) else np.zeros(len(context)))
            chunk.append(names[which])
            doc.append(at_doc)
        names, which = np.unique(np.concatenate(chunk), return_inverse=True)
        key, place = np.unique(which.astype(np.int64) << 32 | np.concatenate(doc), return_inverse=True)
        total = np.bincount(place, np.concatenate(add))
        which = key >> 32
        owner = (mix(names.view(_U)) % _U(parts)).astype(np.int64)[which]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(parts + 1))
        for p, a, b in zip(range(parts), cuts, cuts[1:]):
            if a < b:
                rows = order[a:b]
                here, at = np.unique(which[rows], return_inverse=True)
                yield _row("weights", p, 0, packed(names[here], at.astype(np.uint32), (key[rows] & 0xFFFFFFFF).astype(np.uint32), total[rows]))

    return run


def score(docs: DataFrame, trains: Column, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows where ``trains`` holds, and score every row's whole text.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10; the base adds
    one to each count)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # an owner holds its pairs in memory
    counts = written(word_counts(docs.where(trains), text), "words")
    words = summary(counts)
    sent = spark.sparkContext.broadcast(tuple(words))  # plain values: workers need no class of this package
    rows = docs.select(F.col(text), trains.alias("trains"), held.alias("held"), F.col(key))
    ids = f", ids array<{docs.schema[key].dataType.simpleString()}>"
    fill = _filled(docs.schema[key].dataType)
    pairs = mapped(rows, pair_rows(text, sent, parts), SCHEMA + ids)
    found = written(mapped(pairs.repartitionById(parts, "part"), fill(owners(sent, parts)), SCHEMA + ids), "answers", by="kind")
    met = np.zeros(KATZ + 1)
    for r in found.where("kind = 'met'").select("blob").toLocalIterator():  # a few numbers of each owner
        met += unpacked(r[0])[0]
    higher = discounted(met)
    columns = [f.strip().split(" ")[0] for f in SCHEMA.split(",")] + ["ids"]
    asked = found.where("kind in ('unseen', 'contexts')").select(*columns).repartitionById(parts, "part")
    backed = mapped(asked, fill(weights(sent, higher, parts)), SCHEMA + ids)
    every = found.where("kind in ('docs', 'answer')").select(*columns).unionAll(backed).repartitionById(parts, "part")
    out = (f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, "
           "train_tokens bigint, base_score double, score double")
    return mapped(every, totals(sent, higher, key), out)


def _filled(kind):
    """Answers have nulls in the columns that only rows of kind docs use."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = pa.list_(to_arrow_type(kind))

    def wrap(run):
        def full(batches):
            for batch in run(batches):
                if batch.num_columns == 4:
                    n = batch.num_rows
                    batch = pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.nulls(n, pa.list_(pa.bool_())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, ids)],
                        names=["kind", "part", "chunk", "blob", "held", "n_tokens", "ids"])
                yield batch

        return full

    return wrap


def totals(words, higher: np.ndarray, key: str):
    """Documents of each chunk with the sums of all answers."""

    def run(batches):
        w = Words(*words.value)
        made: dict[int, list] = {}
        listed = []
        for batch in batches:
            for i, (kind, chunk, blob) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))):
                if kind == "docs":
                    listed.append((chunk, batch.column(4)[i].values, batch.column(5)[i].values, batch.column(6)[i].values))
                    continue
                if kind == "weights":
                    names, at, doc, add = unpacked(blob)
                    cuts = np.searchsorted(at, np.arange(len(names) + 1))
                    for name, a, b in zip(names.tolist(), cuts, cuts[1:]):
                        have = made.setdefault(name, [np.zeros(0), np.zeros(0), np.zeros((0, CELLS))])
                        have[1] = _sum(have[1], doc[a:b], add[a:b])
                    continue
                doc, base, total, cells = unpacked(blob)
                have = made.setdefault(chunk, [np.zeros(0), np.zeros(0), np.zeros((0, CELLS))])
                made[chunk] = [_sum(have[0], doc, base), _sum(have[1], doc, total), _sum(have[2], doc, cells.reshape(-1, CELLS).astype(float))]
        logs = np.concatenate((np.log10(higher), np.log10(w.lower), [np.log10(max(w.unseen, 1e-300)), 0.0]))
        for chunk, held, n_tokens, ids in listed:
            n = np.asarray(n_tokens)
            base, total, cells = (_sum(x, np.arange(len(n)), np.zeros((len(n), *x.shape[1:]))) for x in made[chunk])
            first = np.log10(w.texts) if w.texts else 0.0
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(n), pa.array(cells[:, KNOWN].astype(np.int64)), pa.array(np.full(len(n), w.tokens)),
                 pa.array(base - n * np.log10(w.tokens + w.types + 1.0)), pa.array(total + cells @ logs - first)],
                names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _sum(have: np.ndarray, doc: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Add to the documents' sums, which grow to hold them (documents come ascending)."""
    size = int(doc[-1]) + 1 if len(doc) else 0
    if len(have) < size:
        have = np.concatenate((have, np.zeros((size - len(have), *add.shape[1:]))))
    have[doc] += add
    return have
