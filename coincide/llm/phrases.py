"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and words, per language. Nodes are runs of four words, and an edge is a run of
``LONGEST`` = 5 words that leads from its first four to its last four; its weight is how often it occurs.
Where a piece ends (or can't go on, see below), the shorter run that is left there is an *end*.

1. Words are counted, then pairs of frequent words, then triples of frequent pairs. A phrase that is frequent
   enough has only frequent pairs and triples, and so do all parts of it; runs may therefore be cut at rare
   ones without changing any count that matters. Which are frequent is told by bitmaps of fixed size (false
   hits only keep more). Once the pairs are known, the texts are written as their *stretches*, the words
   between rare pairs; triples and runs are read from those. Triples are counted by their places in the bitmap
   only, so a task hands on counters of a fixed number, however many triples it has met.
2. Every place whose triple may be frequent gives the run of up to five words that begins there: an edge, or an
   end. Each task adds up equal runs before they are shuffled by the whole run, so a hot word or pair can't gather.
3. A shorter run's count is the flow out of its node: the weights of all runs one word longer that begin with
   it, plus the ends that are just this run. Four and three words follow one from another. Pairs keep the counts
   of step 1, which knows them by code only. Their words come from places where the text's *mark*, one byte of its
   hash, is the one kept with the pair's count: all tasks that meet a pair need not name it.
4. Edges that are frequent enough, joined at nodes with one such edge in and one out, are compacted to unary
   paths by pointer doubling; phrases of five words are read off the paths.
5. Every cut of a phrase is scored with the counts of its two parts, in decimals of 38 digits. A phrase
   goes if a phrase with one word more that contains it has the same count; longer ones need no look, as the
   phrases between have that count too.

Edge cases: null and empty texts have no words. A null language is ``und``, and one with the literal
``und``. Repeated rows count as often as they occur. Languages without candidates have no rows. Words are known
by 64-bit hashes until the last step brings back their letters.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coincide.llm.stage import written
from coincide.llm.text import LOWER, as_bytes, chunks, hashes, lists, mapped, mix, words

LONGEST, LEAST, TOP = 5, 100, 2000
BITS = 1 << 26
CHUNK, HELD, PIECE = 4 << 20, 1 << 20, 1024
#: Places of a bitmap whose counters travel in one row.
SLICE = 1 << 16
#: Words that begin runs in one row of stretches; up to ``LONGEST`` - 1 of the next row follow them.
PLACES = 4096
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
#: Fixed by the definition: what ends a piece, and what stands between its words.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"]] = True
ENDS[0x0A:0x0E] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False

W = [f"w{k}" for k in range(1, LONGEST + 1)]


class Coded:
    """Words by their hashes ``h``, codes of their language, and whether the next word goes on."""

    h: np.ndarray
    code: np.ndarray
    goes_on: np.ndarray

    def named(self, size: int) -> np.ndarray:
        """A code of the ``size`` words from each word on (what follows the last words is never asked for)."""
        out, h = mix(self.h ^ (self.code * _K)), np.concatenate((self.h, np.zeros(size, _U)))
        for k in range(1, size):
            out = mix(out * _K + h[k : k + len(out)])
        return out


class Words(Coded):
    """Words of a chunk of texts: spans, hashes, language, and whether the next word follows in the piece."""

    def __init__(self, chunk: pa.RecordBatch) -> None:
        buf, off = as_bytes(chunk.column(chunk.schema.get_field_index("text")))
        self.buf = LOWER[buf]
        self.starts, self.ends, first = words(self.buf, off, INSIDE)
        self.h = hashes(self.buf, self.starts, self.ends)
        self.h[self.h == 0] = 1  # 0 stands for no word
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.code = np.asarray(chunk.column(chunk.schema.get_field_index("lc"))).view(_U)[self.text]
        piece = np.cumsum(ENDS[self.buf])[self.starts] if len(self.starts) else self.starts
        self.goes_on = np.zeros(len(self.h), bool)
        self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def spelled(self, some: np.ndarray) -> pa.Array:
        size = self.ends[some] - self.starts[some]
        off = np.concatenate(([0], np.cumsum(size)))
        pick = np.repeat(self.starts[some] - off[:-1], size) + np.arange(off[-1])
        return pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(self.buf[pick])])


class Stretches(Coded):
    """Words of rows of stretches; ``own``: those that begin runs in their row."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        lc, held, places, mark = (rows.column(k) for k in range(4))
        first = np.asarray(held.offsets).astype(np.int64)
        first -= first[0]
        row = np.repeat(np.arange(rows.num_rows), np.diff(first))
        self.h = np.asarray(held.flatten()).view(_U)
        self.code = np.asarray(lc).view(_U)[row]
        self.mark = np.asarray(mark)[row].astype(_U)
        self.own = (self.h != 0) & (np.arange(len(row)) - first[row] < np.asarray(places)[row])
        self.goes_on = np.zeros(len(row), bool)
        self.goes_on[:-1] = (self.h[:-1] != 0) & (self.h[1:] != 0) & (row[1:] == row[:-1])


def _of_texts(batches):
    for chunk in chunks(batches, "text", CHUNK):
        yield Words(chunk), chunk


def _of_stretches(batches):
    """Rows of at most ``HELD`` words together; a longer row comes alone."""
    for rows in batches:
        first, begin = np.asarray(rows.column(1).offsets), 0
        while begin < rows.num_rows:
            end = max(begin + 1, int(np.searchsorted(first, first[begin] + HELD, "right")) - 1)
            yield Stretches(rows.slice(begin, end - begin)), rows
            begin = end


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _has(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    p = _signed(code) & (BITS - 1)
    return (bits[p >> 6] >> (p & 63)) & 1 == 1


def _bitmap(codes: DataFrame):
    """A broadcast bitmap of ``BITS`` bits with one set for each code."""
    found = codes.select(F.col("code").bitwiseAND(BITS - 1).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[np.asarray(found.column(0))] = np.asarray(found.column(1))
    return codes.sparkSession.sparkContext.broadcast(bits)


def _added(rows: list[tuple]) -> tuple:
    """Rows (code, n, other columns) as one row for each code, its numbers added up."""
    code, n, *others = ([r[k] for r in rows] for k in range(len(rows[0])))
    code = np.concatenate(code)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
    pick = order[first]
    whole = [pa.concat_arrays(c).take(pa.array(pick)) if isinstance(c[0], pa.Array) else np.concatenate(c)[pick] for c in others]
    return code[pick], np.add.reduceat(np.concatenate(n)[order], first), *whole


def _tallied(docs: DataFrame, schema: str, tally, read=_of_texts, form=None) -> DataFrame:
    """What ``tally`` finds in chunks of rows, (code, n, other columns), added up as far as a task can hold.

    ``form`` makes other columns of what was added up.
    """

    def run(batches):
        held, size = [], 0
        for some, chunk in read(batches):
            found = tally(some, chunk)
            if not len(found[0]):
                continue
            held.append(_added([found]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_added(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(_added(held))

    def out(rows):
        code, n, *others = form(*rows) if form else rows
        names = [part.split()[0] for part in schema.split(", ")]
        columns = [_signed(code), n, *[_signed(x) if isinstance(x, np.ndarray) and x.dtype == _U else x for x in others]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return mapped(docs, run, schema)


def _frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, lc, word, h, code, n): the frequent words, and a row without word that counts all."""

    def tally(w, chunk):
        lang = chunk.column(chunk.schema.get_field_index("lang"))
        code, at, n = np.unique(w.named(1), return_index=True, return_counts=True)
        return code, n, w.h[at], lang.take(pa.array(w.text[at])), w.spelled(at)

    counted = _tallied(docs, "code bigint, n bigint, h bigint, lang string, word string", tally)
    counted = counted.groupBy("lang", "word", "h", "code").agg(F.sum("n").alias("n"))
    # The totals of the languages come from the same counts.
    both = counted.withColumn("one", F.explode(F.array(F.lit(True), F.lit(False))))
    own = [F.when(F.col("one"), F.col(c)).alias(c) for c in ("word", "h", "code")]
    total = both.groupBy("lang", *own).agg(F.sum("n").alias("n"))
    return written(total.where(f"word is null or n >= {least}").withColumn("lc", F.xxhash64("lang")), "words")


def _frequent_pairs(docs: DataFrame, single, least: int) -> DataFrame:
    """(code, n, mark): pairs of neighbouring words that occur ``least`` times; ``single``: which words may.

    ``mark`` is that of some text with the pair.
    """

    def tally(w, chunk):
        good = _has(single.value, w.named(1))
        at = np.flatnonzero(w.goes_on & good & np.append(good[1:], False))
        return w.named(2)[at], np.ones(len(at), np.int64), _marks(chunk)[w.text[at]]

    # A mark beside its code costs a byte of compressed shuffle, behind the number four.
    counted = _tallied(docs, "code bigint, n bigint, mark smallint", tally).groupBy("code").agg(
        F.min("mark").alias("mark"), F.sum("n").alias("n"))
    return written(counted.where(f"n >= {least}"), "pairs")


def _marks(chunk: pa.RecordBatch) -> np.ndarray:
    return np.asarray(chunk.column(chunk.schema.get_field_index("mark")))


def stretches(docs: DataFrame, double) -> DataFrame:
    """(lc, words, places, mark): the words of each text whose pairs may be frequent, a 0 after each stretch of them.

    Longer texts have several rows. Runs begin at the first ``places`` words, the others follow in the next row.
    """

    def run(batches):
        for w, chunk in _of_texts(batches):
            on = w.goes_on & _has(double.value, w.named(2))
            at = np.flatnonzero(on | np.append(False, on[:-1]))
            if not len(at):
                continue
            last = ~on[at]
            where = np.arange(len(at)) + np.cumsum(last) - last
            held = np.zeros(len(at) + np.count_nonzero(last), _U)
            held[where] = w.h[at]
            new = np.flatnonzero(np.append(True, w.text[at][1:] != w.text[at][:-1]))
            starts, ends = where[new], np.append(where[new[1:]], len(held))
            rows = -(-(ends - starts) // PLACES)
            part = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            begin, end = np.repeat(starts, rows) + PLACES * part, np.repeat(ends, rows)
            places = np.minimum(PLACES, end - begin)
            size = np.minimum(places + LONGEST - 1, end - begin)
            first = np.append(0, np.cumsum(size))
            pick = np.repeat(begin - first[:-1], size) + np.arange(first[-1])
            mark = np.repeat(_marks(chunk)[w.text[at[new]]], rows)
            columns = [_signed(np.repeat(w.code[at[new]], rows)), lists(_signed(held[pick]), first), places.astype(np.int32), mark]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["lc", "words", "places", "mark"])

    return written(mapped(docs, run, "lc bigint, words array<bigint>, places int, mark smallint"), "stretches")


def _frequent_triples(held: DataFrame, least: int) -> DataFrame:
    """(code): places of the bitmap where triples of words within stretches fall ``least`` times.

    Frequent triples do by themselves; rare ones that fall together only keep more.
    """

    def tally(w, _):
        code = w.named(3)[w.own & w.goes_on & np.append(w.goes_on[1:], False)] & _U(BITS - 1)
        return code, np.ones(len(code), np.int64)

    def sliced(place, n):
        """A row for each slice of the bitmap: the places in it and their numbers."""
        part = _signed(place) // SLICE
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(first, len(part))
        return part[first], lists((_signed(place) % SLICE).astype(np.int32), ends), lists(n, ends)

    def full(key, rows):
        at, n = (np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("at", "n"))
        found = np.flatnonzero(np.bincount(at, n, SLICE) >= least)
        return pa.table({"code": found + key[0].as_py() * SLICE})

    counted = _tallied(held, "slice bigint, at array<int>, n array<bigint>", tally, _of_stretches, sliced)
    return written(counted.groupBy("slice").applyInArrow(full, "code bigint"), "triples")


def runs(held: DataFrame, triple, marked) -> DataFrame:
    """(lc, w1..w5, size, pair, n): edges (five words) and ends (four or three) of stretches, counted.

    Rows of size 2 (n = 0) name the words of a frequent pair by its code, ``pair``, else 0; ``marked``: codes and marks.
    """

    def tally(w, _):
        h = np.concatenate((w.h, np.zeros(LONGEST, _U)))
        size = np.ones(len(w.h), np.int8)  # words of the run that begins here
        three = w.goes_on & np.append(w.goes_on[1:], False) & _has(triple.value, w.named(3))
        for k in range(1, LONGEST):
            further = w.goes_on if k == 1 else np.append(three, np.zeros(LONGEST, bool))[k - 2 : k - 2 + len(size)]
            size += (size == k) & further
        run, pair = np.flatnonzero(w.own & (size > 2)), w.named(2)
        name = np.flatnonzero(w.own & w.goes_on & _has(marked.value, pair ^ w.mark))
        at, size = np.concatenate((run, name)), np.concatenate((size[run], np.full(len(name), 2, np.int8)))
        columns = [np.where(k < size, h[at + k], _U(0)) for k in range(LONGEST)]
        code = w.code[at]
        for c in columns:
            code = mix(code * _K + c)
        return code, (size > 2).astype(np.int64), w.code[at], *columns, size, np.where(size == 2, pair[at], _U(0))

    schema = "code bigint, n bigint, lc bigint, " + ", ".join(f"{w} bigint" for w in W) + ", size tinyint, pair bigint"
    return _tallied(held, schema, tally, _of_stretches).groupBy("lc", *W, "size", "pair").agg(F.sum("n").alias("n"))


def flows(found: DataFrame, shortest: int = 2) -> list[DataFrame]:
    """Counts of the runs of 5, 4, 3 and 2 words: each is the flow out of a node, and the ends there."""
    out = [found.where(f"size = {LONGEST}").select("lc", *W, "n")]
    for size in range(LONGEST - 1, shortest - 1, -1):
        own = found.where(f"size = {size}").select("lc", *W[:size], "n")
        out.append(out[-1].select("lc", *W[:size], "n").unionAll(own).groupBy("lc", *W[:size]).agg(F.sum("n").alias("n")))
    return out


def paths(edges: DataFrame) -> DataFrame:
    """(lc, words, weights): the unary paths of a graph of edges (lc, w1..w5, n).

    Edges that share a node with no other edge in or out are joined. Pointers to the edge before are doubled
    until all reach the head of their path; edges of rings, which have no head, stay single. Paths are cut
    every ``PIECE`` edges, so none grows without bound.
    """
    named = written(edges.select("*", F.xxhash64("lc", *W).alias("id"), F.xxhash64("lc", *W[:-1]).alias("from"),
                                 F.xxhash64("lc", *W[1:]).alias("to")), "edges")
    into = named.groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("before")).where("k = 1")
    outof = named.groupBy(F.col("from").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    before = into.join(outof.drop("k"), "node").where("id <> before").select("id", "before")  # a loop is its own path
    state = written(named.select("id").join(before, "id", "left").select(
        "id", F.coalesce("before", "id").alias("jump"), F.col("before").isNotNull().cast("bigint").alias("rank")), "jumps")
    total, reach = named.count(), 1
    while reach < total:
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("rank").alias("more"))
        moved = written(state.join(far, "jump").select("id", F.col("next").alias("jump"), (F.col("rank") + F.col("more")).alias("rank"),
                                                       (F.col("more") > 0).alias("moved")), "jumps")
        state, reach = moved.drop("moved"), reach * 2
        if not moved.where("moved").limit(1).count():
            break
    heads = state.where("rank = 0").select(F.col("id").alias("head"))
    placed = state.join(heads, state["jump"] == heads["head"], "left").select(
        "id", F.coalesce("head", "id").alias("head"), F.when(F.col("head").isNotNull(), F.col("rank")).otherwise(0).alias("rank"))
    step = F.struct("rank", *W, "n")
    gathered = named.join(placed, "id").groupBy("lc", "head", F.floor(F.col("rank") / PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(step)).alias("steps"))
    start = F.array(*[F.element_at("steps", 1)[w] for w in W[:-1]])
    return gathered.select("lc", F.concat(start, F.col(f"steps.{W[-1]}")).alias("words"), F.col("steps.n").alias("weights"))


def phrases(found: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(lc, words, a): phrases of two to five words that occur ``least`` times; ``pairs``: those of two, by code."""
    longest, *shorter = flows(found, 3)
    solid = paths(longest.where(f"n >= {least}"))
    at = solid.select("lc", "words", F.posexplode("weights").alias("at", "a"))
    out = [at.select("lc", F.slice("words", F.col("at") + 1, F.lit(LONGEST)).alias("words"), "a")]
    for size, flow in zip(range(LONGEST - 1, 2, -1), shorter):
        out.append(flow.where(f"n >= {least}").select("lc", F.array(*W[:size]).alias("words"), F.col("n").alias("a")))
    named = found.where("size = 2").select(F.col("pair").alias("code"), "lc", F.array(*W[:2]).alias("words"))
    out.append(named.join(pairs.select("code", F.col("n").alias("a")), "code").select("lc", "words", "a"))
    return written(reduce(DataFrame.unionAll, out), "phrases")


def scored(some: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """(lc, words, a, l, r, n, score): each phrase with its worst cut.

    ``known`` holds (lc, words, a) of all parts, ``totals`` (lc, n) of languages. Products are decimals:
    a, l, r and n may have 17 digits, and 1000 * a * n then has 37.
    """
    part = lambda name: known.select("lc", F.col("words").alias(name), F.col("a").alias(name[0]))
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    joined = cuts.join(part("left"), ["lc", "left"]).join(part("right"), ["lc", "right"]).join(totals, "lc")
    wide = lambda c: f"cast({c} as decimal(17,0))"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    return joined.groupBy("lc", "words", "a", "n").agg(worst).select("lc", "words", "a", "worst.l", "worst.r", "n", "worst.score")


def whole(found: DataFrame) -> DataFrame:
    """The phrases that no phrase with one word more replaces."""
    longer = found.where(F.size("words") > 2)
    sides = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))
    inner = longer.select("lc", F.explode(sides).alias("words"), "a").groupBy("lc", "words").agg(F.max("a").alias("most"))
    return found.join(inner, ["lc", "words"], "left").where("most is null or most < a").drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    name = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    docs = docs.select(F.col(f"`{text}`").alias("text"), name.alias("lang"), F.xxhash64(name).alias("lc"))
    held = _frequent_words(docs, least)
    single, totals = held.where("word is not null"), held.where("word is null").select("lc", "n")
    docs = docs.select("text", "lc", F.xxhash64("text").bitwiseAND(255).cast("smallint").alias("mark"))
    pairs = _frequent_pairs(docs, _bitmap(single.select("code")), least)
    near = stretches(docs, _bitmap(pairs))
    marked = _bitmap(pairs.select(F.col("code").bitwiseXOR(F.col("mark").cast("bigint")).alias("code")))
    found = phrases(written(runs(near, _bitmap(_frequent_triples(near, least)), marked), "runs"), pairs, least)
    known = found.unionAll(single.select("lc", F.array("h").alias("words"), F.col("n").alias("a")))
    ranked = scored(whole(found), known, totals)
    best = Window.partitionBy("lc").orderBy(F.desc("score"), F.desc("a"))
    ranked = ranked.withColumn("rank", F.rank().over(best)).where(f"rank <= {top}")  # ties stay until they are spelled
    spelled = ranked.select("*", F.posexplode("words").alias("at", "h")).join(single.select("lang", "lc", "h", "word"), ["lc", "h"])
    spelled = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("letters"))
    spelled = spelled.withColumn("phrase", F.array_join("letters.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = spelled.withColumn("rank", F.row_number().over(order).cast("bigint")).where(f"rank <= {top}")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
