"""Benchmark decontamination with suffix arrays of the training texts.

Every task builds suffix arrays over its shards of documents (some megabytes of text each): word
runs are ranked by packing the ranks of shorter runs into 64 bits and sorting, until the ranks cover
a window. Every suffix of every benchmark item is then looked up by binary search, word by word: the
interval of array entries that share its first words narrows until it is empty or covers a window.
Runs of neighbouring window hits are joined to the longest verbatim matches with their places.
Nothing is shuffled, so a passage that many documents hold costs no more than any other.

Every distinct window is looked up once, however many items hold it, and a text's windows lead to its
items by the sets of items that hold them. So the work and the memory of a shard are in proportion to
its words, also where thousands of equal items meet thousands of copies of their passage.

A window has ``window`` words; an item of fewer words, but not none, is one window. The hashed words of
the benchmark are written as a table. Up to ``GROUP_WORDS`` words (of distinct items) go to the tasks as
one broadcast; a larger benchmark is dealt into groups of about that size by the items' words, and one
group at a time passes the driver, is looked up in its own written pass over the documents and released.

Edge cases: null and empty texts have no words and no hits; items without words match nothing; a
null item id counts as the empty text. Equal items each count. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import written
from coincide.llm.text import PLAIN, grams, lists, lowered, mix, with_columns

GROUP_WORDS = 2_000_000
SHARD_BYTES = 3 << 20
#: Sets of items whose digests a task keeps at hand.
KNOWN_SETS = 1024
MATCH = "struct<item_id:string,item_at:int,at:int,length:int>"
MATCH_TYPE = pa.struct([("item_id", pa.string()), ("item_at", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])
COUNTS = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
MATCHES, ITEMS = f"matches array<{MATCH}>", "items array<string>"


class Items:
    """Distinct benchmark texts one after another, their distinct windows, and who holds them.

    ``ids`` has the item ids of each text. A *lookup* is a window's place in a text (``item``, ``offset``);
    lookups of the same words are one window, ``lead`` is its first lookup. Windows with the same items
    share a set of holders.
    """

    def __init__(self, ids: list[list[str]], texts: list[np.ndarray], window: int) -> None:
        self.ids, self.window = ids, window
        self.size = np.array([len(t) for t in texts], np.int64)
        self.words = np.concatenate([*texts, np.zeros(0, np.uint64)])
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        need = np.minimum(self.size, window)
        lookups = np.where(self.size > 0, self.size - need + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), lookups)
        self.offset = np.arange(lookups.sum()) - np.repeat(np.cumsum(lookups) - lookups, lookups)
        self.need = need[self.item]
        self.depth = int(need.max()) if len(need) else 0
        self._windows()
        # The texts' own suffix array, with a border (0) after each.
        self.vocabulary, rank = np.unique(self.words, return_inverse=True)
        text = np.repeat(np.arange(len(ids)), self.size)
        self.numbers = np.zeros(len(self.words) + len(ids), np.int64)
        self.numbers[np.arange(len(self.words)) + text] = rank + 1
        self.text_begin = self.begin[:-1] + np.arange(len(ids))
        self.order = suffix_array(self.numbers, int(self.size.max(initial=0)))

    def _windows(self) -> None:
        place, key = self.begin[self.item] + self.offset, np.zeros(len(self.item), np.uint64)
        for n in np.unique(self.need):
            some = self.need == n
            key[some] = mix(grams(self.words, int(n))[place[some]] + np.uint64(n))
        _, self.lead, of = np.unique(key, return_index=True, return_inverse=True)
        self.lookups = np.argsort(of, kind="stable")
        self.lookups_first = np.searchsorted(of[self.lookups], np.arange(len(self.lead) + 1))
        pair = np.unique(of * max(len(self.ids), 1) + self.item)
        window, item = np.divmod(pair, max(len(self.ids), 1))
        first = np.searchsorted(window, np.arange(len(self.lead) + 1))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(item.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)))
        _, some, self.holders = np.unique(total[first[1:]] - total[first[:-1]], return_index=True, return_inverse=True)
        size = first[some + 1] - first[some]
        self.holders_first = np.concatenate(([0], np.cumsum(size)))
        self.held = item[np.arange(size.sum()) + np.repeat(first[some] - self.holders_first[:-1], size)]


def item_groups(benchmark: DataFrame, window: int, key: str = "item_id", text: str = "text") -> tuple[int, Iterator[Items]]:
    """How many groups the benchmark has, and the groups, each collected when it is asked for."""
    hashed = written(with_columns(
        benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), text), text, "words binary",
        lambda: lambda chunk: [_packed(chunk.column(chunk.schema.get_field_index(text)))], keep=["_id"]).where(F.length("words") > 0),
        "benchmark")
    total = hashed.select("words").distinct().agg(F.sum(F.length("words"))).first()[0] or 0
    n = -(-total // (8 * GROUP_WORDS))

    def groups():
        for k in range(n):
            rows = hashed.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).orderBy("words", "_id").toLocalIterator()
            ids, texts = [], []
            for words, same in groupby(rows, key=lambda r: r["words"]):
                ids.append([r["_id"] for r in same])
                texts.append(np.frombuffer(words, np.uint64))
            yield Items(ids, texts, window)

    return n, groups()


def _packed(column: pa.Array) -> pa.Array:
    h, first = lowered(column, PLAIN)
    return pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` numbers that begin there (numbers: 1 and up, 0: a border)."""
    n = len(ids)
    rank, order = ids.astype(np.uint64), np.arange(n)
    per = 3 if max(n, int(ids.max(initial=0))) < (1 << 21) - 2 else 2
    bits = np.uint64(21 if per == 3 else 32)
    covered, first = 1, True
    while first or covered < depth:
        key = rank
        for k in range(1, per):
            shifted = np.zeros(n, np.uint64)
            if k * covered < n:
                shifted[: n - k * covered] = rank[k * covered :]
            key = (key << bits) | shifted
        order = np.argsort(key)
        ordered = key[order]
        step = np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.uint64)))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step, dtype=np.uint64)
        covered, first = covered * per, False
    return order


def narrowed(ids, order, low, high, at: int, wanted):
    """The parts of intervals of ``order`` whose suffixes have the number ``wanted`` after ``at`` others."""
    ends = []
    for strict in (False, True):
        a, b = low.copy(), high.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            place = order[mid] + at
            word = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], 0)
            right = word <= wanted[open_] if strict else word < wanted[open_]
            a[open_[right]] = mid[right] + 1
            b[open_[~right]] = mid[~right]
            open_ = open_[a[open_] < b[open_]]
        ends.append(a)
    return ends


def look_up(ids: np.ndarray, order: np.ndarray, query: np.ndarray, begin: np.ndarray, need: np.ndarray):
    """Interval of ``order`` whose suffixes begin with ``query[begin : begin + need]``, per lookup."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    live = np.arange(len(begin))
    at = 0
    while len(live):
        low[live], high[live] = narrowed(ids, order, low[live], high[live], at, query[begin[live] + at])
        at += 1
        live = live[(low[live] < high[live]) & (need[live] > at)]
    return low, high


def longest(ids: np.ndarray, order: np.ndarray, query: np.ndarray, begin: np.ndarray, most: np.ndarray):
    """Length of the longest run of ``query`` from ``begin``, up to ``most``, that a suffix begins with, and its place."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    length, live, at = np.zeros(len(begin), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        a, b = narrowed(ids, order, low[live], high[live], at, query[begin[live] + at])
        more = a < b
        live, at = live[more], at + 1
        low[live], high[live], length[live] = a[more], b[more], at
        live = live[most[live] > at]
    return length, order[low] if len(order) else low


def find(h: np.ndarray, first: np.ndarray, items: Items):
    """All windows found: place in the shard's words, and number of the window."""
    if not len(h) or not items.depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    vocabulary, rank = np.unique(h, return_inverse=True)
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    ids = np.zeros(len(h) + n_docs, np.int64)  # a border after each document
    place = np.arange(len(h)) + doc
    ids[place] = rank + 1
    order = suffix_array(ids, items.depth)
    lead = items.lead
    low, high = look_up(ids, order, numbered(items.words, vocabulary), items.begin[items.item[lead]] + items.offset[lead], items.need[lead])
    size = high - low
    window = np.repeat(np.arange(len(size)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = order[low[window] + within]
    back = np.cumsum(ids == 0)  # borders up to here
    return at - back[at], window


def numbered(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Each word's number in a sorted vocabulary, from 1 (-1: not in it)."""
    known = np.searchsorted(vocabulary, words)
    return np.where(vocabulary[np.minimum(known, len(vocabulary) - 1)] == words, known + 1, -1)


def hit_words(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of the first k of ``n`` words lie in one of the runs, for k from 0 to n."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length, -1)
    return np.concatenate(([0], np.cumsum(np.cumsum(mark[:-1]) > 0)))


def every_match(doc, at, window, items: Items):
    """(doc, text, place in it, place, length) of the maximal matches of every distinct text."""
    size = np.diff(items.lookups_first)[window]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    lookup = items.lookups[np.repeat(items.lookups_first[window], size) + within]
    doc, at, item, offset = np.repeat(doc, size), np.repeat(at, size), items.item[lookup], items.offset[lookup]
    order = np.lexsort((at, at - offset, item, doc))
    doc, item, offset, at = doc[order], item[order], offset[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] != 1) | (offset[1:] - offset[:-1] != 1)
    head = np.flatnonzero(new)
    run = np.diff(np.concatenate((head, [len(at)])))
    return doc[head], item[head], offset[head], at[head], np.minimum(items.size, items.window)[item[head]] + run - 1


def longest_matches(doc, at, window, query, items: Items):
    """(doc, text, place in it, place, length): runs of windows covered from left to right by matches that
    are each as long as the words after their begin allow; the next begins at the first window not inside.
    Of several places in the benchmark, one. Short items match as a whole, wherever they occur."""
    short = items.need[items.lead[window]] < items.window
    lead = items.lead[window[short]]
    parts = [(doc[short], items.item[lead], items.offset[lead], at[short], items.need[lead])]
    order = np.argsort(at[~short])
    doc, at = doc[~short][order], at[~short][order]
    last = np.ones(len(at), bool)
    last[:-1] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] != 1)
    doc, end = doc[last], at[last] + items.window
    begin = at[np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))] if len(at) else at
    while len(begin):
        length, place = longest(items.numbers, items.order, query, begin, end - begin)
        text = np.searchsorted(items.text_begin, place, "right") - 1
        parts.append((doc, text, place - items.text_begin[text], begin, length))
        more = begin + length < end
        doc, begin, end = doc[more], (begin + length - items.window + 1)[more], end[more]
    doc, text, offset, at, length = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((length, at, doc))
    return doc[order], text[order], offset[order], at[order], length[order]


def judge(column: pa.Array, items: Items, matches: str | None, known: dict):
    """Per text: words, words hit, its items (:func:`item_sets`), and its matches with where each text's begin."""
    h, first = lowered(column, PLAIN)
    at, window = find(h, first, items)
    n_docs = len(first) - 1
    doc = np.searchsorted(first, at, "right") - 1
    n_hit = np.diff(hit_words(len(h), at, items.need[items.lead[window]])[first])
    sets = item_sets(doc, items.holders[window], n_docs, items, known)
    if matches is None or not len(at):
        return np.diff(first), n_hit, sets, pa.array([], MATCH_TYPE), np.zeros(n_docs + 1, np.int64)
    if matches == "each":
        doc, text, offset, at, length = every_match(doc, at, window, items)
        copies = np.array([len(x) for x in items.ids])[text]
        names = [x for t in text for x in items.ids[t]]
        doc, offset, at, length = (np.repeat(x, copies) for x in (doc, offset, at, length))
    else:
        doc, text, offset, at, length = longest_matches(doc, at, window, numbered(h, items.vocabulary), items)
        names = [items.ids[t][0] for t in text]
    found = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(offset, pa.int32()), pa.array(at - first[doc], pa.int32()), pa.array(length, pa.int32())],
        names=["item_id", "item_at", "at", "length"])
    return np.diff(first), n_hit, sets, found, np.searchsorted(doc, np.arange(n_docs + 1))


NO_ITEMS = (0, hashlib.sha256(b"").hexdigest(), [])


def item_sets(doc, holders, n_docs: int, items: Items, known: dict) -> list[tuple[int, str, list[str]]]:
    """Per text, its items: how many, their digest, their ids. Texts with the same items share one entry."""
    out = [NO_ITEMS] * n_docs
    doc, holders = np.divmod(np.unique(doc * max(len(items.held), 1) + holders), max(len(items.held), 1))
    cut = np.flatnonzero(np.diff(doc)) + 1
    for d, some in zip(doc[np.concatenate(([0], cut))] if len(doc) else (), np.split(holders, cut)):
        key = some.tobytes()
        if key not in known:
            if len(known) >= KNOWN_SETS:
                known.clear()
            first = items.holders_first
            texts = np.unique(np.concatenate([items.held[first[k] : first[k + 1]] for k in some]))
            known[key] = digest({x for t in texts for x in items.ids[t]})
        out[d] = known[key]
    return out


def digest(ids: set[str]) -> tuple[int, str, list[str]]:
    ids = sorted(ids)
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), ids


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
                  window: int = 10, item_key: str = "item_id", item_text: str = "text", matches: str | None = "each") -> DataFrame:
    """Add to each row n_words, n_hit, n_items, items_sha256, contaminated and, unless ``matches`` is None,
    the verbatim matches (item, word offsets in item and text, length in words).

    ``matches="longest"`` gives :func:`longest_matches`, no more rows than the text has words (and windows of
    short items). ``"each"`` gives the maximal matches with each item, as many as there are items and places.
    """
    context, keep = docs.sparkSession.sparkContext, [c for c in docs.columns if keep is None or c in keep]
    n, groups = item_groups(benchmark, window, item_key, item_text)
    if n <= 1:
        group = next(groups, None) or Items([], [], window)
        return _pass(docs, context.broadcast(vars(group)), text, keep, matches, False, True)
    out = docs
    for k, group in enumerate(groups):
        held = context.broadcast(vars(group))
        more = [text] * (k < n - 1)
        out = written(_pass(out, held, text, keep + more, matches or "longest", k > 0, k == n - 1), "decontamination")
        held.destroy()
    return out if matches else out.drop("matches")


def _pass(docs: DataFrame, held, text: str, keep: list[str], matches: str | None, further: bool, last: bool) -> DataFrame:
    """One group of items; ``further``: matches and items of earlier groups are in the rows."""

    def make():
        items, known = SimpleNamespace(**held.value), {}

        def work(chunk):
            n_words, n_hit, sets, found, first = judge(chunk.column(chunk.schema.get_field_index(text)), items, matches, known)
            if further:
                earlier, others = (chunk.column(chunk.schema.get_field_index(c)) for c in ("_matches", "_items"))
                n_hit, found, first = joined(n_words, [(found, first), (earlier.flatten(), _first(earlier))])
                sets = [digest({*ids, *more}) if more else (n, sha, ids) for (n, sha, ids), more in zip(sets, others.to_pylist())]
            out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([x[0] for x in sets], pa.int64()),
                   pa.array([x[1] for x in sets], pa.string()), pa.array(n_hit > 0)]
            out += [lists(found, first)] if matches else []
            return out if last else [*out, pa.array([x[2] for x in sets], pa.list_(pa.string()))]

        return work

    new = ", ".join([COUNTS] + [MATCHES] * bool(matches) + [ITEMS] * (not last))
    if further:
        docs = docs.withColumnsRenamed({"matches": "_matches", "items": "_items"})
    return with_columns(docs, text, new, make, keep, limit=SHARD_BYTES, using=("_matches", "_items") if further else ())


def _first(column: pa.ListArray) -> np.ndarray:
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.concatenate(([0], np.cumsum(size)))


def joined(n_words: np.ndarray, parts: list):
    """Matches of several item groups as one; words hit by any of them count once."""
    doc = np.concatenate([np.repeat(np.arange(len(n_words)), np.diff(first)) for _, first in parts])
    found = pa.concat_arrays([found.cast(MATCH_TYPE) for found, _ in parts])
    order = np.argsort(doc, kind="stable")
    doc, found = doc[order], found.take(pa.array(order))
    start = np.concatenate(([0], np.cumsum(n_words)))
    at = start[doc] + np.asarray(found.field("at"), np.int64)
    hit = hit_words(int(start[-1]), at, np.asarray(found.field("length"), np.int64))
    return np.diff(hit[start]), found, np.searchsorted(doc, np.arange(len(n_words) + 1))
