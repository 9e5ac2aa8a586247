"""Toxicity by Levenshtein automata over a lexicon trie, scored in context.

The lexicon is learned from a bounded sample of labelled rows: words, and beginnings of words, that
many toxic and hardly any clean documents hold. Its terms form a trie. The product of that trie with
a Levenshtein automaton (each term has an edit budget by its length) is made deterministic once on
the driver and sent to the tasks as a table; its size follows from the bounded lexicon. Every distinct
word of a chunk of texts runs through it, all words in step, so misspelled terms cost as much as exact
ones.

The sample keeps one row of near copies. The lexicon comes from two thirds of it; how much a term says at some edit distance is measured
on the rest, and so is a logistic regression from a document's evidence, hits and length to its
score. Context separates mention from abuse: a hit between quotation marks, or shortly after a word of
reporting, counts for little, and such hits don't add up; hits close to one another strengthen each
other.

Edge cases: null and empty texts, and texts without words, score 0. Without training rows of both
labels the lexicon is empty and every score is 0. Repeated rows get equal results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.pieces import ranges
from coincide.llm.stage import bounded_sample
from coincide.llm.text import grams, hashes, lists, mix, plain, with_columns

#: Bounds of the sample and of the lexicon.
PER_LABEL, MAX_TERMS = 3000, 200
PREFIXES = (4, 5, 6)
#: A term needs so many toxic documents, such a share of them and such a ratio of rates; a hit counts
#: as certain as PRIOR says before the sample speaks, with the weight beside it, by edits.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 5, 0.01, 40.0
PRIOR = ((0.9, 2.0), (0.5, 4.0), (0.25, 4.0))
#: Share of toxic documents that certainties are put to; a hit under the least certainty is none.
TOXIC_SHARE, LEAST_CERTAINTY = 0.1, 0.2
#: Share that a quoted or reported hit keeps; words between hits that are near, and what nearness adds.
MENTION, NEAR_WORDS, NEAR_GAIN = 0.3, 12, 0.25
#: Fixed: words of reporting, English, German, French, Spanish.
REPORTING = ("said says called calls word words term quote quoted insult insults sagte nannte wort begriff "
             "zitat dit mot terme citation dijo palabra insulto cita").split()
LINKS = "*@$!+"
OTHER = 0
OUTPUT = "score double, predicted int"
HIT = "struct<term:int,edits:int,at:int,mention:boolean,near:int>"


def budget(term: str, prefix: bool) -> int:
    """Edits allowed: none under five letters, two from nine on; beginnings of words need six for one."""
    size = len(term) - prefix
    return 0 if size < 5 else 1 if size < 9 or prefix else 2


class Automaton(NamedTuple):
    letters: np.ndarray  # sorted characters of the lexicon; the others are OTHER
    step: np.ndarray  # state x (letters + 1): next state; state 0 is dead, state 1 the start
    word: np.ndarray  # state: term * 4 + edits accepted at the end of a word, or NONE
    prefix: np.ndarray  # state: the same for beginnings of words


NONE = np.int64(1 << 40)


def automaton(terms: list[tuple[str, bool]]) -> Automaton:
    """Deterministic product of the terms' trie and the Levenshtein automata of their budgets."""
    children: list[dict[str, int]] = [{}]
    allowed, ends = [-1], [[]]
    for k, (term, prefix) in enumerate(terms):
        node, edits = 0, budget(term, prefix)
        allowed[0] = max(allowed[0], edits)
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                allowed.append(-1)
                ends.append([])
            node = children[node][c]
            allowed[node] = max(allowed[node], edits)
        ends[node].append((k, prefix, edits))
    letters = sorted({c for t, _ in terms for c in t})
    code = {c: i + 1 for i, c in enumerate(letters)}

    def closed(found: dict[int, int]) -> tuple:
        """With letters of a term left out; a node is kept with its fewest edits."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found.get(node) != e:
                continue
            for child in children[node].values():
                if e + 1 <= allowed[child] and found.get(child, 9) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        return tuple(sorted(found.items()))

    def after(state: tuple, c: str | None) -> tuple:
        found: dict[int, int] = {}
        for node, e in state:
            if e + 1 <= allowed[node] and found.get(node, 9) > e + 1:  # a letter too many
                found[node] = e + 1
            for letter, child in children[node].items():
                cost = e + (letter != c)
                if cost <= allowed[child] and found.get(child, 9) > cost:
                    found[child] = cost
        return closed(found)

    start = closed({0: 0}) if terms else ()
    number = {(): 0, start: 1} if terms else {(): 0}
    rows, todo = {}, [start] if terms else []
    while todo:
        state = todo.pop()
        other = after(state, None)
        known = {c for node, _ in state for c in children[node]}
        row = {OTHER: other} | {code[c]: after(state, c) for c in known}
        for target in row.values():
            if target not in number:
                number[target] = len(number)
                todo.append(target)
        rows[state] = row
    step = np.zeros((max(2, len(number)), len(letters) + 1), np.int32)
    word, prefix_ = np.full(len(step), NONE), np.full(len(step), NONE)
    for state, i in number.items():
        if state in rows:
            step[i, :] = number[rows[state][OTHER]]
            for c, target in rows[state].items():
                step[i, c] = number[target]
        for node, e in state:
            for k, prefix, edits in ends[node]:
                if e <= edits:
                    held = prefix_ if prefix else word
                    held[i] = min(held[i], e * (1 << 20) + k)
    return Automaton(np.array([ord(c) for c in letters], np.int64), step, word, prefix_)


def run(a: Automaton, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """edits * 2^20 + term of the best match of each word, or NONE."""
    best = np.full(len(begin), NONE)
    if not len(a.letters) or not len(begin):
        return best
    at = np.minimum(np.searchsorted(a.letters, code), len(a.letters) - 1)
    letter = np.where(a.letters[at] == code, at + 1, OTHER)
    live, state, k = np.arange(len(begin)), np.ones(len(begin), np.int64), 0
    while len(live):
        done = size[live] == k
        best[live[done]] = np.minimum(best[live[done]], a.word[state[done]])
        live, state = live[~done], state[~done]
        state = a.step[state, letter[begin[live] + k]].astype(np.int64)
        best[live] = np.minimum(best[live], a.prefix[state])
        alive = state > 0
        live, state, k = live[alive], state[alive], k + 1
    return best


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By character below 0x3000: part of words; part of words between two that are."""
    core, link = np.zeros(0x3000, bool), np.zeros(0x3000, bool)
    core[0x30:0x3A] = core[0x61:0x7B] = core[0xC0:0x2000] = core[0x2C00:] = True
    core[[0xAA, 0xB5, 0xBA]] = True
    link[[ord(c) for c in LINKS]] = True
    return core, link


CORE, LINK = _kinds()


class Words(NamedTuple):
    code: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    off: np.ndarray  # by text: where it begins in code


def split(column: pa.Array) -> Words:
    """Words of lower-cased texts: letters and digits, and single signs such as ``*`` between them."""
    texts = [t.lower() for t in plain(column).to_pylist()]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    low = np.minimum(code, 0x2FFF)
    inside = CORE[low]
    if len(code) > 2:
        inside[1:-1] |= LINK[low[1:-1]] & inside[:-2] & inside[2:]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = off[(off > 0) & (off < len(code))]
    start[cuts], end[cuts - 1] = inside[cuts], inside[cuts - 1]
    begin = np.flatnonzero(start)
    return Words(code, begin, np.flatnonzero(end) + 1 - begin, np.searchsorted(off, begin, "right") - 1, off)


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct word, and which of them every word is."""
    h = hashes(w.code.astype(np.uint32).view(np.uint8), w.begin * 4, (w.begin + w.size) * 4)
    _, example, kind = np.unique(h, return_index=True, return_inverse=True)
    return example, kind


def hits(column: pa.Array, a: Automaton):
    """Hits of all texts in order (text, term, edits, word number, whether mentioned, hits near), and
    the number of words of each text."""
    w = split(column)
    n_words = np.bincount(w.doc, minlength=len(column))
    if not len(w.begin):
        return [*[np.zeros(0, np.int64)] * 6, n_words]
    example, kind = distinct(w)
    chars = w.code[ranges(w.begin[example], w.size[example])]
    head = np.cumsum(w.size[example]) - w.size[example]
    best = run(a, chars, head, w.size[example])[kind]
    at = np.flatnonzero(best < NONE)
    doc = w.doc[at]
    place = w.begin[at]
    quotes = np.isin(w.code, [0x22])
    opened = np.isin(w.code, [0x201C, 0x201E, 0xAB]).astype(np.int64) - np.isin(w.code, [0x201D, 0xBB])
    line = np.zeros(len(w.code), np.int64)
    breaks = np.flatnonzero(w.code == 10)
    line[breaks] = breaks
    line[w.off[:-1][w.off[:-1] < len(w.code)]] = w.off[:-1][w.off[:-1] < len(w.code)]
    line = np.maximum.accumulate(line)[place]
    odd, depth = np.concatenate(([0], np.cumsum(quotes))), np.concatenate(([0], np.cumsum(opened)))
    mention = ((odd[place] - odd[line]) % 2 == 1) | (depth[place] - depth[line] > 0)
    told = np.zeros(len(example) + 1, bool)
    texts = {i: "".join(map(chr, w.code[w.begin[x] : w.begin[x] + w.size[x]])) for i, x in enumerate(example) if w.size[x] <= 9}
    told[[i for i, t in texts.items() if t in REPORTING]] = True
    told = told[kind]
    for back in (1, 2, 3):
        before = np.maximum(at - back, 0)
        mention |= told[before] & (w.doc[before] == doc) & (at >= back)
    near = np.zeros(len(at), np.int64)
    for side in (1, -1):
        for k in range(1, 4):
            other = np.arange(len(at)) + side * k
            good = (other >= 0) & (other < len(at))
            o = np.clip(other, 0, max(0, len(at) - 1))
            near += good & (doc[o] == doc) & (np.abs(at[o] - at) <= NEAR_WORDS)
    return doc, best[at] & ((1 << 20) - 1), best[at] >> 20, at - np.searchsorted(w.doc, doc), mention, near, n_words


class Model(NamedTuple):
    terms: list[tuple[str, bool]]
    automaton: Automaton
    certainty: np.ndarray  # term x edits
    weights: np.ndarray  # of the features, and the constant


def signature(column: pa.Array) -> np.ndarray:
    """Lowest hash of three neighbouring words of each text, of all its words where it has fewer: near
    copies mostly share it. Texts without words share one."""
    w = split(column)
    h = hashes(w.code.astype(np.uint32).view(np.uint8), w.begin * 4, (w.begin + w.size) * 4)
    size = np.bincount(w.doc, minlength=len(column))
    first = np.searchsorted(w.doc, np.arange(len(column)))
    out = np.zeros(len(column), np.uint64)
    out[size == 1] = mix(h[first[size == 1]])
    out[size == 2] = grams(h, 2)[first[size == 2]]
    g = grams(h, 3)
    g[w.doc[: len(g)] != w.doc[2:]] = np.iinfo(np.uint64).max
    long = np.flatnonzero(size >= 3)
    if len(long):
        out[long] = np.minimum.reduceat(g, first[long])
    return out.view(np.int64)


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int) -> DataFrame:
    """The sample's rows without near copies, and the third of the sample that each is in.

    Of rows of one signature the one with the lowest hash of its key (then key, hash of its text, label)
    stays, so the sample does not depend on how the tables are partitioned.
    """
    chosen = bounded_sample(labels.select(key, F.col(label).cast("int").alias("_label")), key, "_label", per_label)
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    signed = with_columns(rows, text, "_sig bigint", lambda: lambda chunk: [
        pa.array(signature(chunk.column(chunk.schema.get_field_index(text))), pa.int64())])
    rank = F.struct(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"), F.xxhash64(text).alias("t"),
                    F.col("_label").alias("y"), F.col(text).alias("x"))
    return (signed.groupBy("_sig").agg(F.min(rank).alias("r"))
            .select(F.col("r.k").alias(key), F.col("r.x").alias(text), F.col("r.y").alias("_label"), "_sig", F.pmod("_sig", F.lit(3)).alias("_part")))


def lexicon(rows: DataFrame, key: str, text: str) -> list[tuple[str, bool]]:
    """Words and beginnings of words that tell toxic rows of a sample (label 1) from the others."""

    def work(chunk):
        w = split(chunk.column(chunk.schema.get_field_index(text)))
        _, kind = distinct(w)
        pair = np.unique(np.stack((w.doc, kind)), axis=1, return_index=True)[1] if len(kind) else []
        flat = ["".join(map(chr, w.code[w.begin[x] : w.begin[x] + min(w.size[x], 32)])) for x in pair]
        return [lists(pa.array(flat, pa.string()), np.searchsorted(w.doc[pair] if len(kind) else np.zeros(0), np.arange(chunk.num_rows + 1)))]

    held = with_columns(rows, text, "_words array<string>", lambda: work, keep=[key, "_label"])
    word = held.select(key, "_label", F.explode("_words").alias("w"))
    keys = F.array(F.struct(F.col("w").alias("term"), F.lit(False).alias("prefix")),
                   *[F.struct(F.when(F.length("w") > n, F.substring("w", 1, n)).alias("term"), F.lit(True).alias("prefix")) for n in PREFIXES])
    each = word.select(key, "_label", F.explode(keys).alias("t")).where("t.term is not null").select(key, "_label", "t.term", "t.prefix").distinct()
    total = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if not total.get(1) or not total.get(0):
        return []
    toxic, clean = F.sum("_label"), F.count(F.lit(1)) - F.sum("_label")
    found = each.groupBy("term", "prefix").agg(toxic.alias("toxic"), clean.alias("clean"))
    lift = F.col("toxic") / total[1] / ((F.col("clean") + 0.5) / total[0])
    least = max(LEAST_DOCS, LEAST_SHARE * total[1])
    found = found.where((F.col("toxic") >= least) & (lift >= min(LEAST_RATIO, least / total[1] * total[0])))
    gain = F.col("toxic") / total[1] - 10 * F.col("clean") / total[0]
    chosen: list[tuple[str, bool]] = []
    for r in found.orderBy(F.desc(gain), "prefix", F.desc(F.length("term")), "term").limit(20 * MAX_TERMS).collect():
        covered = any((p and r["term"].startswith(t)) or t == r["term"] or (r["prefix"] and t.startswith(r["term"])) for t, p in chosen)
        if not covered:
            chosen.append((r["term"], r["prefix"]))
    return chosen[:MAX_TERMS]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_label: int = PER_LABEL) -> Model:
    """Lexicon, automaton, certainties and weights from at most ``per_label`` rows of each label."""
    rows = sampled(docs, labels, key, text, label, per_label)
    terms = lexicon(rows.where("_part > 0"), key, text)
    made = automaton(terms)
    certainty = np.array([[p for p, _ in PRIOR]] * max(1, len(terms)))
    if not terms:
        return Model(terms, made, certainty, np.zeros(4))
    found = hit_rows(rows.where("_part = 0"), made, text, ["_label"]).select("_label", "hits", "n_words").collect()
    total = [max(1, sum(r["_label"] == k for r in found)) for k in (0, 1)]
    seen = np.zeros((2, *certainty.shape))
    for r in found:
        for term, edits in {(h["term"], h["edits"]) for h in r["hits"]}:
            seen[r["_label"], term, edits] += 1
    p0, weight = (np.array(x)[None, :] for x in zip(*PRIOR))
    weight = weight * TOXIC_SHARE / total[1]
    toxic, clean = seen[1] / total[1] * TOXIC_SHARE, seen[0] / total[0] * (1 - TOXIC_SHARE)
    certainty = (toxic + p0 * weight) / (toxic + clean + weight)
    certainty[certainty < LEAST_CERTAINTY] = 0.0
    flat = [[(d, h["term"], h["edits"], h["mention"], h["near"]) for h in r["hits"]] for d, r in enumerate(found)]
    doc, term, edits, mention, near = (np.array(x, np.int64) for x in zip(*[h for hs in flat for h in hs])) if any(flat) else [np.zeros(0, np.int64)] * 5
    x = features(doc, term, edits, mention.astype(bool), near, certainty, np.array([r["n_words"] for r in found]))
    y = np.array([r["_label"] for r in found], float)
    share = np.where(y == 1, TOXIC_SHARE / total[1], (1 - TOXIC_SHARE) / total[0]) * len(y)
    seen = x[:, 0] > 0  # the others score 0; two made-up rows stand for what the sample may lack
    length = np.median(x[:, 2])
    x = np.vstack((x[seen], [[0.29, 0, length], [4.6, 1, length]]))
    return Model(terms, made, certainty, logistic(x, np.append(y[seen], [0, 1]), np.append(share[seen], [3.0, 3.0])))


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the constant is last, unpenalised."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - penalty @ w
        step = np.linalg.solve((x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def hit_rows(docs: DataFrame, made: Automaton, text: str, keep: list[str] | None) -> DataFrame:
    """Add ``hits``: term, edits, word number, whether it is a mention, and hits near."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(made))

    def make():
        a = Automaton(*held.value)

        def work(chunk):
            doc, term, edits, at, mention, near, n_words = hits(chunk.column(chunk.schema.get_field_index(text)), a)
            flat = pa.StructArray.from_arrays(
                [pa.array(x, pa.int32()) for x in (term, edits, at)] + [pa.array(mention.astype(bool), pa.bool_()), pa.array(near, pa.int32())],
                names=["term", "edits", "at", "mention", "near"])
            return [lists(flat, np.searchsorted(doc, np.arange(chunk.num_rows + 1))), pa.array(n_words, pa.int64())]

        return work

    return with_columns(docs, text, f"hits array<{HIT}>, n_words bigint", make, keep)


def features(doc, term, edits, mention, near, certainty: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Evidence (minus the log of the chance that no hit is meant; mentions count once, at a share),
    hits that are likely meant, and length, of each text."""
    n = len(n_words)
    p = np.minimum(0.99, certainty[term, edits] * (1 + NEAR_GAIN * np.minimum(near, 2))) if len(term) else np.zeros(0)
    evidence = np.bincount(doc, np.where(mention, 0, -np.log1p(-p)), minlength=n)
    told = np.zeros(n)
    np.maximum.at(told, doc, np.where(mention, -np.log1p(-p * MENTION), 0))
    meant = np.bincount(doc, (p >= 0.5) & ~mention, minlength=n)
    return np.column_stack((np.minimum(evidence + told, 12), np.minimum(meant, 3), np.log1p(n_words)))


def score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """0 where there is no evidence, else the regression's probability."""
    return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))), 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
            threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to each row."""
    held = docs.sparkSession.sparkContext.broadcast((tuple(model.automaton), model.certainty, model.weights))

    def make():
        a, certainty, weights = Automaton(*held.value[0]), *held.value[1:]

        def work(chunk):
            doc, term, edits, _, mention, near, n_words = hits(chunk.column(chunk.schema.get_field_index(text)), a)
            found = score(features(doc, term, edits, np.asarray(mention, bool), near, certainty, n_words), weights)
            return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

        return work

    return with_columns(docs, text, OUTPUT, make, keep)
