"""Phrases against a plain version, and the graph's parts by themselves."""

import collections
import random
import re

import pytest
from plainly import LOWER, SCHEMA

from coincide.llm import phrases

CUT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plainly(rows, least, top):
    """rows: (text, lang)."""
    count = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in CUT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            for k in range(1, 6):
                count["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        met = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        gone = {p[i : i + m] for p, c in met.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * c >= 100 * met[p[i : i + m]]}
        found = []
        for p, a in met.items():
            if p not in gone:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def corpus(seed=2):
    draw = random.Random(seed)
    stock = ["Now is the time for all good men", "a a a a a a a", "for all we know", "x y x y x y x y", "é ß 日本 é ß", "Q\tr\x0bs"]
    rows = []
    for i in range(300):
        parts = [draw.choice(stock) if draw.random() < 0.7 else " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(9))) for _ in range(4)]
        rows.append((draw.choice([". ", "; ", " ", "\n"]).join(parts), draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "de"), ("lone", "xx"), (" ".join(["z"] * 5000), "en"), ("k" * 70_000 + " v", "en")]


@pytest.mark.parametrize("least, top, parts, held", [(2, 2000, 1, 1 << 20), (5, 40, 6, 50), (1, 10, 3, 2)])
def test_plain_version(spark, monkeypatch, least, top, parts, held):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "CHUNK", 1 << 12)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    assert got(phrases.collocations(df, least=least, top=top)) == plainly(rows, least, top)


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select("text", "lang").collect()]
    assert got(phrases.collocations(odd, least=2)) == plainly(rows, 2, phrases.TOP)


def test_whole_table(spark, small, result):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("text", "lang").collect()]
    assert got_rows(result("op13")) == plainly(rows, phrases.LEAST, phrases.TOP)


def got_rows(rows):
    return sorted(map(tuple, rows))


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    a = 9 * 10**13
    some = spark.createDataFrame([(1, [1, 2], a), (1, [1, 2, 3], a - 1)], "lc bigint, words array<bigint>, a bigint")
    known = some.unionAll(spark.createDataFrame([(1, [1], 7 * a), (1, [2], 5 * a), (1, [3], 3 * a), (1, [2, 3], 2 * a)], some.schema))
    n = 99 * 10**14
    found = {tuple(r.words): (r.l, r.r, r.score) for r in phrases.scored(some, known, spark.createDataFrame([(1, n)], "lc bigint, n bigint")).collect()}
    assert found[1, 2] == (7 * a, 5 * a, 1000 * a * n // (35 * a * a))
    cuts = [(1000 * (a - 1) * n // (left * right), k, left, right) for k, left, right in ((1, 7 * a, 2 * a), (2, a, 3 * a))]
    score, _, left, right = min(cuts)
    assert found[1, 2, 3] == (left, right, score)


def test_paths_spell_every_edge_once(spark, monkeypatch):
    """Chains, branches, a ring and a loop."""
    monkeypatch.setattr(phrases, "PIECE", 4)
    chain, ring = list(range(1, 30)), [50, 51, 52, 53, 54, 55]
    runs = [chain[i : i + 5] for i in range(25)] + [(ring * 2)[i : i + 5] for i in range(6)] + [[9] * 5, [10, 11, 12, 13, 99], [98, 20, 21, 22, 23]]
    df = spark.createDataFrame([(7, *r, 100 + i) for i, r in enumerate(runs)], "lc bigint, w1 bigint, w2 bigint, w3 bigint, w4 bigint, w5 bigint, n bigint")
    made = phrases.paths(df).collect()
    spelled = sorted((r.words[i : i + 5], n) for r in made for i, n in enumerate(r.weights))
    assert spelled == sorted((r, 100 + i) for i, r in enumerate(runs))
    assert max(len(r.weights) for r in made) == 4 and sum(len(r.weights) > 1 for r in made) >= 5


def test_flows(spark):
    """Shorter counts follow from edges and ends alone."""
    runs = [([1, 2, 3, 4, 5], 7), ([1, 2, 3, 4, 6], 2), ([1, 2, 3, 4, 0], 1), ([1, 2, 0, 0, 0], 4)]
    rows = [(1, *r, sum(w > 0 for w in r), n) for r, n in runs]
    found = spark.createDataFrame(rows, "lc bigint, w1 bigint, w2 bigint, w3 bigint, w4 bigint, w5 bigint, size int, n bigint")
    five, four, three, two = [sorted(tuple(r)[1:] for r in f.collect()) for f in phrases.flows(found)]
    assert five == [(1, 2, 3, 4, 5, 7), (1, 2, 3, 4, 6, 2)] and four == [(1, 2, 3, 4, 10)]
    assert three == [(1, 2, 3, 10)] and two == [(1, 2, 14)]


def test_named_columns(spark):
    df = spark.createDataFrame([("a b " * 3, "en", 1)], "body string, tongue string, rank int")
    assert got(phrases.collocations(df, "body", "tongue", least=2)) == plainly([("a b " * 3, "en")], 2, 9)


def test_runs_grow_with_kept_words_only(spark, monkeypatch):
    """Pairs that become frequent in a larger input bring no runs along whose triples stay rare."""
    made, keep = {}, phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, name, *by: made.setdefault(name, keep(df, name, *by)))
    draw = random.Random(4)
    rows = [(" ".join(draw.choice("abcdefghijkl") for _ in range(60)), "en") for _ in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert got(phrases.collocations(df, least=20)) == plainly(rows, 20, phrases.TOP)
    pairs, triples, longer = 12**2, 12**3, made["runs"].where("size > 2").count()
    assert made["pairs"].count() == pairs and longer < triples // 10 and made["runs"].count() <= pairs + longer


@pytest.mark.parametrize("places", [1, 3, 7])
def test_rows_of_stretches(spark, monkeypatch, places):
    """Runs that cross rows of stretches count once."""
    monkeypatch.setattr(phrases, "PLACES", places)
    monkeypatch.setattr(phrases, "HELD", 40)
    rows = corpus(3)[:60] + [(" ".join(["z", "y y"] * 300), "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert got(phrases.collocations(df, least=3, top=500)) == plainly(rows, 3, 500)


def test_rows_of_many_tasks(spark, monkeypatch):
    """Pairs that all tasks meet aren't named by all of them, and triples bring rows by slices of the bitmap only."""
    made, keep = [], phrases._tallied
    monkeypatch.setattr(phrases, "_tallied", lambda *of: made.append(keep(*of).cache()) or made[-1])
    monkeypatch.setattr(phrases, "SLICE", phrases.BITS // 16, raising=False)
    draw = random.Random(4)
    rows = [(" ".join(draw.choice("abcdefghijkl") for _ in range(60)), "en") for _ in range(100)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(20)
    assert got(phrases.collocations(df, least=20)) == plainly(rows, 20, phrases.TOP)
    _, pairs, triples, runs = (m.count() for m in made)
    assert pairs > 10 * 12**2 and triples <= 16 * 20 and runs < 2 * 12**2
