"""Null, empty, long and repeated rows, null keys, clashing columns and empty tables, for each operator."""

import pytest
from plainly import SCHEMA
from pyspark.sql import functions as F

from coincide.llm import contamination, jaccard, katz, language, parsing, pieces, quality, tokens, toxicity, urls
from coincide.llm.text import crc_part


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(18)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def none(spark):
    return empty(spark, SCHEMA)


def test_katz(spark, odd, none):
    held = crc_part("doc_id", 7) == 2
    rows = katz.score(odd, ~held, held).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r.doc_id in (0, 1, 2)]
    assert {r.n_tokens for r in blank} == {1} and len({(r.score, r.base_score) for r in blank}) == 1
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert katz.score(none, ~held, held).count() == 0
    assert {r.score for r in katz.score(odd, F.lit(False), held).collect()} == {0.0}  # nothing learned


def test_quality(spark, odd, none, labels):
    model = quality.fit(odd, labels)
    rows = quality.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (0, 1)} == {model.prior}
    assert quality.predict(none, model).count() == 0
    untaught = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.predict(odd, untaught).collect()} == {0.5}


def test_pieces(spark, odd, none):
    rows = pieces.round_trip(odd).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (0, 1)} == {0}
    back = pieces.decode(pieces.encode(odd, keep=["doc_id"])).select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, r.text or "") for r in odd.select("doc_id", "text").collect())
    assert sorted((r.doc_id or -1, r.text) for r in back) == want
    assert pieces.round_trip(none).count() == 0


def test_jaccard(spark, odd, none):
    rows = jaccard.groups(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (0, 1, 2))
    assert by[3].component_id == by[4].component_id == 3  # one word, in two cases
    assert by[7].component_id == by[8].component_id == by[9].component_id == 7
    assert by[10].component_id == by[11].component_id == 10
    assert {r.component_id for r in rows if r.doc_id is None} == {7, None}
    assert jaccard.groups(none).count() == 0


def test_fingerprints(spark, odd, none):
    rows = parsing.with_next(odd).collect()
    assert len(rows) == odd.count()
    prints = {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None}
    assert prints[0] == prints[1] == "" and prints[7] == prints[8] and prints[10] == prints[11]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert parsing.with_next(none).count() == 0
    alone = parsing.with_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 4


def test_fingerprints_with_text_keys(spark):
    """Keys that are no numbers follow in their own order; null comes last."""
    rows = [("b10", "one two"), ("b9", "three four five"), (None, "six"), ("a", "seven eight nine"), ("a", "seven eight nine")]
    named = {(r.doc_id, r.edited_sha256, r.fingerprint, r.near_next) for r in parsing.with_next(
        spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    place = {"a": 1, "b10": 2, "b9": 3}
    back = {v: k for k, v in place.items()}
    same = [(place.get(k), t) for k, t in rows]
    numbered = {(back.get(r.doc_id), r.edited_sha256, r.fingerprint, r.near_next) for r in parsing.with_next(
        spark.createDataFrame(same, "doc_id bigint, text string")).collect()}
    assert named == numbered


def test_urls(spark):
    rules = [("org/", "allow"), ("com/de/", "block")]
    some = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG"), (5, "http://a.org/x?y"), (5, "http://a.org/x?y"),
            (6, "x://b.com/de/1#t"), (7, "http://net\n/p"), (None, "http://c.net/"), (8, "q" * 90_000 + "://org/")]
    pages = spark.createDataFrame(some, "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit("s"))
    rows = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert [(rows[i].host, rows[i].path) for i in (1, 2, 3)] == [("", "")] * 3
    assert (rows[4].host, rows[4].path, rows[4].rule) == ("a.org", "", None)
    assert (rows[5].rule, rows[5].verdict, rows[6].rule, rows[6].verdict) == ("org/", "allow", "com/de/", "block")
    assert rows[8].rule == "org/" and rows[7].host == "net\n"
    assert urls.judge(pages, rules).count() == len(some)
    assert urls.judge(empty(spark, "page_id bigint, url string"), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_toxicity(spark, odd, none, labels):
    model = toxicity.fit(odd, labels)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (0, 1, 2)} == {0.0}
    assert toxicity.predict(none, model).count() == 0
    assert {r.score for r in toxicity.predict(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.0}


def test_language(spark, odd, none):
    rows = language.predict(odd, language.fit(odd)).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 6, 15)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (3, 7, 10)} <= {"en", "de"}
    assert language.predict(none, language.fit(odd)).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(none)).collect()} == {"und"}


def test_contamination(spark, odd, none):
    items = spark.createDataFrame([(1, "two three Four"), (2, None), (None, ""), (3, "two three four"), (4, "nowhere at all")],
                                  "item_id bigint, text string")
    rows = contamination.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert (by[7].n_words, by[7].n_hit, by[7].n_items, by[7].contaminated) == (6, 3, 2, True)
    assert [(m.item_id, m.item_at, m["at"], m.length) for m in by[7].matches] == [("1", 0, 1, 3), ("3", 0, 1, 3)]
    assert by[0].n_words == by[1].n_words == 0 and not by[0].contaminated
    assert contamination.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in contamination.contamination(odd, items.limit(0)).collect())


def test_tokens(spark, odd, none):
    table = tokens.histogram(tokens.lengths(odd))
    rows = {r.n_tokens: r for r in table.collect()}
    assert rows[0].docs == 3 and sum(r.docs for r in rows.values()) == odd.count()
    assert tokens.histogram(tokens.lengths(none)).count() == 0
    assert tokens.at_limits(table, []).count() == 0
