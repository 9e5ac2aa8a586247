"""The registered queries against plain versions, exact round trips or held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plainly import PLAIN, components, edits, katz, words

from coincide.llm import contamination, jaccard, parsing, pieces, tokens, toxicity, urls
from coincide.llm.queries import QUERIES, URL_RULES


def part(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_op1_scores(result, documents):
    lists = {k: words(t) for k, t in documents}
    want, n, sums = katz([w for k, w in lists.items() if part(k, 7) != 2], list(lists.values()))
    assert all(abs(s - 1) < 1e-9 for s in sums)
    rows = {r.doc_id: r for r in result("op1")}
    assert len(rows) == len(lists)
    for (key, w), (base, score, known) in zip(lists.items(), want):
        r = rows[key]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part(key, 7) == 2, len(w) + 1, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-10) and r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("op, of, held, label, least", [("op2_quality", 5, 0, "quality", 0.95), ("op7_toxicity", 4, 2, "toxic", 0.93)])
def test_held_out_labels(spark, op, of, held, label, least):
    larger = "/root/testdata/sf0.01"
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = QUERIES[op](spark, larger).collect()
    assert all(r.held_out == (part(r.doc_id, of) == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in known) >= least * len(known)


def test_op8_held_out(spark, small, result):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = [r for r in result("op8") if r.held_out]
    assert all(part(r.doc_id, 3) == 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_op3_round_trip(result, documents):
    assert len(result("op3")) == len(documents) and all(r.lossless for r in result("op3"))


def test_op3_samples_the_distribution():
    """Frequencies of all ways to cut a text against their exact probabilities; draws depend on the key only."""
    import sentencepiece

    held, v, n, theta = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.vocabulary(pieces.MODEL), 20_000, 0.5

    def ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            i = held.piece_to_id(rest[:k])
            if held.id_to_piece(i) == rest[:k]:
                for tail, weight in ways(rest[k:]):
                    yield (i, *tail), theta * v.weight[i] + weight

    for text in ("the cat", "ab\ncd", "  to"):
        draw = np.arange(n, dtype=np.uint64) * np.uint64(7919)
        ids, first, logp = pieces.sample(pa.array([text] * n), draw, v, theta)
        got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(first, first[1:]))
        again = pieces.sample(pa.array(["x", text]), draw[[5, 17]], v, theta)
        assert again[0][again[1][1] :].tolist() == ids[first[17] : first[18]].tolist()
        if "\n" in text:
            continue
        weight = {k: math.exp(w) for k, w in ways("▁" + text.replace(" ", "▁"))}
        total = sum(weight.values())
        seen = {tuple(ids[a:b].tolist()): p for a, b, p in zip(first, first[1:], logp)}
        for way, count in got.items():
            p = weight[way] / total
            assert seen[way] == pytest.approx(math.log(p), abs=1e-9)
            assert abs(count - n * p) < 6 * math.sqrt(n * p) + 6


def test_op4_components(result, documents):
    want, sizes = components(documents)
    rows = {r.doc_id: r for r in result("op4")}
    assert [(rows[k].n_shingles, rows[k].component_id) for k, _ in documents] == [(sizes[i], want[i]) for i in range(len(documents))]


def near_copies(rng, n, size, change):
    base = [f"w{rng.integers(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(size, size=rng.integers(change)):
            copy[at] = f"v{rng.integers(10_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_on_long_lists_and_small_sets(spark, monkeypatch, seed):
    """Sets of every small size and groups around the threshold, with lists cut into tiny blocks."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"u{rng.integers(3)}" for _ in range(rng.integers(0, 14))) for _ in range(120)]
    for size, change in ((8, 2), (14, 3), (40, 5), (120, 9)):
        texts += near_copies(rng, 25, size, change)
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    want, sizes = components(docs)
    rows = {r.doc_id: r for r in jaccard.groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()}
    assert [rows[k].component_id for k, _ in docs] == [want[i] for i in range(len(docs))]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 11, 30, 200, 3000])
def test_allotment_tolerates_the_difference(size):
    """However the differences fall, some segment of an allotment survives them."""
    most = jaccard.Bands(80, size).difference(size + size * 100 // 80)
    deleted, single = jaccard.allotment(size, most)
    assert single >= max(0, most - 2 * deleted + 1) and deleted + single >= 1
    assert 2 * deleted + max(0, most - 2 * deleted + 1) > most


def test_op5_next_and_edited(result, documents):
    order = sorted(documents, key=lambda d: -d[0])
    rows = {r.doc_id: r for r in result("op5")}
    prints = collections.defaultdict(set)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        r, half = rows[key], len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        prints[text].add(r.fingerprint)
        prints[changed].add(r.edited_fingerprint)
        a, b = (parsing.sketches(pa.array([t])) for t in (text, after))
        assert r.near_next == pytest.approx(float(parsing.likeness(a, b)[0]))
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in rows.values() if r.n_chars > 2000]
    assert 0.2 < np.mean([r.near_edited for r in long]) < 0.5 and np.mean([r.near_next for r in long]) < 0.1


def test_parsing_is_locally_consistent():
    """A passage keeps its interior phrases at any offset and between any neighbours."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefgh \n"))
    passage = "".join(rng.choice(letters, 4000))
    a = "".join(rng.choice(letters, 37)) + passage + "".join(rng.choice(letters, 11))
    b = "".join(rng.choice(letters, 5)) + passage + "".join(rng.choice(letters, 90))

    def phrases(text):
        x, first, out = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), set()
        for _ in range(3):
            x, first = parsing._level(x, first)
            out |= set(x.tolist())
        return out

    one, two = phrases(a), phrases(b)
    assert len(one & two) > 0.9 * min(len(one), len(two))


def test_op6_hosts_and_rules(spark, small, result):
    rows = {r.page_id: r for r in result("op6")}
    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", page.url or "")
        host, path = (found[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), found[2]) if found else ("", "")
        fits = [(rule, says) for rule, says in URL_RULES for name, slash, rest in [rule.partition("/")]
                if (host == name or host.endswith("." + name)) and path.startswith(slash + rest)]
        rule = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        r = rows[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule[0]) and r.verdict in ((rule[1],) if fits else ("allow", "block"))


def test_markov_models_are_distributions_and_match_the_recursion(spark):
    data = [("abab", 1), ("abba", 1), ("aab", 1), ("bcb", 0), ("cc", 0), ("", 0)]
    models = urls.fit(spark.createDataFrame(data, "t string, g int"), "t", "g")
    for label, model in enumerate(models):
        counts = collections.defaultdict(collections.Counter)
        for text, g in data:
            if g == label:
                symbols = [*text.encode(), urls.END]
                for i, s in enumerate(symbols):
                    padded = [urls.START] * urls.ORDER + symbols[:i]
                    for k in range(urls.ORDER + 1):
                        counts[tuple(padded[len(padded) - k :])][s] += 1

        def chance(before, s):
            p = 1 / urls.SYMBOLS
            for k in range(urls.ORDER + 1):
                seen = counts.get(tuple(before[len(before) - k :]))
                if not seen or sum(seen.values()) < 2:
                    break
                p = (seen[s] + len(seen) * p) / (sum(seen.values()) + len(seen))
            return p

        for text in ("abab", "ca", "", "zz"):
            symbols, total = [*text.encode(), urls.END], 0.0
            for i, s in enumerate(symbols):
                before = [urls.START] * urls.ORDER + symbols[:i]
                total += math.log(chance(before, s))
                assert sum(chance(before, x) for x in range(urls.SYMBOLS)) == pytest.approx(1)
            assert urls.log_likelihood(pa.array([text]), model)[0][0] == pytest.approx(total)


def test_automaton_finds_what_edit_distance_says():
    terms = [("idiot", False), ("scum", False), ("worthless", False), ("blockhead", True), ("été", False)]
    made = toxicity.automaton(terms)
    rng = np.random.default_rng(7)
    some = [t for t, _ in terms]
    for _ in range(600):
        w = list(some[rng.integers(len(terms))])
        for _ in range(rng.integers(4)):
            at, kind = rng.integers(len(w) + 1), rng.integers(3)
            w[at : at + (kind > 0)] = [] if kind == 1 else [chr(rng.integers(97, 123))]
        some.append("".join(w) + ("" if rng.integers(2) else "ing"))
    some = [w for w in some if w]
    code = np.array([ord(c) for w in some for c in w])
    size = np.array([len(w) for w in some])
    best = toxicity.run(made, code, np.cumsum(size) - size, size)
    for w, b in zip(some, best):
        found = []
        for k, (term, prefix) in enumerate(terms):
            e = min(edits(term, w[:n]) for n in range(len(w) + 1)) if prefix else edits(term, w)
            if e <= toxicity.budget(term, prefix):
                found.append((e, k))
        assert (int(b >> 20), int(b & 0xFFFFF)) == min(found) if found else b == toxicity.NONE


def test_mentions_count_for_less():
    made = toxicity.automaton([("idiot", False), ("moron", False)])
    texts = ["you idiot and moron", 'it said "idiot and moron" there', "the word idiot", "«idiot» alone", "you 1diot"]
    doc, term, edit, _, mention, near, n = toxicity.hits(pa.array(texts), made)
    assert list(zip(doc.tolist(), mention.astype(bool).tolist())) == [(0, False), (0, False), (1, True), (1, True), (2, True), (3, True), (4, False)]
    assert edit.tolist()[-1] == 1 and near.tolist()[0] == 1
    sure = np.full((2, 3), 0.9)
    x = toxicity.features(doc, term, edit, mention.astype(bool), near, sure, n)
    assert x[0, 0] > 3 * x[1, 0] and x[1, 0] > 0


def brute_hits(items, text, window=10):
    w = words(text, PLAIN)
    hit, found = set(), set()
    for key, item in items:
        i = words(item, PLAIN)
        size = min(window, len(i))
        runs = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if size else set()
        for k in range(len(w) - size + 1 if size else 0):
            if tuple(w[k : k + size]) in runs:
                hit |= set(range(k, k + size))
                found.add(str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op9_windows(spark, small, result, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r.doc_id: tuple(r)[1:] for r in result("op9")}
    assert any(r[-1] for r in rows.values())
    for key, text in documents:
        assert rows[key] == brute_hits(items, text)


def test_benchmarks_larger_than_a_broadcast_are_looked_up_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(list("abcd"), n))
    items = [(i, text(int(rng.integers(0, 9)))) for i in range(30)]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(40)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (20, 10_000):
        monkeypatch.setattr(contamination, "GROUP_WORDS", size)
        rows = contamination.contamination(*frames, window=4).drop("text").collect()
        for r in rows:
            want = brute_hits(items, docs[r.doc_id][1], 4)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
            for m in r.matches:
                a, b = docs[r.doc_id][1].split(), items[int(m.item_id)][1].split()
                assert a[m["at"] : m["at"] + m.length] == b[m.item_at : m.item_at + m.length]


def test_op10_histogram(spark, result, documents):
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    n = [len(encode(t or "")) for _, t in documents]
    rows = result("op10")
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.n_tokens)] == sorted(set(n))
    for r in rows:
        at = r.n_tokens
        assert (r.docs, r.docs_within, r.tokens_within, r.docs_beyond, r.truncated_tokens, r.total_docs, r.total_tokens) == (
            n.count(at), sum(x <= at for x in n), sum(x for x in n if x <= at), sum(x > at for x in n), sum(min(x, at) for x in n), len(n), sum(n))
    table = spark.createDataFrame(rows)
    for r in tokens.at_limits(table, [0, 100, 1000, 10**9]).collect():
        assert (r.docs_within, r.truncated_tokens) == (sum(x <= r.limit for x in n), sum(min(x, r.limit) for x in n))
    assert tokens.quantile(table, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
