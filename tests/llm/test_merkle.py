"""The manifest against a plain version, and its parts by themselves."""

import hashlib
import zlib

import pytest
from plainly import LOWER, SCHEMA
from pyspark.sql import functions as F

from coincide.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(key):
    return F.crc32(key.cast("string")) % 5 == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(nodes):
    """Levels of a tree from its nodes to the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 16])) for i in range(0, len(low), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run, at = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 16
    return out


def plainly(rows):
    """rows: (doc_id, source, lang, n_chars, text); sorted result rows."""
    def leaf(row, change=False):
        row = [v.translate(LOWER) if change and k == 4 and v is not None else v for k, v in enumerate(row)]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for k, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = path(trees[s], k) + path(top, i)
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in way:
                node = sha(left + node + right)
            proof = sha("".join(x + y for x, y in way))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark, small, result):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, result("op12")), key=repr) == plainly(rows)


def test_odd_rows(spark, odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    assert got(merkle.manifest(odd, tampered)) == plainly(rows)


@pytest.mark.parametrize("sizes", [[1], [16, 17, 1], [256, 257], [1] * 300])
def test_sizes_of_trees(spark, sizes):
    """Lone leaves, full and overfull runs and blocks, and more sources than a block holds."""
    rows = [(1000 * s + i, None if s == 1 else f"s{s}", "en", i, f"Text {i % 7}") for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert got(merkle.manifest(df.repartition(5), tampered)) == plainly(rows)


def test_order_of_sources_and_text_keys(spark):
    rows = [("b", "é", "x", None, None), ("a", "z", None, 1, ""), (None, "Z", "x", 2, "A"), ("b", "", "x", 3, "Q"), ("a", None, "x", 3, "Q")]
    df = spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars bigint, text string")
    found = {tuple(r[:4]) for r in merkle.manifest(df, tampered).collect()}
    by = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode()))
    own = [sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in by]
    assert found == {(r[0], x, x, sha("".join(own))) for r, x in zip(by, own)}


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), tampered).count() == 0


def test_versions_share_all_but_their_path(spark):
    """A version's copies are its ancestors; every other node is the original's."""
    rows = [(i, "s", "en", i, f"T {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    held = merkle.leaves(df, "doc_id", "source", FIELDS, tampered(F.col("doc_id")))
    own, upper, groups = merkle.tree(held, ["key", "leaf"])
    assert [(r.tree, r.n, r.subroot) for r in groups.select("tree", "n", "subroot").collect()] == [(0, 600, up([r.leaf for r in held.orderBy("key").collect()])[-1][0])]
    each = merkle.versions(own, upper)
    new = each.where("changed is not null").select("number", merkle.copies(F.col("changed"), F.col("path")).alias("nodes")).collect()
    leafs = {r.key: (r.leaf, r.changed) for r in held.collect()}
    for r in new[:20]:
        changed = [leafs[i][1] if i == r.number else leafs[i][0] for i in range(600)]
        levels = up(changed)
        assert r.nodes == [level[r.number // 16**k] for k, level in enumerate(levels)]
