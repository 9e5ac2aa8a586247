"""Merkle manifest of a dataset as a persistent, path-copying tree of 16-ary runs.

Leaves are hashes of whole rows. Per source they ascend by key; every ``ARITY`` consecutive nodes
(the last run may be shorter, even one) become their parent's hash until one node remains, and the
sources' subroots are joined in the same way into one root. A tampered leaf makes a *version* of the
tree: it copies its ancestors and shares every other node with the original.

How it runs. Leaves are hashed in the scan, so texts never move. Rows are range-partitioned by
(source, key, leaf), written once with their place in the partition, and numbered by the counts per
partition and source; a source that holds most rows is simply cut into many partitions. From then
on a node is (tree, number), and the nodes of ``ARITY ** STEP`` aligned numbers form a block:
one shuffle per step builds ``STEP`` levels of every block, so blocks are bounded and even. Going
down again, every block gets the siblings between itself and the root (a few kilobytes, shared by all
its leaves), and each version's path is copied inside its own block of leaves, then continued through
those upper siblings. No version stores more than its own ancestors.

Edge cases: a null column is ``-``, an empty text ``0:``; null sources come first, null keys first
within a source; a null key is never tampered with; equal rows are separate, equal leaves. A lone leaf
is its source's subroot, and a lone subroot the root. An empty table has no rows and no tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coincide.llm.stage import written

ARITY, STEP = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[Column]) -> Column:
    """sha256 in lowercase hex of the columns' texts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in bytes and value of a field, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """The tampering: A-Z in lower case, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, key: str, group: str, fields: list[str], tampered: Column, text: str = "text") -> DataFrame:
    """(key, group, leaf, changed): each row's hash, and the hash of its tampered form where there is one."""
    own = digest([field(F.col(f"`{c}`")) for c in fields])
    other = digest([field(lowered(F.col(f"`{c}`")) if c == text else F.col(f"`{c}`")) for c in fields])
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("tree_name"), own.alias("leaf"),
                       F.when(tampered, other).alias("changed"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``tree`` (the group's number in order), ``number`` (the row's place in its group) and
    ``n`` (rows of the group), and the groups (tree, group, n).

    Rows are cut into ranges; only counts per range and group are ordered any further. Rows that are
    equal in ``group`` and ``order`` are interchangeable, so they may be cut anywhere.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.withColumn("_any", F.monotonically_increasing_id())  # equal rows need not share a range
    columns = [group, *order, "_any"]
    ranged = spread.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).drop("_any")
    at = F.monotonically_increasing_id()
    staged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", at), "numbered")
    held = staged.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    own = Window.partitionBy(group)
    held = written(
        held.withColumns({"_before": F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                          "n": F.sum("_n").over(own), "_first": F.min("_part").over(own)}), "held")
    # A group is counted where it begins; groups that begin in earlier ranges come before it.
    begun = held.where("_part = _first")
    earlier = begun.groupBy("_first").agg(F.count(F.lit(1)).alias("_begun")).select(
        "_first", F.coalesce(F.sum("_begun").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)),
                             F.lit(0)).alias("_earlier"))
    place = F.row_number().over(Window.partitionBy("_first").orderBy(group)) - 1
    groups = begun.withColumn("_place", place).join(earlier, "_first").select(
        group, "n", (F.col("_earlier") + F.col("_place")).cast("bigint").alias("tree"))
    # Null groups compare by a pair that is never null.
    safe = lambda d, name: d.withColumn(name, F.struct(F.coalesce(group, F.lit("")), F.col(group).isNull()))
    offsets = safe(held, "_g").join(safe(groups, "_g").select("_g", "tree"), "_g").select(
        "_part", "_g", "tree", "n", (F.coalesce("_before", F.lit(0)) - F.col("_from")).alias("_shift"))
    out = safe(staged, "_g").join(offsets, ["_part", "_g"])
    return out.withColumn("number", F.col("_at") + F.col("_shift")).drop("_g", "_part", "_at", "_shift"), groups


def _levels(n: Column) -> Column:
    """How many levels above ``n`` nodes, up to ``STEP``."""
    out = F.lit(0)
    for k in range(STEP):
        out = out + (n > ARITY**k).cast("int")
    return out


def _runs(nodes: Column) -> Column:
    """An array cut into runs of ``ARITY``."""
    count = F.ceil(F.size(nodes) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(nodes, i * ARITY + 1, F.lit(ARITY)))


def _joined(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def blocks(nodes: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per block of nodes (tree, number, n, digest): its digests in order, ``rows`` of the other
    columns, ``levels`` (a list of digests per level, from the block's nodes up) and its own digest."""
    kid = F.struct("number", "digest", *(extra or []))
    size = ARITY**STEP
    found = nodes.groupBy("tree", F.floor(F.col("number") / size).alias("block")).agg(
        F.array_sort(F.collect_list(kid)).alias("rows"), F.first("n").alias("n"))
    found = found.withColumns({"levels": F.array(F.col("rows.digest")), "_up": _levels(F.col("n"))})
    for k in range(STEP):
        above = F.transform(_runs(F.element_at("levels", -1)), _joined)
        found = found.withColumn("levels", F.when(F.col("_up") > k, F.concat("levels", F.array(above))).otherwise(F.col("levels")))
    return found.withColumn("digest", F.element_at(F.element_at("levels", -1), 1)).drop("_up")


def _siblings(levels: Column, number: Column, up: Column) -> Column:
    """For each level below a block's top, what stands left and right of the node above ``number``."""
    def beside(level: Column, depth: Column) -> Column:
        at = F.floor(number / F.pow(F.lit(float(ARITY)), depth)).cast("int")
        begin, own = (F.floor(at / ARITY) * ARITY).cast("int"), (at % ARITY).cast("int")
        run = F.slice(level, begin + 1, F.lit(ARITY))
        rest = F.slice(run, own + 2, F.lit(ARITY))
        return F.struct(F.array_join(F.slice(run, F.lit(1), own), "").alias("left"), F.array_join(rest, "").alias("right"))

    below = F.slice(levels, F.lit(1), up)
    return F.transform(below, beside)


def _sizes(n: Column) -> Column:
    """Nodes of a tree after one step."""
    return F.greatest(F.ceil(n / ARITY**STEP).cast("bigint"), F.lit(1).cast("bigint"))


def grown(nodes: DataFrame, most: int, extra: list[str] | None = None, name: str = "tree") -> list[DataFrame]:
    """Steps of blocks, from the given nodes up to one node per tree; each a written table. ``most`` is
    how many nodes the largest tree has."""
    out = []
    while not out or most > 1:
        built = written(blocks(nodes, None if out else extra), f"{name}-{len(out)}")
        out.append(built)
        most = -(-most // ARITY**STEP)
        nodes = built.select("tree", F.col("block").alias("number"), _sizes(F.col("n")).alias("n"), "digest")
    return out


def paths(steps: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the lowest step, each with ``path``, the siblings from its top to the root.

    ``above`` holds (tree, path, any others) of the trees' tops; the others are carried along.
    """
    others = [c for c in above.columns if c not in ("tree", "path")]
    path = above.withColumn("block", F.lit(0).cast("bigint"))
    for step in reversed(steps[1:]):
        within = _each(step.join(path, ["tree", "block"]), others)
        path = within.select("tree", F.col("row.number").alias("block"), "path", *others)
    return steps[0].join(path, ["tree", "block"])


def _each(found: DataFrame, others: list[str]) -> DataFrame:
    """The rows of blocks, each with its own path."""
    rows = found.select("tree", "path", "levels", *others, F.posexplode("rows").alias("at", "row"))
    siblings = _siblings(F.col("levels"), F.col("at"), F.size("levels") - 1)  # a tree of one node has no level above
    return rows.select("tree", "row", F.concat(siblings, F.col("path")).alias("path"), *others)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a node and its path: the copies of all its ancestors, lowest first."""
    return F.aggregate(path, start, lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))


def copies(start: Column, path: Column) -> Column:
    """The ancestors that a version copies, lowest first."""
    return F.aggregate(path, F.array(start), lambda done, side: F.concat(done, F.array(
        F.sha2(F.concat(side["left"], F.element_at(done, -1), side["right"]), 256))))


def tree(rows: DataFrame, order: list[str], group: str = "tree_name") -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Blocks of the groups' trees and of the tree above them, and the groups with their subroots, from
    ``leaves``."""
    placed, groups = numbered(rows, group, order)
    trees, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    own = grown(placed.withColumnRenamed("leaf", "digest"), most or 0, ["key", "changed"], "leaves")
    tops = own[-1].where("block = 0").select("tree", "digest")
    top = tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("number"), F.lit(trees).cast("bigint").alias("n"), "digest")
    return own, grown(top, trees, name="upper"), groups.join(tops.withColumnRenamed("digest", "subroot"), "tree")


def versions(own: list[DataFrame], upper: list[DataFrame]) -> DataFrame:
    """Every leaf with its path: (key, tree, number, leaf, changed, path), and the original subroot and root."""
    start = upper[-1].where("block = 0").select(
        "tree", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"), F.col("digest").alias("root"))
    tops = _each(paths(upper, start), ["root"]).select(
        F.col("row.number").alias("tree"), "path", F.col("row.digest").alias("subroot"), "root")
    each = _each(paths(own, tops), ["subroot", "root"])
    return each.select("row.key", "tree", "row.number", F.col("row.digest").alias("leaf"), "row.changed", "subroot", "root", "path")


def manifest(docs: DataFrame, tampered: Callable[[Column], Column], key: str = "doc_id", group: str = "source",
             fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each row's leaf, proof and verdict; rows where ``tampered(key)`` holds are folded from their tampered form."""
    rows = leaves(docs, key, group, list(fields), F.coalesce(tampered(F.col(f"`{key}`")), F.lit(False)))
    own, upper, _ = tree(rows, ["key", "leaf"])
    each = versions(own, upper)
    proof = F.sha2(F.array_join(F.transform("path", lambda side: F.concat(side["left"], side["right"])), ""), 256)
    out = each.select(F.col("key").alias(key), "leaf", "subroot", "root", proof.alias("proof_sha256"),
                      folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
