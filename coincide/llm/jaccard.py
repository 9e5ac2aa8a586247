"""Exact Jaccard join of word n-gram sets by partitions of the universe.

The method. Sets fall into size bands; two sets can only link if they lie in the same band or in
neighbouring ones. For each band the universe of shingles is hashed into segments. Two sets that link
differ in at most ``H`` shingles (H follows from the sizes), so by the pigeonhole principle most of
their segments are equal. A segment costs one signature (its subset), or one more for each shingle
(the subset and all its one-deletion neighbours, which tolerates two differences instead of one);
``allotment`` chooses by estimated cost how many segments of a band get deletions. Of the others, a
set emits the ``H - 2d + 1`` with the most shingles: segments are ranked in an order that depends on
their content alone, so two sets with enough equal segments share one of the first (prefix filter).

The work. Sets are known by a 64-bit hash of their content (a class), so exact copies meet once.
Signatures travel as packed arrays to the task that owns their hash range. A short posting list gives
all its pairs; of a long one every member is paired with the list's least class only. Pairs are
pruned by size and by a parity sketch (a lower bound of the difference), verified on whole sets, and
joined to components. Members of long lists that are still in different components are then compared
in blocks within the tasks: lists are cut into blocks of ``BLOCK`` members, each pair of blocks is a
group of its own, and only pairs that survive the sketches become rows to verify. Members that are
already connected need no comparison, so a large group of near copies costs rows in proportion to
its size, and no link between components is lost.

Every link lies within a component. ``every_link`` therefore finds the links that connect nothing new
by comparing each component with itself: its classes are cut into blocks, every two blocks meet as one
group with their whole sets, each pair in one group only, and a matrix product counts what they share.
Only sums leave a group where links are counted by document.

Edge cases: null and empty texts, and texts without words, have no shingles, class or links and form
a component of their own. Texts of fewer words than a shingle are one shingle as a whole. Repeated
rows link to each other. A null key never is a component's id unless all its keys are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.llm.components import components
from coincide.llm.stage import written
from coincide.llm.text import SPACED, chunks, grams, lowered, mapped, mix, with_columns

#: Segments beyond those needed, as a factor; a band's upper size over its lower one follows from the
#: threshold. Cost of a chance meeting of signatures, and how fast its likelihood falls by shingle.
SPARE, MEETING, RARITY = 1.2, 50.0, 0.3
#: Posting lists up to this length give all pairs; longer ones are compared in blocks of BLOCK.
SHORT, BLOCK = 8, 1024
#: Most bytes of whole sets in a block of a component (a larger set comes alone), shingles multiplied at once.
BLOCK_BYTES, SHARED = 16 << 20, 4096
SKETCH_BITS = 2048
#: Pairs compared at once in a task.
PAIRS = 1 << 18
#: Most bits of the filter of wanted keys that is sent to the tasks.
FILTER_BITS = 1 << 26
_U = np.uint64


class Bands:
    """Size bands up to a size, and the segments of each."""

    def __init__(self, percent: int, largest: int) -> None:
        self.percent = percent
        upper = [1]
        while upper[-1] < largest:
            upper.append(max(upper[-1] + 1, (upper[-1] + 1) * 100 // percent))
        self.upper = np.array(upper, np.int64)
        self.most = self.difference(self.upper + self.partner(self.upper))
        made = [allotment(int(u), int(h)) for u, h in zip(self.upper, self.most)]
        self.deleted = np.array([d for d, _ in made], np.int64)
        self.single = np.array([e for _, e in made], np.int64)

    def partner(self, size):
        """Largest set that a set of this size can link with."""
        return size * 100 // self.percent

    def difference(self, total):
        """Most shingles by which two linked sets of this total size differ."""
        return total * (100 - self.percent) // (100 + self.percent)


def allotment(size: int, most: int) -> tuple[int, int]:
    """Segments with deletions, and segments without, of a band: the cheapest that tolerate ``most``
    differences. The cost counts signatures, and meetings by chance: the fewer shingles a signature
    stands for, the likelier they are."""
    best = None
    for d in range((most + 1) // 2 + 1):
        need = max(0, most - 2 * d + 1)
        single = int(np.ceil(SPARE * need)) if most else need
        if d + single == 0:
            continue
        held = size / (d + single)
        cost = need * (1 + MEETING * RARITY**held) + d * (1 + held) * (1 + MEETING * RARITY ** max(0.0, held - 1))
        if best is None or cost < best[0]:
            best = (cost, d, single)
        if d > 64:
            break
    return best[1], best[2]


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and where each text begins."""
    h, first = lowered(column, SPACED)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    g = grams(h, size)
    inside = doc[: len(g)] == doc[size - 1 :]
    g, owner = g[inside], doc[: len(inside)][inside]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        g = np.concatenate((g, np.array([grams(h[first[i] : first[i + 1]], int(n[i]))[0] for i in few], _U)))
        owner = np.concatenate((owner, few))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def classes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set's content (0: empty)."""
    out = np.zeros(len(first) - 1, _U)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(mix(g ^ _U(0xA5A5A5A5)), first[full]) + np.diff(first)[full].astype(_U))
    return out


def sketches(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of the set's members by hash bucket, packed: rows that differ in k bits belong to sets
    that differ in k members at least."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * SKETCH_BITS + (mix(g ^ _U(0x5EED)) % _U(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(bool).reshape(n, SKETCH_BITS)
    return np.packbits(odd, axis=1)


def signatures(g: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the set of each."""
    size = np.diff(first)
    band = np.searchsorted(bands.upper, size)
    out, owner = [], []
    for lower in (0, 1):  # as the smaller set of a pair, or in its band; and as the larger, one band up
        level = band - lower
        most = bands.difference(size + (bands.partner(size) if not lower else bands.upper[np.maximum(level, 0)]))
        use = (size > 0) & (level >= 0) & (~bool(lower) | (bands.partner(bands.upper[np.maximum(level, 0)]) >= size))
        sets = np.flatnonzero(use)
        if len(sets):
            s, o = _emit(g, first, sets, level[sets], np.minimum(most[sets], bands.most[level[sets]]), bands)
            out.append(s)
            owner.append(o)
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, _U), np.zeros(0, np.int64))


def _emit(g, first, sets, level, most, bands: Bands):
    size = np.diff(first)[sets]
    at = np.repeat(first[:-1][sets] - np.cumsum(size) + size, size) + np.arange(size.sum())
    member = g[at]
    row = np.repeat(np.arange(len(sets)), size)
    deleted, single = bands.deleted[level], bands.single[level]
    count = deleted + single
    base = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        place = mix(member + (level[row].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        part = (place % count[row].astype(_U)).astype(np.int64)
        slot = base[row] + part
        value = mix(place)
        total = np.zeros(int(count.sum()), _U)
        np.add.at(total, slot, value)
        held = np.bincount(slot, minlength=len(total))
        owner = np.repeat(np.arange(len(sets)), count)
        number = np.arange(len(total)) - base[owner]
        salt = mix(number.astype(_U) * _U(0xD6E8FEB86659FD93) + level[owner].astype(_U))
        whole = mix(total + salt)
        plain = number >= deleted[owner]
        order = np.lexsort((whole[plain], -held[plain], owner[plain]))
        chosen = np.flatnonzero(plain)[order]
        rank = np.arange(len(chosen)) - (np.cumsum(single) - single)[owner[chosen]]
        chosen = chosen[rank < (most - 2 * deleted + 1)[owner[chosen]]]
        out, who = [whole[chosen]], [owner[chosen]]
        if (~plain).any():
            out.append(whole[~plain])
            who.append(owner[~plain])
            one = part < deleted[row]
            out.append(mix(total[slot[one]] - value[one] + salt[slot[one]]))
            who.append(row[one])
    return np.concatenate(out), sets[np.concatenate(who)]


def describe(docs: DataFrame, text: str, keep: list[str], size: int) -> DataFrame:
    """Add ``n_shingles``, ``class`` (null without shingles) and ``sketch`` to each row."""

    def make():
        def work(chunk):
            g, first = shingle_sets(chunk.column(chunk.schema.get_field_index(text)), size)
            n, sketch = np.diff(first), sketches(g, first)
            return [pa.array(n, pa.int64()), pa.array(classes(g, first).view(np.int64), pa.int64(), mask=n == 0),
                    pa.array([x.tobytes() for x in sketch], pa.binary())]

        return work

    return with_columns(docs, text, "n_shingles bigint, class bigint, sketch binary", make, keep)


def postings(docs: DataFrame, text: str, size: int, percent: int, largest: int, parts: int) -> DataFrame:
    """Rows (a, b, list): pairs of short posting lists (list is null), and members ``a`` of long ones
    with the list's least class ``b``."""

    def pack(batches):
        bands = Bands(percent, largest)
        for chunk in chunks(batches, text):
            g, first = shingle_sets(chunk.column(0), size)
            name = classes(g, first)
            _, one = np.unique(name, return_index=True)
            only = np.zeros(len(name), bool)
            only[one] = True  # copies within the chunk emit once
            s, owner = signatures(g, first, bands)
            s, owner = s[only[owner]], owner[only[owner]]
            owned = ((s >> _U(40)) % _U(parts)).astype(np.int64)
            order = np.argsort(owned, kind="stable")
            s, owner, cuts = s[order], owner[order], np.searchsorted(owned[order], np.arange(parts + 1))
            rows = [(p, s[a:b].tobytes(), name[owner[a:b]]) for p, a, b in zip(range(parts), cuts, cuts[1:]) if a < b]
            if rows:
                packed = [_indexed(n) for _, _, n in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())],
                    names=["part", "signatures", "names", "which"])

    def meet(batches):
        held, named = [], []
        for batch in batches:
            for s, names, which in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                held.append(np.frombuffer(s, _U))
                named.append(np.frombuffer(names, _U)[np.frombuffer(which, np.uint16)])
        if not held:
            return
        s, name = np.concatenate(held), np.concatenate(named)
        del held, named
        order = np.argsort(s)  # most signatures are alone: only the others need a full order
        s, name = s[order], name[order]
        equal = s[1:] == s[:-1]
        shared = np.zeros(len(s), bool)
        shared[1:] = equal
        shared[:-1] |= equal
        s, name = s[shared], name[shared]
        order = np.lexsort((name, s))
        s, name = s[order], name[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (name[1:] != name[:-1])
        s, name = s[new], name[new]
        head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        length = np.diff(np.append(head, len(s)))
        short = head[(length > 1) & (length <= SHORT)]
        pairs = [np.zeros((2, 0), _U)]
        sizes = length[(length > 1) & (length <= SHORT)]
        for i in range(SHORT - 1):
            for j in range(i + 1, SHORT):
                has = short[sizes > j]
                pairs.append(np.stack((name[has + i], name[has + j])))
        a, b = _distinct(np.concatenate(pairs, axis=1))
        yield from _rows(a, b, None)
        long = length > SHORT
        size = length[long]
        at = np.repeat(head[long] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield from _rows(name[at], np.repeat(name[head[long]], size), s[at])

    packed = mapped(docs.select(text), pack, "part int, signatures binary, names binary, which binary")
    return mapped(packed.repartitionById(parts, "part"), meet, "a bigint, b bigint, list bigint")


def _indexed(name: np.ndarray) -> tuple[bytes, bytes]:
    """Names once each, and 16-bit places in them (a chunk has fewer sets than that)."""
    names, which = np.unique(name, return_inverse=True)
    return names.tobytes(), which.astype(np.uint16).tobytes()


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(pairs)
    a, b = pairs[0][order], pairs[1][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _rows(a: np.ndarray, b: np.ndarray, name: np.ndarray | None, step: int = 1 << 16):
    for k in range(0, len(a), step):
        part = [pa.array(x[k : k + step].view(np.int64)) for x in ((a, b) if name is None else (a, b, name))]
        yield pa.RecordBatch.from_arrays(part + [pa.nulls(len(part[0]), pa.int64())] * (name is None), names=["a", "b", "list"])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of sketches (as 64-bit words) differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out."""
    side = sets.select("class", F.col("n_shingles").alias("n"), "sketch")
    joined = pairs.join(side.withColumnsRenamed({"class": "a", "n": "na", "sketch": "sa"}), "a")
    joined = joined.join(side.withColumnsRenamed({"class": "b", "n": "nb", "sketch": "sb"}), "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent

    def prune(batches):
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            sa, sb = (_matrix(col[c]) for c in ("sa", "sb"))
            total = np.asarray(col["na"]) + np.asarray(col["nb"])
            good = differing(sa, sb) <= total * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(good))

    return mapped(joined.where(fits).select("a", "b", "na", "nb", "sa", "sb"), prune, "a bigint, b bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(len(column), SKETCH_BITS // 64)


def wanted(keys: DataFrame, column: Column) -> Column:
    """A test of ``column`` that all of ``keys`` (one column) pass and most other values don't.

    A bit array of bounded size: where keys outgrow it, more rows pass, which the join that follows
    sorts out."""
    spark = keys.sparkSession
    n = keys.count()
    bits = 1 << 12
    while bits < min(FILTER_BITS, 32 * n):
        bits <<= 1
    place = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    found = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[np.asarray(found.column(0))] = np.asarray(found.column(1))
    held = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(at):
        import pandas as pd

        at = at.to_numpy()
        return pd.Series((held.value[at >> 6] >> (at & 63)) & 1 == 1)

    return test(F.pmod(F.xxhash64(column), F.lit(bits)))


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    need = written(pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct(), "wanted")
    held = _members(docs, key, text, sets, need, size)
    joined = pairs.join(held.withColumnsRenamed({"class": "a", "members": "ma"}), "a")
    joined = joined.join(held.withColumnsRenamed({"class": "b", "members": "mb"}), "b")

    def verify(batches):
        for batch in batches:
            a, b, ma, mb = (batch.column(k) for k in range(4))
            good = [_links(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(ma.to_pylist(), mb.to_pylist())]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return mapped(joined.select("a", "b", "ma", "mb"), verify, "a bigint, b bigint")


def _members(docs: DataFrame, key: str, text: str, sets: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(class, members): the whole sets of the classes in ``need``; ``sets`` has a key of each class."""
    keys = written(sets.join(need, "class").select(F.col(key).alias("k")), "keys")

    def make():
        def work(chunk):
            g, first = shingle_sets(chunk.column(chunk.schema.get_field_index(text)), size)
            return [pa.array(classes(g, first).view(np.int64), pa.int64()),
                    pa.array([g[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())]

        return work

    some = docs.select(key, text).where(wanted(keys, F.col(key)))
    held = with_columns(some, text, "class bigint, members binary", make, keep=[])
    return written(held.join(need, "class", "left_semi").dropDuplicates(["class"]), "members")


def _links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _cut(batches, by: tuple[str, ...]):
    """The partition's rows, cut between groups, some megabytes at a time."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if sum(b.num_rows for b in rest) < 8192 and sum(b.nbytes for b in rest) < BLOCK_BYTES:
            continue
        table = pa.Table.from_batches(rest).combine_chunks()
        keys = [np.asarray(table.column(c)) for c in by]
        last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        if len(last):
            yield table.slice(0, int(last[-1]) + 1)
            rest = table.slice(int(last[-1]) + 1).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _across(long: DataFrame, root: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a long list that are in different components and may link.

    Lists are cut into blocks; every two blocks of a list meet as one group of at most 2 x BLOCK
    members (hashed blocks: a little more or less), in the task that gets it."""
    member = long.select("list", F.col("a").alias("class")).join(root.withColumnRenamed("node", "class"), "class", "left")
    member = member.select("list", "class", F.coalesce("root", "class").alias("root"))
    mixed = member.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = mixed.where("lo <> hi").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    row = member.join(mixed, "list").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = row.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "root")
    row = row.join(sets.select("class", "n_shingles", "sketch"), "class")
    spread = row.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

    def compare(batches):
        for table in _cut(batches, ("list", "i", "j")):
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            keys = [np.asarray(col[c]) for c in ("list", "i", "j")]
            own, name, root, n = (np.asarray(col[c]) for c in ("own", "class", "root", "n_shingles"))
            sketch = _matrix(col["sketch"])
            new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            head = np.flatnonzero(new)
            end = np.repeat(np.append(head[1:], len(name)), np.diff(np.append(head, len(name))))
            after = end - np.arange(len(name)) - 1  # members of the group behind each one
            cuts = np.searchsorted(np.cumsum(after), np.arange(PAIRS, after.sum() + PAIRS, PAIRS))
            found = [np.zeros((2, 0), np.int64)]
            for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(name))):
                k = after[a:b]
                x = np.repeat(np.arange(a, b), k)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                total = n[x] + n[y]
                good = (root[x] != root[y]) & ((own[x] != own[y]) | (keys[1][x] == keys[2][x]))
                good &= np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                x, y, total = x[good], y[good], total[good]
                good = differing(sketch[x], sketch[y]) <= total * (100 - percent) // (100 + percent)
                x, y = name[x[good]], name[y[good]]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
            a, b = _distinct(np.concatenate(found, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return mapped(spread, compare, "a bigint, b bigint").distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (key, n_shingles, class), one per document; verified links (a, b) between classes, enough
    to connect all classes that links connect; and (node, root) for the classes that have links."""
    spark = docs.sparkSession
    sets = written(describe(docs.select(key, text), text, [key], size), "sets")
    least = F.min(key).alias(key), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    one = written(sets.where("class is not null").groupBy("class").agg(*least), "classes")
    largest = sets.agg(F.max("n_shingles")).first()[0] or 1
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(postings(docs, text, size, percent, max(1, largest), parts), "postings")
    pairs = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    check = lambda p: written(_verified(written(p, "pairs"), docs, key, text, one, size, percent), "links")
    links = check(_possible(pairs, one, percent))
    root = written(components(links), "roots")
    long = found.where("list is not null")
    if long.limit(1).count():
        more = check(_across(long, root, one, percent))
        links = links.unionAll(more)
        root = written(components(links), "roots")
    return sets.select(key, "n_shingles", "class"), links, root


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets link, as a matrix (none with itself)."""
    n = np.array([len(x) for x in sets], np.int64)
    g, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(g)
    g, owner = g[order], owner[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], np.cumsum(new[shared]) - 1
    common = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, SHARED):
        a, b = np.searchsorted(number, (k, k + SHARED))
        has = np.zeros((len(sets), int(number[b - 1]) + 1 - k), np.float32)
        has[owner[a:b], number[a:b] - k] = 1
        common += (has @ has.T).astype(np.int64)
    out = 100 * common >= percent * (n[:, None] + n - common)
    np.fill_diagonal(out, False)
    return out


def every_link(docs: DataFrame, rows: DataFrame, root: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
               percent: int = 80, pairs: bool = False) -> DataFrame:
    """(class, n_links) from the rows and roots of ``join``: how many documents a document of the class
    links to, exact copies included; or, with ``pairs``, all links (a, b) between classes, each once."""
    per = written(rows.where("class is not null").groupBy("class").agg(
        F.min(key).alias(key), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "copies")
    named = written(per.join(root.withColumnRenamed("node", "class"), "class").select("root", "class", "n", "copies"), "named")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    row = named.join(named.groupBy("root").agg(blocks.cast("int").alias("blocks")), "root")
    row = row.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    row = row.join(_members(docs, key, text, per, named.select("class"), size), "class")
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = row.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "members")
    spread = row.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def compare(batches):
        for table in _cut(batches, ("root", "i", "j")):
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            keys = [np.asarray(col[c]) for c in ("root", "i", "j")]
            own, name, copies = (np.asarray(col[c]) for c in ("own", "class", "copies"))
            head = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
            total = np.zeros(len(name), np.int64)
            for a, b in zip(head, np.append(head[1:], len(name))):
                if b - a < 2:
                    continue
                link = _linked([np.frombuffer(x.as_buffer(), _U) for x in col["members"][a:b]], percent)
                if keys[1][a] != keys[2][a]:
                    link &= own[a:b, None] != own[a:b]
                if pairs:
                    x, y = np.nonzero(link & (name[a:b, None] < name[a:b]))
                    for k in range(0, len(x), PAIRS):
                        yield pa.RecordBatch.from_arrays([pa.array(name[a + z[k : k + PAIRS]]) for z in (x, y)], names=["a", "b"])
                else:
                    total[a:b] = link @ copies[a:b]
            if not pairs:
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(total)], names=["class", "met"])

    if pairs:
        return mapped(spread, compare, "a bigint, b bigint")
    found = mapped(spread, compare, "class bigint, met bigint").groupBy("class").agg(F.sum("met").alias("met"))
    return per.join(found, "class", "left").select("class", (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``groups``, and ``n_links``: how many other documents each document links to."""
    return groups(docs, key, text, size, percent, count=True)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, count: bool = False) -> DataFrame:
    """One row per document: key, ``n_shingles`` and ``component_id``, the least key reachable."""
    rows, _, root = join(docs, key, text, size, percent)
    least = rows.where("class is not null").groupBy("class").agg(F.min(key).alias("least"))
    named = least.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(whole, "root").select("class", "component_id")
    found = [key, "n_shingles", F.coalesce("component_id", key).alias("component_id")]
    if count:
        by_class = by_class.join(every_link(docs, rows, root, key, text, size, percent), "class")
        found.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(by_class, "class", "left").select(*found)
