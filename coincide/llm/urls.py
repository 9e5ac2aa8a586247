"""URL filter: rules first, then the ratio of two character models.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains, and the
longest fitting rule decides. URLs that rules accept or reject train two variable-order Markov models
over the bytes of host and path: a byte's chance under the longest kept context is blended with
shorter ones by the number of distinct continuations (Witten-Bell), down to a uniform base. A context
is kept if it has at least 1 / ``CONTEXTS`` of a model's bytes, so a model never has more than
``CONTEXTS`` contexts of each order (and at most 257 continuations of each), however many URLs there
are; that bounds what is broadcast. A URL that no rule decides is accepted if the difference of its
log-likelihoods per byte reaches a threshold calibrated on labelled URLs left out of the models.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which the models judge as
the empty string. If rules accept or reject no URL, the models can't be compared and undecided URLs
are allowed. Repeated URLs get equal verdicts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import written
from coincide.llm.text import as_bytes, mapped, mix, with_columns

ORDER, CONTEXTS = 5, 20_000
END, START, SYMBOLS = 256, 257, 257
#: One in so many labelled URLs is kept for the calibration.
CALIBRATION = 5
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, SMALL), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, and what it says; null where none fits."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, says = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    return rule, says


class Markov(NamedTuple):
    context: list[np.ndarray]  # by order: sorted context hashes
    total: list[np.ndarray]  # bytes seen after each
    kinds: list[np.ndarray]  # distinct bytes seen after each
    pair: list[np.ndarray]  # sorted hashes of context and next byte
    count: list[np.ndarray]


def contexts(column: pa.Array):
    """Symbols of all texts with their ends, the hash of the 0 to ORDER symbols before each, and the
    text of each symbol."""
    buf, off = as_bytes(column)
    size = np.diff(off) + 1
    at = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(size)), size)
    symbol = np.full(at[-1], END, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    symbol[inside] = buf
    place = np.arange(at[-1]) - at[doc]
    hashes, h = [np.zeros(len(symbol), _U)], np.zeros(len(symbol), _U)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            before = np.where(place >= k, symbol[np.maximum(np.arange(len(symbol)) - k, 0)], START)
            h = mix(h * _U(1009) + before.astype(_U) + _U(k))
            hashes.append(h)
    return symbol, hashes, doc, at


def pair_hash(h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + (symbol.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def counted(urls: DataFrame, text: str, label: str) -> DataFrame:
    """Rows (label, k, context, next, n): how often a byte follows a context of k bytes."""

    def count(batches):
        for batch in batches:
            symbol, hashes, doc, _ = contexts(batch.column(0))
            label_of = np.asarray(batch.column(1), np.int64)[doc]
            for k, h in enumerate(hashes):
                order = np.lexsort((symbol, h, label_of))
                a, b, c = label_of[order], h[order], symbol[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
                head = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[head], pa.int32()), pa.array(np.full(len(head), k), pa.int32()),
                     pa.array(b[head].view(np.int64)), pa.array(c[head], pa.int32()),
                     pa.array(np.diff(np.append(head, len(a))), pa.int64())],
                    names=["label", "k", "context", "next", "n"])

    rows = mapped(urls.select(text, F.col(label).cast("int")), count, "label int, k int, context bigint, next int, n bigint")
    return rows.groupBy("label", "k", "context", "next").agg(F.sum("n").alias("n"))


def fit(urls: DataFrame, text: str, label: str) -> list[Markov] | None:
    """Models of label 0 and label 1; None if a label has no URL."""
    counts = written(counted(urls, text, label), "contexts")
    size = {r[0]: r[1] for r in counts.where("k = 0").groupBy("label").agg(F.sum("n")).collect()}
    if len(size) < 2:
        return None
    least = F.when(F.col("label") == 0, F.lit(size[0] / CONTEXTS)).otherwise(F.lit(size[1] / CONTEXTS))
    kept = counts.groupBy("label", "k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    kept = kept.where((F.col("total") >= 2) & (F.col("total") >= least))
    found = counts.join(kept, ["label", "k", "context"]).toArrow()
    col = {c: np.asarray(found.column(c).combine_chunks()) for c in found.column_names}
    models = []
    for label_ in (0, 1):
        made = Markov([], [], [], [], [])
        for k in range(ORDER + 1):
            mine = (col["label"] == label_) & (col["k"] == k)
            h, n = col["context"][mine].view(_U), col["n"][mine]
            names, first = np.unique(h, return_index=True)
            pair = pair_hash(h, col["next"][mine].astype(np.int64))
            order = np.argsort(pair)
            for held, x in zip(made, (names, col["total"][mine][first].astype(float), col["kinds"][mine][first].astype(float),
                                      pair[order], n[order].astype(float))):
                held.append(x)
        models.append(made)
    return models


def log_likelihood(column: pa.Array, model: Markov) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of each text's chance, and its symbols (its end included)."""
    symbol, hashes, doc, at = contexts(column)
    p = np.full(len(symbol), 1.0 / SYMBOLS)
    live = np.arange(len(symbol))
    for k, h in enumerate(hashes):
        names = model.context[k]
        if not len(names) or not len(live):
            break
        place = np.minimum(np.searchsorted(names, h[live]), len(names) - 1)
        known = names[place] == h[live]
        live, place = live[known], place[known]
        pair = pair_hash(h[live], symbol[live])
        where = np.minimum(np.searchsorted(model.pair[k], pair), len(model.pair[k]) - 1)
        n = np.where(model.pair[k][where] == pair, model.count[k][where], 0.0)
        kinds, total = model.kinds[k][place], model.total[k][place]
        p[live] = (n + kinds * p[live]) / (total + kinds)
    return np.add.reduceat(np.log(p), at[:-1]) if len(symbol) else np.zeros(0), np.diff(at)


def scored(urls: DataFrame, text: str, models: list[Markov] | None, keep: list[str] | None = None) -> DataFrame:
    """Add ``score``: accepted minus rejected log-likelihood per symbol (null without models)."""
    if models is None:
        return urls.select(*(urls.columns if keep is None else keep), F.lit(None).cast("double").alias("score"))
    held = urls.sparkSession.sparkContext.broadcast([tuple(m) for m in models])

    def make():
        models = [Markov(*m) for m in held.value]

        def work(chunk):
            column = chunk.column(chunk.schema.get_field_index(text))
            (bad, size), (good, _) = (log_likelihood(column, m) for m in models)
            return [pa.array((good - bad) / size)]

        return work

    return with_columns(urls, text, "score double", make, keep)


def calibrated(scores: DataFrame, label: str, step: float = 1e-3) -> float:
    """The threshold with the best balanced accuracy on labelled scores (nearest to 0 among the best).

    Scores are counted in bins of ``step``, so what comes to the driver is bounded by their range."""
    bins = scores.where("score is not null").groupBy(F.floor(F.col("score") / step).alias("bin")).agg(
        F.sum(F.col(label).cast("int")).alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if not bins:
        return 0.0
    edge = np.array([r["bin"] for r in bins] + [bins[-1]["bin"] + 1]) * step
    good = np.array([r["good"] for r in bins], float)
    bad = np.array([r["n"] for r in bins], float) - good
    kept = np.append(np.cumsum(good[::-1])[::-1], 0) / max(good.sum(), 1)
    dropped = np.append(0, np.cumsum(bad)) / max(bad.sum(), 1)
    best = kept + dropped
    choice = np.flatnonzero(best >= best.max() - 1e-12)
    return float(edge[choice[np.argmin(np.abs(edge[choice]))]])


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict and the models' score."""
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_says", says).withColumn("_text", F.concat("host", "path"))
    known = rows.where(F.col("_says").isNotNull()).select("_text", (F.col("_says") == "allow").cast("int").alias("_good"))
    held = F.pmod(F.xxhash64(F.lit("held"), "_text"), F.lit(CALIBRATION)) == 0
    models = fit(known.where(~held), "_text", "_good")
    threshold = calibrated(scored(known.where(held), "_text", models, keep=["_good"]), "_good")
    found = scored(rows, "_text", models, keep=[key, "host", "path", "rule", "_says"])
    own = F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(key, "host", "path", "rule", F.coalesce("_says", own).alias("verdict"), "score")
