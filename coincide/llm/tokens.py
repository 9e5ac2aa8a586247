"""Token counts by an exact histogram of encoded lengths.

Every text is encoded whole by a byte-level BPE vocabulary file (a parameter; nothing is trained),
the lengths are counted, and running sums over the histogram answer, for every context limit:
documents and tokens within the limit, documents beyond it, tokens left after truncation, and
quantiles. The running sums are taken per block of ``BLOCK`` neighbouring lengths and carried from
block to block, so no task sorts the whole histogram.

Edge cases: null and empty texts have length 0 and count as documents. An empty table gives an
empty histogram. Strings of special tokens in a text are ordinary text. Equal lengths share a row.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coincide.llm.stage import written
from coincide.llm.text import once, plain, with_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before the merges of the rank file; part of the vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


def encoder(vocabulary: str):
    """The vocabulary's encoder, made once per worker process."""

    def make():
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return once(f"ranks {vocabulary}", make)


def lengths(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
            vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``n_tokens``, the length of each whole text in tokens."""

    def make():
        encode = encoder(vocabulary).encode_ordinary

        def work(chunk):
            column = plain(chunk.column(chunk.schema.get_field_index(text)))
            return [pa.array([len(encode(t)) if t else 0 for t in column.to_pylist()], pa.int64())]

        return work

    return with_columns(docs, text, "n_tokens bigint", make, keep)


def histogram(lengths_df: DataFrame) -> DataFrame:
    """One row per length ``n_tokens`` with running sums from both ends.

    docs: documents of this length; docs_within, tokens_within: documents up to this length and
    their tokens; docs_beyond: longer documents; truncated_tokens: tokens left in the whole table if
    every document is cut to this length; total_docs, total_tokens; quantile: share of documents up
    to this length.
    """
    rows = written(lengths_df.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")), "lengths")  # read twice
    rows = rows.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("docs") * F.col("n_tokens")
    up = Window.partitionBy("block").orderBy("n_tokens")
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    sums = sums.select(  # one row per block of lengths: the longest text's length / BLOCK at most
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    out = rows.join(sums, "block").select(
        "n_tokens", "docs",
        (F.col("docs_before") + F.sum("docs").over(up)).alias("docs_within"),
        (F.col("tokens_before") + F.sum(tokens).over(up)).alias("tokens_within"), "total_docs", "total_tokens")
    beyond = F.col("total_docs") - F.col("docs_within")
    return out.select(
        "n_tokens", "docs", "docs_within", "tokens_within", beyond.alias("docs_beyond"),
        (F.col("tokens_within") + beyond * F.col("n_tokens")).alias("truncated_tokens"), "total_docs", "total_tokens",
        (F.col("docs_within") / F.col("total_docs")).alias("quantile"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Documents within and tokens left at any context limits, from the histogram alone."""
    spark = table.sparkSession
    if not limits:
        return spark.createDataFrame([], "limit bigint, docs_within bigint, truncated_tokens bigint")
    parts = [
        table.agg(
            F.lit(int(n)).cast("bigint").alias("limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") <= n, F.col("docs"))), F.lit(0)).alias("docs_within"),
            F.coalesce(F.sum(F.col("docs") * F.least("n_tokens", F.lit(int(n)))), F.lit(0)).alias("truncated_tokens"))
        for n in limits
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return table.where(F.col("docs_within") >= F.col("total_docs") * share).agg(F.min("n_tokens").alias("n_tokens"))
