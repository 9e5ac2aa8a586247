"""One query ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.llm import contamination, jaccard, katz, language, merkle, parsing, phrases, pieces, quality, sql_merkle, substrings, tokens, toxicity, urls
from coincide.llm.sql import SQL
from coincide.llm.text import crc_part

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = SQL | {"op12_merkle": sql_merkle.SQL}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    held = crc_part("doc_id", 3) == 1
    model = language.fit(docs.where(~held))
    found = language.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "accepted")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_part("doc_id", 5) != 0))
    found = quality.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"], matches="longest")
    return found.drop("matches")


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("text")
    return tokens.histogram(tokens.lengths(docs, keep=[]))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_part("doc_id", 4) != 2))
    found = toxicity.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir).select("doc_id", "text"))


@query
def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir).select("doc_id", "text"))


#: Fixed by the query: hosts and beginnings of paths, and what they say.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.with_next(table(spark, sf_dir).select("doc_id", "text"))


@query
def op1_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_part("doc_id", 7) == 2
    return katz.score(table(spark, sf_dir).select("doc_id", "text"), ~held, held)


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select(*merkle.FIELDS)
    return merkle.manifest(docs, lambda key: F.crc32(key.cast("string")) % 5 == 0)


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir).select("text", "lang"))
