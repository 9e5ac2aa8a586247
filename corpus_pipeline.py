"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.llm import contamination, jaccard, language, pieces, quality
from coincide.llm.stage import folder, written
from coincide.llm.text import crc_part


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or with a narrow margin go."""
    model = language.fit(docs.where(crc_part("doc_id", 3) != 1))
    return language.predict(_whole(docs), model).where("accepted").select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1, learned from labelled documents of this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(crc_part("doc_id", 5) != 0))
    return quality.predict(_whole(docs), model).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the least id. A text that occurs
    twice under one id stays once; rows without an id stay."""
    found = written(jaccard.groups(docs), "groups")
    mine = F.max((F.col("component_id") == F.col("doc_id")).cast("int"))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(mine.alias("mine"), F.count(F.lit(1)).alias("n"))
    doubtful = written(ids.where("mine = 0 or n > 1").select("doc_id", "mine"), "doubtful")
    maybe = jaccard.wanted(doubtful.select("doc_id"), F.col("doc_id"))
    gone = doubtful.where("mine = 0").select("doc_id")
    some = docs.where(maybe).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.where(~maybe).unionByName(some.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contamination(_whole(docs), benchmark, matches=None).where("not contaminated").select("_row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its sampled pieces."""
    return pieces.encode(docs)


def _whole(docs: DataFrame) -> DataFrame:
    """The text, and each row as it came, so that no column of it clashes with an operator's."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: SQL can't express the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
