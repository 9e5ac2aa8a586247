"""Stage tables in the shared folder, and bounded samples of labelled rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, else one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages").rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither repeat the work
    nor depend on files of executors that may be lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    schema = df.schema
    if by:
        schema = T.StructType([f for f in schema if f.name != by] + [schema[by]])
    return df.sparkSession.read.schema(schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, label: str, per_label: int, seed: int = 0) -> DataFrame:
    """At most ``per_label`` rows of each label, those whose hashed key is lowest.

    Labels are taken to be few (their counts come to the driver). Rows are first thinned by hash to
    about four times the bound, so the ranking sorts that many rows, however large the table.
    """
    df = df.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not sizes:
        return df.limit(0)
    rates = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (4.0 * per_label + 40) / n))])
    draw = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    thin = df.withColumn("_draw", draw).where(F.pmod("_draw", F.lit(1 << 20)) / (1 << 20) < rates[F.col(label)])
    order = Window.partitionBy(label).orderBy("_draw", key)
    return thin.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= per_label).drop("_at", "_draw")
