"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def use_utc(spark: SparkSession) -> SparkSession:
    """Every operator works on UTC instants, so the session must not shift naive timestamps."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for stage tables: spark.checkpoint.dir, else a folder in the warehouse. Both are shared
    by the driver and the executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"


#: Whether the shuffle files of a query go when it ends, and not only when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is read several times, or where it holds values (a partition number)
    that must not change when a lost task is run again. The written table also gives later
    joins a true size, so Spark decides by itself whether a side is small enough to broadcast.
    It stands for the shuffles that led to it, so their files are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    configured = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if configured is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, configured)
    return spark.read.schema(df.schema).parquet(path)


#: Rows with costly work that one task takes.
ROWS_PER_TASK = 50_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Deal rows with costly work to all cores, and to more tasks the more rows there are.

    Splits of a file may be few or uneven (a Parquet row group lies in one split), so tasks are
    numbered by rows. Counting reads only the footers of Parquet files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)))
