"""SRC09 / AGG11: recorded clips as anchor events, timed by their names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.let import once
from coincide.functions.times import clip_time, finalize
from coincide.params import AnalysisParams, micros
from coincide.session import durable
from coincide.sources.lines import uri_of

# Extensions of media files.
EXTENSIONS = (
    "mp4", "mkv", "avi", "mov", "dav", "264", "h264", "ts", "flv", "asf", "jpg", "jpeg", "png",
)
_BY_MTIME = "file modification time (NOT the recorded time - the filename carried no timestamp)"


def clip_rows(files: DataFrame, params: AnalysisParams) -> DataFrame:
    """Events of files given as (path, mtime_us)."""
    mode = params.clip_time_from
    name = F.element_at(F.split("path", "/"), -1)
    media = files.withColumn("name", name).filter(
        F.lower("name").rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")
    )
    mtime = F.struct(F.col("mtime_us").alias("wall_us"), F.lit(0).alias("offset_s"))
    timed = once(media, "by_name", clip_time(F.col("name"))).withColumn(
        "use_mtime", F.lit(mode == "mtime") | F.col("by_name").isNull()
    )
    skipped = F.lit(mode == "filename") & F.col("use_mtime")
    stamp = F.when(F.col("use_mtime"), mtime).otherwise(F.col("by_name.stamp"))
    at = finalize(
        F.when(~skipped, stamp),
        params.timezone,
        params.assume_offset,
        micros(params.camera_clock_offset_s),
    )
    origin = F.when(F.col("use_mtime"), _BY_MTIME).otherwise(
        F.concat(F.lit("filename pattern: "), "by_name.pattern")
    )
    return once(timed, "at", at).select(
        "at.*",
        F.lit("camera").alias("kind"),
        F.lit("camera").alias("category"),
        F.concat(F.lit("clip "), "name", F.lit("; time from "), origin).alias("notes"),
        F.when(skipped, None)
        .when(F.col("use_mtime"), "mtime")
        .otherwise(F.col("by_name.pattern"))
        .alias("pattern"),
        F.col("path").alias("source_file"),
        F.lit(1).cast("bigint").alias("ordinal"),
        F.col("name").alias("source_ref"),
        F.col("name").alias("raw"),
        F.lit("camera_clips").alias("source_kind"),
        F.when(skipped, "no timestamp in the file name").alias("reject"),
    )


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every file below ``paths``, empty ones too; contents are not read.

    Folders are listed on the executors, one level of all folders per pass.
    """
    schema = "path string, mtime_us bigint, length bigint, folder boolean"

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for part in parts:
            rows = []
            for path in part["path"]:
                system, inner = pafs.FileSystem.from_uri(uri_of(path))
                given = system.get_file_info(inner)
                if given.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(path)
                here = given.type == pafs.FileType.File
                head = "file:" if system.type_name == "local" else path[: path.rindex(inner)]
                for info in [given] if here else system.get_file_info(pafs.FileSelector(inner)):
                    when = info.mtime_ns // 1000 if info.mtime_ns else None
                    rows.append((head + info.path, when, info.size or 0, info.type == pafs.FileType.Directory))
            yield pd.DataFrame(rows, columns=["path", "mtime_us", "length", "folder"]).astype({"path": "object", "length": "int64", "folder": "bool"})

    found, todo = None, spark.createDataFrame([(p,) for p in paths], "path string")
    while True:
        level = durable(todo.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(listed, schema), "listing")
        files = level.filter("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        todo = level.filter("folder").select("path")
        if todo.isEmpty():
            return found


def read_clips(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    return clip_rows(list_files(spark, paths), params)


def pattern_counts(rows: DataFrame) -> DataFrame:
    """AGG11: clips per way their time was derived."""
    return rows.filter("pattern IS NOT NULL").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
