"""SRC14 / SRC15 / SRC16 / TK08: all inputs of a case as one event table, with what went wrong."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.times import dst_edge
from coincide.operators.ordered import Running, arrange
from coincide.params import AnalysisParams, micros
from coincide.schema import conform
from coincide.session import durable, use_utc
from coincide.sources import api_json
from coincide.sources.registry import FORMATS, WEAK, catalog, detect

# Default margin of the extracted window, examples shown of doubtful readings.
MARGIN_HOURS = 2.0
DST_EXAMPLES = 5


@dataclass(frozen=True)
class Ingested:
    events: DataFrame
    files: DataFrame
    quality: DataFrame


def to_events(rows: DataFrame, files: DataFrame, case_id: Column | None = None) -> DataFrame:
    """SRC14: accepted rows as canonical events.

    ``seq`` orders rows by (file, position in the file) and breaks ties of equal instants, so the
    table need not be sorted.
    """
    ordered = arrange(files.select("path", F.lit(0).alias("all")).distinct(), ["all"], ["path"])
    numbers = ordered.running(before={"file_no": Running("sum", F.lit(1).cast("bigint"), inclusive=True)}).df.select(
        F.col("path").alias("source_file"), "file_no"
    )
    good = rows.filter("reject IS NULL").join(numbers, "source_file", "left")
    return conform(
        good.withColumns(
            {
                "case_id": F.lit("case0") if case_id is None else case_id,
                "seq": F.col("file_no") * F.lit(1 << 36) + F.col("ordinal"),
            }
        )
    )


def quality(rows: DataFrame, files: DataFrame) -> DataFrame:
    """SRC15: rows left out per file and reason, and files of weakly matched or unknown format."""
    rejected = (
        rows.filter("reject IS NOT NULL")
        .groupBy("source_file", F.col("reject").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    doubtful = files.select(
        F.col("path").alias("source_file"),
        F.when(F.col("parser").isNull(), "no format recognized")
        .when(F.col("score") < WEAK, "format matched only weakly")
        .alias("reason"),
        F.lit(1).cast("bigint").alias("n"),
    ).filter("reason IS NOT NULL")
    return rejected.unionByName(doubtful)


def notes(spark: SparkSession, rows: DataFrame, files: DataFrame, params: AnalysisParams) -> DataFrame:
    """SRC15: what was assumed while reading, per file and reason, in the columns of :func:`quality`.

    How clips got their times, the clock offset and the year that were applied, readings that daylight
    saving makes doubtful, and envelopes that are incomplete or came over an unverified connection.
    """
    good = rows.filter("reject IS NULL").join(files.select(F.col("path").alias("source_file"), "parser"), "source_file")
    by_clip = F.concat(F.lit("clip times from "), F.col("pattern")) if "pattern" in rows.columns else F.lit(None).cast("string")
    offset = f"camera clock offset of {params.camera_clock_offset_s:+.3f} s applied"
    camera = F.col("parser").isin("camera_csv", "camera_clips") if params.camera_clock_offset_s else F.lit(False)
    year = f"year {params.log_year or 'of today'} assumed where the log has none"
    edge = F.lit(None).cast("string")
    if "ts_local" in rows.columns:  # readers registered by users may give instants only
        edge = dst_edge(F.unix_micros(F.col("ts_local").cast("timestamp")), params.timezone)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("parser") == "camera_clips", by_clip),
            F.when(camera, offset),
            F.when(F.col("parser") == "opnsense", year),
            F.when(F.col("parser").isin("opnsense", "camera_csv", "camera_clips", "nzyme_csv"), F.concat(edge, F.lit(" local time"))),
        )
    )
    found = good.select("source_file", F.explode(reasons).alias("reason"))
    saved = [r.path for r in files.filter("parser = 'opnsense_api'").select("path").collect()]
    if saved:
        found = found.unionByName(api_json.envelope_warnings(api_json.read_envelopes(spark, saved)))
    return found.groupBy("source_file", "reason").agg(F.count(F.lit(1)).alias("n"))


def read_inputs(
    spark: SparkSession,
    inputs: dict[str, list[str]],
    params: AnalysisParams,
    case_id: Column | None = None,
    forced: dict[str, str] | None = None,
) -> Ingested:
    """Detect, read and unite the files below the paths given per role."""
    use_utc(spark)
    forced = forced or {}
    found = None
    for role, paths in inputs.items():
        part = detect(catalog(spark, paths), role, forced.get(role)).drop("head")
        part = part.withColumn("role", F.lit(role))
        found = part if found is None else found.unionByName(part)
    files = durable(found, "files")
    rows = None
    # The paths of each format go to its reader, as with any list of input paths.
    for parser, group in files.filter("parser IS NOT NULL").select("parser", "path").toPandas().groupby("parser"):
        part = FORMATS[parser].read(spark, sorted(group["path"]), params)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no input file has a known format")
    rows = durable(rows, "rows")
    counts = rows.filter("reject IS NULL").groupBy(F.col("source_file").alias("path")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return Ingested(
        to_events(rows, files, case_id),
        files.join(counts, "path", "left").fillna(0, ["rows"]),
        quality(rows, files).unionByName(notes(spark, rows, files, params)),
    )


def dst_report(readings: DataFrame, tz: str) -> tuple[DataFrame, DataFrame]:
    """FN12 / TK08: counts of doubtful wall-clock readings, and a few distinct examples of each.

    ``readings`` has ``wall_us``, the naive readings of a source.
    """
    flagged = readings.select("wall_us", dst_edge(F.col("wall_us"), tz).alias("edge")).filter(
        "edge IS NOT NULL"
    )
    counts = flagged.groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    examples = (
        flagged.distinct().orderBy("wall_us").limit(DST_EXAMPLES)
    )
    return counts, examples


def anchor_window(
    anchor_rows: DataFrame, margin_hours: float = MARGIN_HOURS, max_days: float | None = None
) -> tuple[int, int]:
    """SRC16: the stretch of log worth extracting around the anchors, refused beyond ``max_days``."""
    lo, hi = anchor_rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    if lo is None:
        raise ValueError("there are no anchor events to take a time window from")
    margin = micros(max(margin_hours, 0.0) * 3600)
    if max_days is not None and hi - lo + 2 * margin > micros(max_days * 86_400):
        raise ValueError(f"the anchor events span more than {max_days} days")
    return lo - margin, hi + margin


def extract_window(rows: DataFrame, since_us: int, until_us: int) -> DataFrame:
    """SRC16: rows of the window, both ends included; undated rows are kept."""
    ts = F.col("ts_us")
    return rows.filter(ts.isNull() | ts.between(since_us, until_us))
