"""SRC05: log rows saved from a firewall's API, in a JSON envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.functions.let import let, once
from coincide.functions.times import EPOCH, finalize, parse_epoch, parse_isoish
from coincide.params import AnalysisParams
from coincide.sources.syslog import EVENT_COLUMNS, with_message_events

# Field names, first present one wins.
TIME_FIELDS = ("timestamp", "@timestamp", "time", "date")
MESSAGE_FIELDS = ("line", "message", "msg", "text")
PROCESS_FIELDS = ("process_name", "process", "program", "app_name", "processName")

_ROW = ", ".join(f"`{f}`: string" for f in (*TIME_FIELDS, *MESSAGE_FIELDS, *PROCESS_FIELDS))
ENVELOPE = (
    f"rows array<struct<{_ROW}>>, request struct<label: string, scope: string>, "
    "complete boolean, firewall struct<tls: string>"
)


def _stamp(text: Column) -> Column:
    """Epoch seconds or ISO; a reading without an offset is UTC."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(
        F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    )
    iso = let(
        parse_isoish(full),
        lambda s: F.when(
            s.isNotNull(),
            F.struct(
                s["wall_us"].alias("wall_us"),
                F.coalesce(s["offset_s"], F.lit(0)).alias("offset_s"),
            ),
        ),
    )
    return F.when(text.rlike(EPOCH), parse_epoch(text)).otherwise(iso)


def _first(fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.col("row")[f], F.lit("")) for f in fields])


def api_rows(envelopes: DataFrame, params: AnalysisParams) -> DataFrame:
    """Events of envelopes given as (path, + ENVELOPE columns)."""
    label = F.coalesce("request.label", "request.scope", F.lit("firewall log"))
    rows = envelopes.select(
        F.col("path").alias("source_file"),
        label.alias("label"),
        F.posexplode("rows").alias("at_row", "row"),
    )
    stamp = F.coalesce(*[_stamp(F.trim(F.col("row")[f])) for f in TIME_FIELDS])
    message = _first(MESSAGE_FIELDS)
    head = F.trim(F.substring_index(F.col("message"), ":", 1))
    folded = (
        F.col("message").contains(":")
        & (F.instr("message", ":") <= 65)
        & ~head.contains(" ")
        & F.col("process").isNull()
    )
    bracket = F.instr(head, "[")
    name = F.when(bracket > 1, head.substr(F.lit(1), bracket - 1)).otherwise(head)
    tail = F.trim(F.col("message").substr(F.instr("message", ":") + 1, F.length("message")))
    split = (
        rows.select(
            "source_file",
            "label",
            (F.col("at_row") + 1).cast("bigint").alias("ordinal"),
            stamp.alias("stamp"),
            message.alias("message"),
            _first(PROCESS_FIELDS).alias("process"),
        )
        .withColumns(
            {
                "proc": F.when(folded, name).otherwise(F.coalesce("process", F.lit(""))),
                "msg": F.when(folded, tail).otherwise(F.col("message")),
            }
        )
    )
    dated = once(split, "at", finalize(F.col("stamp"), params.timezone)).withColumn(
        "msg", F.when(F.col("at").isNotNull(), F.col("msg"))
    )
    shown = F.when(F.col("proc") != "", F.concat("proc", F.lit(": "), "msg")).otherwise(F.col("msg"))
    return (
        with_message_events(dated)
        .filter(F.col("at").isNull() | F.col("kind").isNotNull())
        .select(
            "at.*",
            "category",
            *EVENT_COLUMNS,
            "source_file",
            "ordinal",
            F.concat("label", F.lit(" row "), F.col("ordinal").cast("string")).alias("source_ref"),
            shown.alias("raw"),
            F.when(F.col("at").isNull(), "no readable timestamp").alias("reject"),
            F.lit("opnsense_api").alias("source_kind"),
        )
    )


def envelope_warnings(envelopes: DataFrame) -> DataFrame:
    """SRC15: envelopes that are incomplete or came over an unverified connection."""
    warning = F.array_compact(
        F.array(
            F.when(F.col("complete") == F.lit(False), "incomplete fetch"),
            F.when(F.col("firewall.tls").startswith("UNVERIFIED"), "unverified connection"),
        )
    )
    return envelopes.select(F.col("path").alias("source_file"), F.explode(warning).alias("reason"))


def read_envelopes(spark: SparkSession, paths: list[str]) -> DataFrame:
    # One envelope is one JSON document, so one file is one task; many files spread.
    return (
        spark.read.schema(ENVELOPE)
        .option("multiLine", True)
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )


def read_api(spark: SparkSession, paths: list[str], params: AnalysisParams) -> DataFrame:
    return api_rows(read_envelopes(spark, paths), params)
