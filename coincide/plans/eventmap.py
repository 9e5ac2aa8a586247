"""Read the ``events`` table as canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coincide.schema import BROADCAST, categorize, conform
from coincide.session import use_utc


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def prop_k(props: str = "props") -> Column:
    """The integer property ``k``."""
    return F.get_json_object(props, "$.k").cast("int")


def client_mac(user: str = "user_id") -> Column:
    """An address per user: all 40 bits behind a fixed first byte."""
    digits = F.lpad(F.lower(F.hex(user)), 10, "0")
    return F.concat_ws(":", F.lit("3c"), *[digits.substr(i, 2) for i in range(1, 11, 2)])


def canonical(
    raw: DataFrame, cases: int | None = 1, view_resets: bool = False, types: tuple[str, ...] = ()
) -> DataFrame:
    """Map the driver's event types: purchases are anchors, errors are frames.

    ``cases`` is the number of cases users are dealt to; with None every user is one.
    ``types`` names the event types an operator looks at, so that the scan skips the others.

    Views count as link resets only where they are asked for; otherwise they are context, which
    keeps the chance baseline low.
    """
    if types:
        raw = raw.filter(F.col("event_type").isin(*types))
    case = f"concat('case', user_id % {cases})" if cases else "concat('case', user_id)"
    case = "'case0'" if cases == 1 else case
    spelled = raw.withColumn("mac", client_mac()).selectExpr(
        f"{case} AS case_id",
        "mac",
        "event_id AS seq",
        "CAST(ts AS TIMESTAMP) AS ts_utc",
        "ts AS ts_local",
        "event_type",
        "user_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )
    view = "link_reset" if view_resets else "context"
    mapped = spelled.selectExpr(
        "case_id",
        "seq",
        "unix_micros(ts_utc) AS ts_us",
        "ts_utc",
        "ts_local",
        "'+00:00' AS utc_offset",
        f"""CASE event_type WHEN 'purchase' THEN 'camera' WHEN 'view' THEN '{view}'
            WHEN 'error' THEN if(k % 2 = 0, 'deauth', 'disassoc') ELSE 'assoc' END AS kind""",
        "CASE event_type WHEN 'signup' THEN 'DISCOVER' WHEN 'click' THEN 'ACK' END AS subtype",
        """CASE WHEN event_type = 'error'
            THEN concat('aa:bb:cc:00:00:', lpad(lower(hex(user_id % 16)), 2, '0')) END AS src_mac""",
        "mac",
        "event_type = 'error' AS error",
        "k",
        "CASE WHEN event_type = 'error' THEN k % 10 END AS reason_code",
        "CASE WHEN event_type = 'purchase' THEN concat('src', k % 3) END AS source_file",
        "CASE WHEN event_type = 'purchase' AND k % 2 = 0 THEN concat('P', user_id) END AS plate",
        "'events' AS source_kind",
    )
    addressed = mapped.selectExpr(
        "* EXCEPT (mac, error, k)",
        f"CASE WHEN error THEN if(k % 3 = 0, '{BROADCAST}', mac) END AS dst_mac",
        "CASE WHEN NOT (error AND k % 3 = 0) THEN mac END AS client_mac",
    )
    return conform(addressed.withColumn("category", categorize(F.col("kind"))))
