"""Rules that remember earlier *decisions*, such as "keep a row 5 s after the last kept row".

No window function can express these, because each decision depends on the ones before it. The
rows are ordered into chunks; one small fold runs per chunk and hands its end state to the next
chunk. All chunks run at once, first with the empty state, and again as long as a chunk was
given another state than its neighbour ended with. What comes out is what one long sequential
pass would give. Any quiet stretch in a chunk makes its end state independent of its start, so
two rounds are the normal case.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coincide.operators.ordered import CHUNK, Ordered
from coincide.session import durable

# fold(rows, state) -> (decisions, state); rows arrive in order.
Fold = Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]]


def relay(ordered: Ordered, fold: Fold, decision: str, state: str) -> DataFrame:
    """Run ``fold`` over all chunks. ``decision`` and ``state`` are DDL column lists."""
    spark = ordered.df.sparkSession
    sort_by = [*ordered.keys, *ordered.order]
    decision_columns = _names(spark, decision)
    state_columns = _names(spark, state)
    schema = f"chunk int, is_state boolean, d struct<{_fields(decision)}>, s struct<{_fields(state)}>"

    def run(chunk: tuple, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(sort_by, kind="stable")
        decided, kept = fold(rows, given[state_columns])
        out = pd.DataFrame(
            {
                "chunk": chunk[0],
                "is_state": [False] * len(decided) + [True] * len(kept),
                "d": decided[decision_columns].to_dict("records") + [None] * len(kept),
                "s": [None] * len(decided) + kept[state_columns].to_dict("records"),
            }
        )
        return out

    def one_round(given: DataFrame) -> DataFrame:
        pair = ordered.df.groupBy(CHUNK).cogroup(given.groupBy(CHUNK))
        done = pair.applyInPandas(run, schema)
        return durable(done, "relay")

    # One row per chunk, however many rows the chunks hold.
    following = (
        ordered.df.select(CHUNK)
        .distinct()
        .select(F.col(CHUNK), F.lead(CHUNK).over(Window.orderBy(CHUNK)).alias("next"))
    )
    given = spark.createDataFrame([], f"chunk int, {state}")
    result = one_round(given)
    while True:
        handed = durable(
            result.filter("is_state")
            .join(following, CHUNK)
            .filter("next IS NOT NULL")
            .select(F.col("next").alias(CHUNK), "s.*"),
            "relay-state",
        )
        if handed.exceptAll(given).isEmpty() and given.exceptAll(handed).isEmpty():
            break
        given, result = handed, one_round(handed)
    return result.filter("NOT is_state").select("d.*")


def _names(spark, ddl: str) -> list[str]:
    return spark.createDataFrame([], ddl).columns


def _fields(ddl: str) -> str:
    return ", ".join(
        f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", "))
    )
