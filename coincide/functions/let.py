"""Small expression helpers: name a value once, compute a column once, divide exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used n times in a nested expression is copied n times into the plan; text parsing
    nests deep enough for that to matter.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def floor_div(value: Column, by: Column | int) -> Column:
    """Integer quotient rounded down, exact for any 64-bit value."""
    by = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.call_function("div", value - F.pmod(value, by), by)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters further up do not compute again.

    Spark pushes a filter on a computed column below the projection, copying the computation into
    the filter. It does not push filters below a generator, so the value is passed through one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
