"""Running values over ordered events, whatever the skew.

A plain ``Window.partitionBy(case)`` puts a whole case in one task, and a case may hold a third
of all rows. Here the rows are range-partitioned by (keys, order) instead. The order columns
make rows unique, so Spark can cut anywhere, also inside one case or one busy second. Each range
is a *chunk*; window functions run per (keys, chunk) and a small table of per-chunk values
carries results over from chunk to chunk.

The table of carried values has rows only for keys that span several chunks. A chunk is shared
with its neighbours by at most two keys, so it has at most two rows per chunk: that is the bound
under which it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from coincide.session import durable

CHUNK = "chunk"


@dataclass(frozen=True)
class Running:
    """A running ``max``, ``min`` or ``sum`` of ``value``, with or without the current row."""

    how: str
    value: Column
    inclusive: bool = False

    def fold(self, value: Column) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum}[self.how](value)

    def merge(self, near: Column, far: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
        return (F.greatest if self.how == "max" else F.least)(near, far)


@dataclass(frozen=True)
class Ordered:
    """Rows with a ``chunk`` column; a key may cross chunks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def window(self, backwards: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if backwards else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*order)

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def filter(self, condition: Column) -> Ordered:
        return self.with_df(self.df.filter(condition))

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return self.with_df(self.df.withColumns(columns))

    def settled(self) -> Ordered:
        """Write the rows once, for several readers."""
        return self.with_df(durable(self.df, "settled"))

    def running(
        self,
        before: dict[str, Running] | None = None,
        after: dict[str, Running] | None = None,
    ) -> Ordered:
        """Add running values over the rows ``before`` and the rows ``after`` each row."""
        before, after = before or {}, after or {}
        columns = {}
        for marks, backwards in ((before, False), (after, True)):
            window = self.window(backwards)
            for name, mark in marks.items():
                frame = window.rowsBetween(
                    Window.unboundedPreceding, 0 if mark.inclusive else -1
                )
                columns[name] = mark.fold(mark.value).over(frame)
        carried = self._carried(before, after)
        local = self.df.withColumns(columns)
        joined = local.join(F.broadcast(carried), [*self.keys, CHUNK], "left")
        merged = joined.withColumns(
            {
                name: mark.merge(F.col(name), F.col(f"carried_{name}"))
                for name, mark in (before | after).items()
            }
        )
        return self.with_df(merged.drop(*[f"carried_{name}" for name in before | after]))

    def _carried(self, before: dict[str, Running], after: dict[str, Running]) -> DataFrame:
        per_chunk = self.df.groupBy(*self.keys, CHUNK).agg(
            *[mark.fold(mark.value).alias(name) for name, mark in (before | after).items()]
        )
        whole = Window.partitionBy(*self.keys)
        earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        later = whole.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
        return (
            per_chunk.withColumn("chunks", F.count(F.lit(1)).over(whole))
            .select(
                *self.keys,
                CHUNK,
                "chunks",
                *[m.fold(F.col(n)).over(earlier).alias(f"carried_{n}") for n, m in before.items()],
                *[m.fold(F.col(n)).over(later).alias(f"carried_{n}") for n, m in after.items()],
            )
            .filter("chunks > 1")
            .drop("chunks")
        )


def arrange(
    df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None
) -> Ordered:
    """Range-partition ``df`` by (keys, order) and fix the partition numbers in a stage table.

    ``order`` must make rows of one key unique. Without ``chunks``, adaptive execution sizes the
    chunks from the data; the table has to be written because sampling the ranges again could
    number them differently.
    """
    columns = [*keys, *order]
    ranged = (
        df.repartitionByRange(chunks, *columns) if chunks else df.repartitionByRange(*columns)
    )
    staged = durable(ranged.withColumn(CHUNK, F.spark_partition_id()), "ordered")
    return Ordered(staged, tuple(keys), tuple(order))
