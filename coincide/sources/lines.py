"""Text files as numbered lines and records, without moving the text.

What a line means can depend on all lines before it in its file: its number, whether it begins inside a
quoted cell, which header it stands under. Each split of a file is summed up in the task that reads it,
the small table of splits says how every split begins, and the task that reads a split again goes on from
there. Text is read where it lies; only the table of splits is shuffled, and broadcast in bounded groups.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coincide.session import durable

#: Splits whose beginnings go to all tasks at once (a file with more of them is a group of its own).
MOST_SPLITS = 250_000
#: A line from its state outside (0) or inside (1) a quoted cell to that of the next line: closes, flips, keeps, opens.
QUOTES = np.array([[0, 0], [1, 0], [0, 1], [1, 1]])


def uri_of(path: str) -> str:
    """Spark writes local files as ``file:/x``; Arrow wants ``file:///x``."""
    return "file://" + path[5:] if path.startswith("file:/") and path[6:7] != "/" else path


#: Two scans of files see the same splits as long as no file and no setting changes between them.
CHANGED = "the splits of {} changed between two scans; run the query again"


def _groups(raw: DataFrame, n: int) -> list[DataFrame]:
    """Rows of files, each file in one of ``n`` groups."""
    return [raw.filter(F.pmod(F.xxhash64("path"), F.lit(n)) == k) for k in range(n)] if n > 1 else [raw]


def number_rows(raw: DataFrame, name: str) -> DataFrame:
    """Replace ``block`` and ``row_id`` by the 1-based row number within the file.

    Rows of one file block are consecutive in one read task, so a row's number is its distance
    from the first row id of its block plus the rows in earlier blocks. Only one small row per
    block is shuffled, never the text.
    """
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        raw.groupBy("path", "block")
        .agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    blocks = durable(blocks, "splits")
    n = max(1, -(-blocks.count() // MOST_SPLITS))
    parts = [some.join(F.broadcast(few), ["path", "block"], "left") for some, few in zip(_groups(raw, n), _groups(blocks, n))]
    number = F.when(F.col("first_id").isNull(), F.raise_error(F.lit(CHANGED.format("a file"))).cast("bigint")).otherwise(
        F.col("row_id") - F.col("first_id") + F.col("skipped") + 1
    )
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn(name, number)
        .drop("block", "row_id", "first_id", "skipped")
    )


def _runs(batches):
    """What each Arrow batch holds of each split, as ((path, block), rows)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("path", "block")]
        new[1:] = np.logical_or(*[pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
        first = np.append(np.flatnonzero(new), n)
        for a, b in zip(first, first[1:]):
            yield tuple(c[int(a)].as_py() for c in columns), batch.slice(a, b - a)


def _through(rows: pa.RecordBatch, maps: np.ndarray) -> np.ndarray:
    """After each row, the state that every state before the first row has led to."""
    out, reach = maps[np.asarray(rows.column(rows.schema.get_field_index("step")))], 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], 1)
        reach *= 2
    return out


def with_states(raw: DataFrame, step: Column, maps: np.ndarray, chunks: int | None = None) -> tuple[DataFrame, int]:
    """Lines with ``state`` before and ``left`` after each, ``line_no``, and ``row_no``: the lines up to it that begin
    in state 0, where files begin. Also how many lines do not begin and end there.

    ``step`` numbers the row of ``maps`` that takes a line's state to the next line's. Maps can be joined
    end to end, so a split is summed up for every state it might begin with. The splits' beginnings are
    broadcast, beyond ``MOST_SPLITS`` of them (or with ``chunks``) for one group of files after another.
    """
    if chunks is not None and chunks > 1:
        parts = [with_states(some, step, maps, 1) for some in _groups(raw, chunks)]
        return reduce(DataFrame.unionByName, [lines for lines, _ in parts]), sum(mixed for _, mixed in parts)
    lines = raw.withColumn("step", step.cast("int"))
    states = maps.shape[1]

    def summed_up(batches):
        found, at = [], None
        for split, rows in _runs(batches):
            if split != at:
                at = split
                found.append([*split, 0, np.arange(states), np.zeros(states, np.int64), np.zeros(states, np.int64)])
            sums = found[-1]
            left = _through(rows, maps)[:, sums[3]]
            state = np.vstack([sums[3], left[:-1]])
            sums[2:] = [sums[2] + len(left), left[-1], sums[4] + (state == 0).sum(0), sums[5] + ((state != 0) | (left != 0)).sum(0)]
        names = ["path", "block", "lines", "to", "begun", "mixed"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        columns = zip(*found) if found else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array([getattr(x, "tolist", lambda: x)() for x in c], k) for c, k in zip(columns, kinds)], names=names)

    def begins(splits: pd.DataFrame) -> pd.DataFrame:
        out, state, line, row = [], 0, 0, 0
        for s in splits.sort_values("block").itertuples(index=False):
            out.append((s.path, s.block, s.lines, state, line, row, s.mixed[state]))
            line, row, state = line + s.lines, row + s.begun[state], s.to[state]
        return pd.DataFrame(out, columns=["path", "block", "lines", "from_state", "lines_before", "rows_before", "mixed"])

    sums = "path string, block bigint, lines bigint, to array<bigint>, begun array<bigint>, mixed array<bigint>"
    splits = lines.select("path", "block", "step").mapInArrow(summed_up, sums)
    splits = durable(splits, "sums").withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("path")))
    zero = F.lit(0).cast("bigint")
    alone = splits.filter("of = 1").select(
        "path", "block", "lines", zero.alias("from_state"), zero.alias("lines_before"), zero.alias("rows_before"), F.get("mixed", F.lit(0)).alias("mixed")
    )
    several = splits.filter("of > 1").groupBy("path").applyInPandas(begins, alone.schema)
    known = durable(alone.unionByName(several), "splits")
    n, mixed = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("mixed"), zero)).first()
    if chunks is None and n > MOST_SPLITS:
        return with_states(raw, step, maps, -(-n // MOST_SPLITS))

    added = ["state", "left", "line_no", "row_no"]
    stay = [f for f in lines.schema.fields if f.name != "step"]

    def numbered(batches):
        at, line, due = None, 0, 0
        for split, rows in _runs(batches):
            if split != at:
                if line != due:
                    raise RuntimeError(CHANGED.format(at))
                at = split
                entry = ("from_state", "lines_before", "rows_before", "lines")
                state, line, row, due = (rows.column(rows.schema.get_field_index(c))[0].as_py() for c in entry)
                if due is None:
                    raise RuntimeError(CHANGED.format(at))
                due += line
            left = _through(rows, maps)[:, state]
            before = np.concatenate(([state], left[:-1]))
            new = [before, left, line + np.arange(1, len(left) + 1), row + np.cumsum(before == 0)]
            state, line, row = int(left[-1]), int(new[2][-1]), int(new[3][-1])
            held = [rows.column(rows.schema.get_field_index(f.name)) for f in stay]
            yield pa.RecordBatch.from_arrays(held + [pa.array(x, pa.int64()) for x in new], names=[f.name for f in stay] + added)
        if line != due:
            raise RuntimeError(CHANGED.format(at))

    schema = T.StructType(stay + [T.StructField(c, T.LongType()) for c in added])
    begun = lines.join(F.broadcast(known.drop("mixed")), ["path", "block"], "left")
    return begun.mapInArrow(numbered, schema), mixed


def file_columns() -> list[Column]:
    """Path, time and position of a row in the files being read."""
    return [
        F.col("_metadata.file_path").alias("path"),
        F.unix_micros("_metadata.file_modification_time").alias("mtime_us"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
    ]


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime_us, line, line_no) of text files, which stay splittable."""
    raw = spark.read.text(paths).select(
        *file_columns(), F.make_valid_utf8("value").alias("line")
    )
    return number_rows(raw, "line_no")


def lines_in_place(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime_us, block, line) of text files, in order within each split."""
    return spark.read.text(paths).select(*file_columns()[:3], F.make_valid_utf8("value").alias("line"))


def nonblank(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("line") != "")


def _open_at_end(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted cell."""
    d = _escaped(delimiter)
    closed = f'"[^"]*+(?:""[^"]*+)*+"(?!")[^{d}]*+'
    return line.rlike(f'(?s)^(?:(?:{closed}|[^"{d}][^{d}]*+|){d})*+"[^"]*+(?:""[^"]*+)*+$')


def _escaped(delimiter: str) -> str:
    return "\\t" if delimiter == "\t" else delimiter


def cells_of(record: Column, delimiter: str = ",") -> Column:
    """The cells of one delimited record, however many, blank ones as empty strings.

    Doubled quotes stand for one; text after a closing quote belongs to the cell.
    """
    d = _escaped(delimiter)
    quoted = '"[^"]*+(?:""[^"]*+)*+"(?!")'
    whole = F.concat(record, F.when(_open_at_end(record, delimiter), '"').otherwise(""), F.lit(delimiter))
    cells = F.regexp_extract_all(whole, F.lit(f"(?s)({quoted}[^{d}]*+|[^{d}]*+){d}"), F.lit(1))
    inner = f"(?s)^({quoted})(.*)$"

    def plain(cell: Column) -> Column:
        held = F.regexp_extract(cell, inner, 1)
        text = F.replace(held.substr(F.lit(2), F.length(held) - 2), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"'), F.concat(text, F.regexp_extract(cell, inner, 2))).otherwise(cell)

    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(cells, plain))


def records_of(raw: DataFrame, delimiter: str = ",", chunks: int | None = None) -> DataFrame:
    """(path, mtime_us, row_no, fields) of :func:`lines_in_place`; a quoted cell may hold line breaks.

    A line maps "outside quotes" and "inside quotes" at its begin to one of both at its end.
    """
    outside, inside = _open_at_end(F.col("line"), delimiter), _open_at_end(F.concat(F.lit('"'), "line"), delimiter)
    lines, spread_lines = with_states(raw, outside.cast("int") + 2 * inside.cast("int"), QUOTES, chunks)
    records = lines.filter("state = 0 AND left = 0").select("path", "mtime_us", "row_no", F.col("line").alias("record"))
    if spread_lines:
        # Only the lines of records that hold line breaks are gathered, one group per record.
        spread = (
            lines.filter("state != 0 OR left != 0")
            .groupBy("path", "row_no")
            .agg(F.first("mtime_us").alias("mtime_us"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
            .select("path", "mtime_us", "row_no", F.array_join("parts.line", "\n").alias("record"))
        )
        records = records.unionByName(spread)
    record = F.when(F.col("row_no") == 1, F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return records.select("path", "mtime_us", "row_no", cells_of(record, delimiter).alias("fields"))
