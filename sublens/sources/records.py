"""Headed CSV whose quoted values may hold line breaks, read in many tasks; places that stay.

Spark's multiLine reader takes a file in one task, because only the quotes before a line end tell
whether it ends a record.  Here each split of the file is a task, in two passes:

1. Every task counts the lines of its splits and those with an odd number of quotes (`splits`): one
   row a split, whatever its size; the rows of all splits are numbered by file in one task.  Running sums over a file's splits tell each of them whether it begins inside quotes, the
   number of its first line, and in which split the record began that is open at its start.
2. Every task cuts its splits at true record ends (`cut`).  A record inside one split is whole; the
   pieces of a record that crosses splits are put together by the split in which it began.  Only
   splits with such pieces are cut again for them; a file without any isn't read a third time.

A record is placed by its file and the number of the line it begins at, which depend on neither
the splits nor the tasks, so a key made of them is the same in every action and every rerun.

Quotes inside values are doubled (RFC 4180); an odd quote in a value is malformed.  The first record
of each file is its header.  Empty records (also of spaces) are skipped, CRLF ends a record as LF does;
in a file whose first line ends with CRLF, the CRLF inside quotes are read as LF (as Spark's reader does).
A line itself is never split, so a file needs line breaks outside quotes or inside for more than one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

PIECES = "file long, began long, block long, line long, whole boolean, crlf boolean, text string"  # file: its number


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return in_place(spark.read.option("lineSep", "\n").text(path))


def in_place(lines: DataFrame) -> DataFrame:
    """Lines (batch or stream) with their file and the offset of their split in it."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch) -> Iterator[tuple[int, int, object, object]]:
    """(file, split, rows, quotes of each line) of the neighbouring rows of one split."""
    import numpy as np
    import pyarrow.compute as pc
    if not batch.num_rows:
        return
    block = batch.column("block").to_numpy(zero_copy_only=False)
    file = batch.column("number").to_numpy(zero_copy_only=False)
    quotes = pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield int(file[a]), int(block[a]), batch.slice(a, b - a), quotes[a:b]


def splits(lines: DataFrame) -> DataFrame:
    """file, block, number (of the file, in the order of the names), opens (1: it begins inside quotes),
    first_line, began (the split in which the record open at its start began), crossed (a record
    crosses its start or its end), crlf (of its file: its first line ends with a carriage return).

    A split is read by one task and in order, so the first line that the aggregate meets is its first.
    A split that begins outside quotes has a line that ends inside them if any line has an odd number."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    starts = F.when((F.col("opens") == 0) | F.col("ends_odd"), F.col("block"))  # a record that begins in it may go on after it
    return (lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(quotes % 2).alias("odd_lines"), F.first(F.endswith("value", F.lit("\r"))).alias("crlf"))
            .select("file", "block", "lines", "crlf", (F.col("odd_lines") % 2).alias("odd"), (F.col("odd_lines") > 0).alias("ends_odd"))
            .withColumns({"opens": opens.cast("int"), "first_line": F.coalesce(F.sum("lines").over(before), F.lit(0))})
            .withColumn("began", F.last(starts, ignorenulls=True).over(before))
            .select("file", "block", (F.dense_rank().over(Window.orderBy("file")) - 1).cast("long").alias("number"), "opens", "first_line", F.coalesce("began", "block").alias("began"),
                    F.first("crlf").over(Window.partitionBy("file").orderBy("block")).alias("crlf"),
                    ((F.col("opens") == 1) | ((F.col("opens") + F.col("odd")) % 2 == 1)).alias("crossed")))


def cut(batches):
    """PIECES of lines that carry their split's columns: records that lie in one split, and parts of
    those that don't."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def pieces(state, lines, whole, texts):
        n, began = len(texts), state["began"] if state["head"] else state["block"]
        return pa.RecordBatch.from_arrays([pa.array([state["file"]] * n, pa.int64()), pa.array([began] * n, pa.int64()), pa.array([state["block"]] * n, pa.int64()), pa.array(lines, pa.int64()),
                                           pa.array([whole] * n, pa.bool_()), pa.array([state["crlf"]] * n, pa.bool_()), texts], names=["file", "began", "block", "line", "whole", "crlf", "text"])

    def part(state):  # what is open at the end of a split
        return pieces(state, [state["line"]], False, pa.array(["\n".join(state["held"])], pa.string()))
    state = None
    for batch in batches:
        for file, block, rows, quotes in _runs(batch):
            if state is None or (state["file"], state["block"]) != (file, block):
                if state and state["held"]:
                    yield part(state)
                opens, first, began, crlf = (rows.column(c)[0].as_py() for c in ("opens", "first_line", "began", "crlf"))
                state = {"file": file, "block": block, "began": began, "crlf": crlf, "head": opens == 1, "quotes": opens, "held": [], "line": first, "next": first}
            values = rows.column("value")
            after = (state["quotes"] + np.cumsum(quotes)) & 1
            state["quotes"] = int(after[-1])
            ends = np.flatnonzero(after == 0)
            if len(ends):
                start = 0
                if state["held"] or state["head"]:
                    start = int(ends[0]) + 1
                    text = pa.array(["\n".join(state["held"] + values.slice(0, start).to_pylist())], pa.string())
                    yield pieces(state, [state["line"]], not state["head"], text)
                    ends, state["held"], state["head"] = ends[1:], [], False
                if len(ends):
                    offsets = np.concatenate(([start], ends + 1))
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), "\n")
                    yield pieces(state, state["next"] + offsets[:-1], True, texts)
                    start = int(offsets[-1])
                state["line"] = state["next"] + start
                state["held"] = values.slice(start).to_pylist()
            else:
                state["held"] += values.to_pylist()
            state["next"] += len(quotes)
    if state and state["held"]:
        yield part(state)


def records(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(file, line, text) of every record but headers and empty ones, from lines and their `splits`; file
    is its number, so that no task hands its name to Python with every line.

    The table of splits is broadcast: one row for each spark.sql.files.maxPartitionBytes of input."""

    def pieces(some):
        return lines.join(F.broadcast(some.drop("crossed")), ["file", "block"], "left" if some is table else "inner").withColumn(
            "opens", F.coalesce("opens", F.raise_error(F.lit("the splits of the input changed during the query")))).select(
            "value", "number", "block", "opens", "first_line", "began", "crlf").mapInArrow(cut, PIECES)
    crossing = pieces(table.where("crossed")).where("not whole").groupBy("file", "began").agg(
        F.min("line").alias("line"), F.first("crlf").alias("crlf"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts")).select(
        "file", "line", "crlf", F.concat_ws("\n", "parts.text").alias("text"))
    every = pieces(table).where("whole").select("file", "line", "crlf", "text").unionByName(crossing)
    bare = F.when(F.endswith("text", F.lit("\r")), F.substring("text", F.lit(1), F.char_length("text") - 1)).otherwise(F.col("text"))
    return every.where("line > 0").withColumn("text", bare).where(F.trim("text") != "").select(
        "file", "line", F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text")).alias("text"))


def parsed(found: DataFrame, schema: StructType, options: dict[str, str]) -> DataFrame:
    """Records as typed columns after `file` and `line`; columns go by position."""
    row = F.from_csv("text", schema.toDDL(), {**options, "multiLine": "true"})
    return found.select("file", "line", row.alias("row")).select("file", "line", "row.*")


def numbered(found: DataFrame, first: int = 0) -> DataFrame:
    """`found` with `row_id`: the number of its file (27 bits, from `first`, files in the order of their
    names) and its line (36 bits) in one long."""
    return found.withColumn("row_id", F.shiftleft(F.col("file") + first, 36).bitwiseOR(F.col("line")))


def read_records(lines: DataFrame, schema: StructType, options: dict[str, str], number_from: int | None = None) -> DataFrame:
    """The typed rows of the files behind `lines`, with a `row_id` if `number_from` is given."""
    table = splits(lines)
    rows = parsed(records(lines, table), schema, options)
    if number_from is not None:
        rows = numbered(rows, number_from)
    return rows.drop("file", "line")
