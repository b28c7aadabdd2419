"""CSV with line breaks in quoted cells, read by many tasks from one file.

Whether a line break ends a record depends on all quotes before it, which is why such a file is usually read in one piece.
Here a first pass counts the quotes of every split of every file (parity is enough). A split whose file holds an odd
number of quotes before it begins inside a cell. With that known, each task puts the records of its splits together while it
reads; only the pieces of records that cross from one split to the next, at most two a split, are joined in a second job.

Files follow the usual rules: a cell that holds quotes, commas or line breaks is quoted, and quotes in it are doubled. A
record with another number of cells than the header stops the job.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from anontext.session import stored

FILE, START = "_metadata.file_path", "_metadata.file_block_start"


def read_csv_split(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All cells as text, under ``columns``, which every file's header must name in this order."""
    # Carriage returns stay, as they may stand in cells.
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col(FILE).alias("file"), F.col(START).alias("start"), "value")
    quotes = lines.groupBy("file", "start").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = quotes.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))
    inside = {(r["file"], r["start"]) for r in splits.where("inside = 1").collect()}  # a row a split
    shared = spark.sparkContext.broadcast(inside)

    def assemble(batches):
        """(file, start, kind, record): whole records, and the head and tail of those that cross splits."""
        split, held, open_, kind = None, [], False, "whole"
        for batch in batches:
            out = ([], [], [], [])

            def emit(how, text):
                for column, value in zip(out, (*split, how, text)):
                    column.append(value)

            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
                if (file, start) != split:
                    if split is not None and (held or kind == "head"):
                        emit("tail" if kind == "whole" else "middle", "\n".join(held))
                    split, held = (file, start), []
                    open_ = split in shared.value
                    kind = "head" if open_ else "whole"
                held.append(line)
                open_ ^= line.count('"') % 2 == 1
                if not open_:
                    if kind == "head" or held != [""] and held != ["\r"]:
                        emit(kind, "\n".join(held))
                    held, kind = [], "whole"
            if out[0]:
                yield _batch(out)
        if split is not None and held:
            yield _batch(([split[0]], [split[1]], ["tail" if kind == "whole" else "middle"], ["\n".join(held)]))

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                          names=["file", "start", "kind", "record"])

    pieces = stored(lines.mapInArrow(assemble, "file string, start long, kind string, record string"), "csv-records")
    # A tail opens a record that middles and a head of the next splits go on with.
    cut = pieces.where("kind <> 'whole'")
    opened = Window.partitionBy("file").orderBy("start", F.expr("CASE kind WHEN 'tail' THEN 1 ELSE 0 END")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    numbered = cut.withColumn("n", F.sum((F.col("kind") == "tail").cast("int")).over(opened))
    joined = numbered.groupBy("file", "n").agg(
        F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), "record"))).alias("parts"))
    joined = joined.select("file", "start", F.array_join(F.col("parts.record"), "\n").alias("record"))
    records = pieces.where("kind = 'whole'").select("file", "start", "record").unionByName(joined)
    # One trailing carriage return belongs to the line break, and a mark of byte order to the file.
    text = F.regexp_replace("record", "\r$|^﻿", "")
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    row = F.from_csv(text, F.lit(schema), {"escape": '"', "mode": "FAILFAST", "multiLine": "true",
                                           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    cells = records.select("file", "start", row.alias("r"))
    return _without_headers(cells, columns)


def _without_headers(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the record of each file that is its header; stop where a file has none."""
    names = F.array(*(F.lit(c) for c in columns))
    values = F.array(*(F.coalesce(F.col(f"r.c{i}"), F.lit(f"_c{i}" if c == f"_c{i}" else "")) for i, c in enumerate(columns)))
    is_header = (F.col("start") == 0) & (values == names)
    marked = cells.withColumn("header", is_header)
    files = marked.where("start = 0").groupBy("file").agg(F.max("header").alias("any"))
    if bad := files.where("NOT any").limit(1).collect():
        raise ValueError(f"{bad[0]['file']} has another header than {columns}")
    return marked.where("NOT header").select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)))
