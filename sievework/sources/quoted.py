"""Records of delimited text with line breaks inside quotes, a file shared by many tasks.

Whether a line break ends a record depends on all quotes before it. Quotes are counted per byte range of
the file first; the running total over the ranges, a row each, tells whether a range begins inside quotes.
Knowing that, every range is cut into records on its own. Only the pieces of records that lie in more than one
range, two a range at most, are put together by a shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.session import materialize

WHOLE, BEGIN, MIDDLE, END = "whole", "begin", "middle", "end"
#: Ranges that begin or end inside quotes are sent to all tasks up to this number, 24 bytes each.
_BROADCAST_RANGES = 2_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and byte range; a task reads the lines of a range in their order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_path").alias("name"),
        F.col("_metadata.file_block_start").alias("at"),
        F.col("value").alias("line"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: is its begin, is its end inside quotes, and where the file's text begins."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "at").agg(F.sum(quotes).alias("n"), F.first("name").alias("name"))
    upto = Window.partitionBy("file").orderBy("at")
    total = F.sum("n").over(upto)
    return counted.select(
        "file", "name", "at", ((total - F.col("n")) % 2 == 1).alias("begins"), (total % 2 == 1).alias("ends"),
        (F.row_number().over(upto) == 1).alias("first"), F.lead("at").over(upto).isNull().alias("last"),
    )


def _cut(wanted: Sequence[str], names: Sequence[str], sep: str):
    """Task: lines with ``begins`` and ``first`` to the pieces wanted, as (file, at, part, record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, part, header, held = None, False, BEGIN, False, []
        found: list[tuple[int, int, str, str]] = []

        def give(part: str) -> None:
            nonlocal header
            record = "\n".join(held)
            held.clear()
            if part in (WHOLE, END):
                record = record.removesuffix("\r")
            if header and part in (WHOLE, BEGIN):
                header = False
                if part == WHOLE:
                    record = record.removeprefix("﻿")
                    have = next(csv.reader([record], delimiter=sep), [])
                    if have != list(names):
                        raise ValueError(f"header {have} is not {list(names)}")
                    return
                raise ValueError("the header of a file goes on beyond its first byte range")
            if part in wanted and (record or part != WHOLE):
                found.append((*place, part, record))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for file, at, begins, first, line in zip(*columns, strict=True):
                if (file, at) != place:
                    if held:
                        give(BEGIN if part == WHOLE else MIDDLE)
                    # Until a record ends the lines of a range that begins inside quotes end an earlier one.
                    place, inside, header = (file, at), begins, first
                    part = END if begins else WHOLE
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    give(part)
                    part = WHOLE
            yield _batch(found)
            found = []
        if held:
            give(BEGIN if part == WHOLE else MIDDLE)
        yield _batch(found)

    return run


def _batch(found: list[tuple]) -> pa.RecordBatch:
    file, at, part, record = zip(*found, strict=True) if found else ((),) * 4
    arrays = [pa.array(file, pa.int64()), pa.array(at, pa.int64()), pa.array(part, pa.string()), pa.array(record, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["file", "at", "part", "record"])


def records(spark: SparkSession, path: str, names: Sequence[str], sep: str) -> DataFrame:
    """One row ``record`` for each record below ``path``, without headers and empty lines.

    A quote inside a field must be doubled and its field quoted, as writers of such text do. A file that ends
    inside quotes and a header unlike ``names`` raise. Line breaks inside quotes are kept as they are; a
    carriage return before the break that ends a record goes with it. An empty file has no records.
    """
    lines = _lines(spark, path)
    ranges = materialize(_ranges(lines), "quoted-ranges")
    broken = ranges.where("last AND ends").select("name").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['name']} ends inside quotes")
    told = ranges.where("begins OR ends OR first").select("file", "at", "begins", "ends", "first")
    # The join must keep the order of lines, so the small table goes to the tasks; its size is checked.
    if told.count() > _BROADCAST_RANGES:
        raise ValueError("too many byte ranges; use a larger spark.sql.files.maxPartitionBytes")

    def placed(how: str) -> DataFrame:
        found = lines.join(F.broadcast(told if how == "left" else told.where("begins OR ends")), ["file", "at"], how)
        no = F.lit(False)
        return found.select("file", "at", F.coalesce("begins", no).alias("begins"), F.coalesce("first", no).alias("first"), "line")

    kind = "file long, at long, part string, record string"
    whole = placed("left").mapInArrow(_cut([WHOLE], names, sep), kind).select("record")
    pieces = materialize(placed("inner").mapInArrow(_cut([BEGIN, MIDDLE, END], names, sep), kind), "quoted-pieces")
    # A range has an end piece before its begin piece. Numbering the records moves no text.
    second = F.when(F.col("part") == BEGIN, 1).otherwise(0)
    upto = Window.partitionBy("file").orderBy("at", second)
    numbered = pieces.select("file", "at", "part").withColumn("number", F.count_if(F.col("part") == BEGIN).over(upto))
    joined = pieces.join(numbered, ["file", "at", "part"]).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("at", second.alias("second"), "record"))).alias("parts")
    )
    crossing = joined.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(crossing)
