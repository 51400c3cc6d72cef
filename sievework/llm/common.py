"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that Unicode calls white space (fixed values of the standard).
WHITE = "\t-\r \x85\xa0  -     　"

#: Rows that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_helper: dict[tuple, object] = {}


def helper(make: Callable, *args: object):
    """``make(*args)``, kept by a Python worker until it asks for another one.

    Workers serve one stage after the other, so the tables of the last stage's helper are let go.
    """
    key = (make, *args)
    if key not in _helper:
        _helper.clear()
        _helper[key] = make(*args)
    return _helper[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in short record batches, so that a task never holds many texts as objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def utf8_bytes(text: str | Column) -> Column:
    """Bytes of the text in UTF-8; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def part_count(rows: int, per_part: int) -> int:
    """How many parts keep about ``per_part`` rows each."""
    return max(1, -(-rows // per_part))
