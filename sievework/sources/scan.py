"""Scans: delimited text with declared schema, stage tables, and scans of optional tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import scalars as S
from sievework.sources import quoted

# File beside delimited text whose line breaks are backslash escapes; readers of the data skip such names.
ESCAPED_MARK = "_escaped_breaks"

# Text cells a tabular reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def scan_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ";",
    missing: Sequence[str] = MISSING_TOKENS,
    escaped_breaks: bool | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text with a header; listed tokens are missing, bad numbers become NULL.

    Every field is read as text first, so that a bad number is a missing cell and not a
    missing row, then cast to the declared type. Spaces around a value are kept. Backslashes stand for
    themselves, unless the folder says that ``write_delimited`` escaped line breaks or ``escaped_breaks``
    asks for it. For foreign files with breaks inside quotes ask for ``multi_line``; such a file is read by
    as many tasks as any other (see ``quoted.records``).
    """
    if escaped_breaks is None:
        mark = spark._jvm.org.apache.hadoop.fs.Path(path, ESCAPED_MARK)
        escaped_breaks = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    raw = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    options = {"sep": sep, "quote": '"', "escape": '"'}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if multi_line:
        found = quoted.records(spark, path, schema.names, sep)
        cells = F.from_csv("record", F.lit(raw.simpleString()), options | {"multiLine": "true"})
        rows = found.select(cells.alias("cells")).select("cells.*")
    else:
        rows = spark.read.schema(raw).options(header=True, enforceSchema=False, **options).csv(path)
    columns = []
    for f in schema.fields:
        text = F.when(~F.col(f.name).isin(list(missing)), F.col(f.name))
        is_text = isinstance(f.dataType, T.StringType)
        if is_text and escaped_breaks:
            text = S.unescape_breaks(text)
        columns.append((text if is_text else text.try_cast(f.dataType)).alias(f.name))
    return rows.select(*columns)


def scan_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read back a parquet stage; a declared schema skips the footer inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_optional(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame | None:
    """The table, or None when the path does not exist."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_optional_or_empty(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """The table, or no rows of the same schema when the path does not exist."""
    found = scan_optional(spark, path, schema, fmt)
    return spark.createDataFrame([], schema) if found is None else found
