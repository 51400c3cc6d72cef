"""Delimited text with line breaks inside quotes, cut at any byte."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from sievework.sources import quoted, scan

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType())])


def cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def rows(n: int, seed: int = 5):
    draw = random.Random(seed)
    marks = ["a", "bc", "\n", "\r\n", '"', ";", " ", "\\n", "ü", "日本"]
    # No text is one of the tokens that stand for a missing cell.
    return [(k, "t" + "".join(draw.choices(marks, k=draw.choice([0, 3, 20, 400 if k % 50 == 7 else 5]))), k / 4) for k in range(n)]


def put(folder, name, found, end="\n"):
    body = "".join(f"{k};{cell(t)};{x}{end}" for k, t, x in found)
    (folder / name).write_bytes((f"id;text;x{end}" + body).encode())


@pytest.mark.parametrize("part_bytes", [97, 1000, 1 << 20])
def test_records_are_whole_wherever_a_file_is_cut(spark, tmp_path, part_bytes):
    found = rows(300)
    put(tmp_path, "a.csv", found[:200])
    put(tmp_path, "b.csv", found[200:], "\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(part_bytes))
    try:
        table = scan.scan_delimited(spark, str(tmp_path), SCHEMA, multi_line=True)
        got = sorted(tuple(r) for r in table.collect())
        if part_bytes == 97:
            assert quoted._ranges(quoted._lines(spark, str(tmp_path))).count() > 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == found


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("id;text;x\n")
    (tmp_path / "bom.csv").write_bytes("﻿id;text;x\n\n1;NA;bad\n2;\"\"\"q\"\"\";\n3;no end;1.5".encode())
    got = sorted(tuple(r) for r in scan.scan_delimited(spark, str(tmp_path), SCHEMA, multi_line=True).collect())
    assert got == [(1, None, None), (2, '"q"', None), (3, "no end", 1.5)]


def test_broken_files_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;text;x\n1;"open;2\n')
    with pytest.raises(ValueError, match="ends inside quotes"):
        scan.scan_delimited(spark, str(tmp_path), SCHEMA, multi_line=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text("id;other;x\n1;a;2\n")
    with pytest.raises(Exception, match="is not"):
        scan.scan_delimited(spark, str(tmp_path / "b"), SCHEMA, multi_line=True).collect()
