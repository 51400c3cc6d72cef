"""Modes and unique counts of text, long values and ties included, against counting in memory."""

from __future__ import annotations

from collections import Counter

from sievework.operators import profile


def test_long_and_short_texts_and_ties(spark):
    long = "z" * 500
    columns = {
        "short": ["b", "a", "b", "a", None, "c"],
        "long": [long + "b", long + "a", long + "b", long + "a", None, "q"],
        "both": ["~", "~", long, long, "x", None],
        "unique": [long + str(i) for i in range(5)] + ["~~"],
        "accents": ["é" * 20, "é" * 20, "z", "z", "", ""],
        "empty": [None] * 6,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns)).repartition(4)
    found = {r["column_name"]: tuple(r)[1:] for r in profile.text_description(df, list(columns)).collect()}
    assert "empty" not in found
    for c, values in columns.items():
        counts = Counter(v for v in values if v is not None)
        if counts:
            top = min(counts, key=lambda v: (-counts[v], v.encode()))
            assert found[c] == (sum(counts.values()), len(counts), top, counts[top]), c


def test_no_text_is_shuffled(spark):
    """The counts that are shuffled are keyed by digests, whatever the length of a text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = profile._keyed_counts(docs, ["text", "lang"])
    longest = max(len(r["key"].encode()) for r in counts.select("key").collect())
    assert longest <= profile.SHORT_BYTES + 1
    assert profile.text_description(docs.limit(0), ["text"]).count() == 0
