"""Sharding against plain best-fit decreasing."""

from __future__ import annotations

import zlib

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from sievework.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def plain_best_fit(sizes, capacity):
    bins, placed = [], []
    for size in sorted(sizes, reverse=True):
        room = [(capacity - load, b) for b, load in enumerate(bins) if capacity - load >= size]
        if room:
            b = min(room)[1]
        else:
            b = len(bins)
            bins.append(0)
        bins[b] += size
        placed.append((size, b))
    return bins, sorted(placed)


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 90))
def test_runs_are_best_fit_decreasing_one_by_one(sizes, capacity):
    histogram = {s: sizes.count(s) for s in sizes}
    runs, loads = sharding.pack(histogram, capacity)
    bins, placed = plain_best_fit(sizes, capacity)
    assert loads == bins
    assert sorted((s, b) for s, own in runs.items() for b, n in own for _ in range(n)) == placed


def test_oversized_groups_get_a_shard_each_and_the_rest_is_even():
    runs = sharding.pack_evenly({10_000: 1, 9_000: 1, 7: 400}, 6)
    loads = dict.fromkeys(range(6), 0)
    for size, own in runs.items():
        for b, n in own:
            loads[b] += size * n
    assert sorted(loads.values())[-2:] == [9_000, 10_000]
    rest = sorted(loads.values())[:-2]
    assert sum(rest) == 2_800 and rest[-1] - rest[0] <= 7
    with pytest.raises(ValueError):
        sharding.shard(None)


@given(st.integers(1, 1 << 62))
def test_rounding_is_at_most_a_share_of_the_size(size):
    spare = max(size.bit_length() - sharding.SIZE_BITS, 0)
    up = -(-size // (1 << spare)) * (1 << spare)
    assert size <= up and (up - size) * 8192 <= size


def check(found: pd.DataFrame, shards: int):
    assert found["shard"].between(0, shards - 1).all()
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_rounded_size_in_spark(spark):
    sizes = [1, 9, 16383, 16384, 16385, 32769, 10**6 + 1, 10**12 + 7, (1 << 40) + 1]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long")
    rows = rows.select("s", sharding.rounded_size(F.col("s")).alias("r"))
    for s, r in rows.collect():
        spare = max(s.bit_length() - sharding.SIZE_BITS, 0)
        assert r == -(-s // (1 << spare)) * (1 << spare)


def test_odd_rows(odd_docs, no_docs):
    found = sharding.shard(odd_docs, shards=4).toPandas()
    assert len(found) == len(ODD_TEXTS)
    check(found, 4)
    same = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in ODD_TEXTS}
    got = {(None if pd.isna(i) else int(i), c, s) for i, c, s in zip(found.doc_id, found.text_crc32, found["size"])}
    assert got == same
    plain = found[found.text_crc32 == zlib.crc32(ODD_TEXTS[3][1].encode())]
    assert len(plain) == 3 and plain["shard"].nunique() == 1
    assert sharding.shard(no_docs, shards=4).count() == 0
    assert sharding.shard(odd_docs, capacity=10_000).toPandas()["shard"].nunique() >= 3


def test_query(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    found = queries.op1_sharding(spark, SF).toPandas()
    assert sorted(found.doc_id) == sorted(docs)
    check(found, 24)
    loads = found.groupby("shard")["size"].sum()
    assert len(loads) == 24 and loads.max() - loads.min() < 0.05 * loads.mean() + 20_000
    assert found.assign(t=found.doc_id.map(docs)).groupby("t")["shard"].nunique().max() == 1
    assert set(found.law) == {"bytes"} and found.grown_shard.isna().all()


def test_numbering_is_gapless_over_parts(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS k", "id % 10 AS tie")
    found = sharding.Numbering(("k",), ("tie",)).add(rows, "n", 7).toPandas()
    for _, own in found.groupby("k"):
        assert sorted(own["n"]) == list(range(len(own)))
