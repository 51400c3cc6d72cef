"""Nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from check_oracle import compare, duck_tables
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import ann, queries

SF = "/root/testdata/sf0.01"


def brute(rows, wanted, k):
    found = []
    for q, v in wanted:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(found)


@settings(max_examples=30)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6))
def test_bound_holds_and_tile_is_exact(seed, k):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(9, 5)), rng.normal(size=(30, 5)) * 10.0 ** rng.integers(-3, 4, size=(30, 1))
    y[::3] = y[0]
    a, b = ann.Block(np.arange(9), x), ann.Block(np.arange(30) + 5, y)
    near, bound = ann.tile(a, b)
    assert (np.abs(near - x @ y.T) <= bound).all()
    got = {}
    for q, i, s in ann.best_of_tile(a, b, k):
        got.setdefault(q, []).append((-s, i))
    for q in range(9):
        exact = ann.exact_products(np.repeat(x[q : q + 1], 30, 0), y)
        want = sorted((-s, i + 5) for i, s in enumerate(exact.tolist()) if i + 5 != q)[:k]
        assert sorted(got[q]) == want


@pytest.mark.parametrize("blocks", [(2048, 8192), (2, 3)])
def test_odd_vectors(spark, blocks):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4), 1.0, float(-i)]) for i in range(40)] + [(40, [3.0, 4.0, 0.0]), (41, [3.0, 4.0, 0.0])]
    bad = [(50, None), (51, []), (52, [0.0, 0.0, 0.0]), (53, [1.0, None, 2.0]), (54, [nan, 1.0, 1.0]), (55, [inf, 1.0, 1.0])]
    other_length = [(60, [1.0, 2.0]), (80, [2.0, 2.0])]
    rows = [(i, v, i, "x") for i, v in [*good, *bad, *other_length]] + [(None, [1.0, 1.0, 1.0], 1, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, v string").repartition(4)
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), 5, query_block=blocks[0], vector_block=blocks[1])
    want = brute(good, [r for r in good if r[0] % 20 == 0], 5) + [(60, 1, 80, 6.0), (80, 1, 60, 6.0)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert ann.nearest(vectors.limit(0), vectors.limit(0), 5).count() == 0


def test_query_is_exact_on_the_whole_table(spark):
    problem = compare(queries.op5_nearest(spark, SF), duck_tables(SF), queries.ORACLE["op5_nearest"])
    assert problem is None, problem
