"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from check_oracle import compare, duck_tables
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import near_vectors, queries

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.9):
    """(id, links, component, kept) of rows (id, vector or None), each row on its own."""

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    def linked(a, b):
        if not usable(a) or not usable(b) or len(a) != len(b):
            return False
        x, y = np.array(a, float), np.array(b, float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold

    links = [[k for k in range(len(rows)) if k != i and linked(rows[i][1], rows[k][1])] for i in range(len(rows))]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in links[todo.pop()] if k not in seen]
            seen.update(new)
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((own, len(links[i]), least, own is not None and own == least))
    return sorted(out, key=str)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.sampled_from([0.3, 0.9, 0.999]))
def test_tile_finds_every_pair(seed, width, threshold):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = (centres[rng.integers(0, 6, 70)] + rng.normal(size=(70, width)) * rng.choice([0.01, 0.2, 0.5], (70, 1))).astype(np.float32)
    x *= 10.0 ** rng.integers(-3, 4, size=(70, 1)).astype(np.float32)
    space = near_vectors.fit(x, threshold, 2)
    near_vectors_rows, near_vectors.ROWS = near_vectors.ROWS, 16
    old, near_vectors.COLUMNS = near_vectors.COLUMNS, 32
    try:
        counts = rng.integers(1, 4, 70)
        a, b = near_vectors.Points(x[:30], space), near_vectors.Points(x[30:], space)
        of_a, of_b, root = near_vectors.compare(a, b, False, (counts[:30], counts[30:]), space.edges, threshold)
        own, _, own_root = near_vectors.compare(a, a, True, (counts[:30], counts[:30]), space.edges, threshold)
    finally:
        near_vectors.ROWS, near_vectors.COLUMNS = near_vectors_rows, old
    u = near_vectors.unit(x)
    links = near_vectors.cosines(np.repeat(u, 70, 0), np.tile(u, (70, 1))).reshape(70, 70) >= threshold
    assert of_a.tolist() == (links[:30, 30:] @ counts[30:]).tolist()
    assert of_b.tolist() == (links[:30, 30:].T @ counts[:30]).tolist()
    inner = links[:30, :30] & ~np.eye(30, dtype=bool)
    assert own.tolist() == (inner @ counts[:30]).tolist()
    for i, j in zip(*np.nonzero(links[:30, 30:])):
        assert root[i] == root[30 + j]
    for i, j in zip(*np.nonzero(inner)):
        assert own_root[i] == own_root[j]


def test_partners_hold_every_block_with_a_link():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 12)), 20, axis=0) + rng.normal(size=(600, 12)) * 0.1
    space = near_vectors.fit(x, 0.9, 5)
    at = near_vectors.unit(x) @ space.axes[:, : near_vectors.CUT_AXES]
    cell = space.cell(at)
    boxes = [
        {"width": 12, "cell": int(c), "n": int((cell == c).sum()), "low": at[cell == c].min(0), "high": at[cell == c].max(0)}
        for c in np.unique(cell)
    ]
    blocks = near_vectors._blocks(boxes, {12: 10})[12]
    links = near_vectors.unit(x) @ near_vectors.unit(x).T >= 0.9
    met = {c: {int(blocks.cells[b]) for b in blocks.partners(blocks.first[c], 0.9)} for c in blocks.first}
    assert all(int(cell[j]) in met[int(cell[i])] for i, j in zip(*np.nonzero(links)))
    assert sum(map(len, met.values())) < len(met) ** 2  # and some blocks never meet


@pytest.mark.parametrize(("kind", "block"), [("double", 1 << 24), ("float", 40)])
def test_odd_vectors(spark, kind, block):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 4), 1.0, float(-(i % 7))]) for i in range(40)] + [(90, [3e-30, 0.0, 0.0]), (91, [2e30, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [0.0, -0.0, 0.0]), (53, [1.0, None, 2.0]), (54, [nan, 1.0, 1.0]), (55, [inf, 1.0, 1.0])]
    other = [(60, [1.0, 2.0]), (61, [2.0, 4.0]), (62, [5.0]), (-3, [-1.0]), (7, [0.0, -0.0, -1.0]), (7, [0.0, -0.0, -1.0])]
    rows = [*good, *bad, *other, (None, [1.0, 1.0, 1.0]), (None, None)]
    clash = [(i, v, 1, "x", b"y") for i, v in rows]
    names = f"vec_id long, embedding array<{kind}>, n long, v string, key binary"
    vectors = spark.createDataFrame(clash, names).repartition(5)
    found = near_vectors.near_vectors(vectors, block_bytes=block)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert near_vectors.near_vectors(vectors.limit(0)).collect() == []
    nothing = near_vectors.near_vectors(vectors.where("embedding IS NULL")).collect()
    assert sorted(map(tuple, nothing), key=str) == sorted([(50, 0, 50, True), (None, 0, None, False)], key=str)


def test_many_copies_and_a_small_fit(spark):
    rows = [(i, [1.0, 0.25 * (i % 3), 0.1]) for i in range(900)] + [(5000 + i, [0.0, float(i), -9.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = near_vectors.near_vectors(vectors, block_bytes=120, fit_numbers=30)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_query_is_exact_on_the_whole_table(spark):
    problem = compare(queries.op13_near_vectors(spark, SF), duck_tables(SF), queries.ORACLE["op13_near_vectors"])
    assert problem is None, problem
