"""SimHash: fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from sievework.llm import queries, simhash
from sievework.llm.components import components

SF = "/root/testdata/sf0.01"
U64 = (1 << 64) - 1


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius=4):
    """Least fingerprint reachable, by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@given(st.text(" ab\n\tAÉx", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) & U64 == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    found = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert found & U64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@given(st.integers(0, U64), st.integers(0, U64))
def test_near_is_hamming_and_the_bound_holds(a, b):
    x, y = np.array([a], np.uint64), np.array([b], np.uint64)
    counts = [[(v >> 2 * k & 3).bit_count() for k in range(32)] for v in (a, b)]
    assert sum(abs(p - q) for p, q in zip(*counts)) <= (a ^ b).bit_count()
    for radius in (0, 3, 20, 40):
        assert simhash._near(x, y, radius)[0] == ((a ^ b).bit_count() <= radius)


def test_embedding_in_spark_is_the_segment_counts(spark):
    random.seed(3)
    fps = [0, U64, 1 << 63, *(random.getrandbits(64) for _ in range(20))]
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for fp, e in rows.select("fp", simhash.embedding(F.col("fp"))).collect():
        for k in range(32):
            assert (e & U64) >> 2 * k & 3 == ((fp & U64) >> 2 * k & 3).bit_count()


def clusters(seed, groups, members, bits):
    """Chains of fingerprints that differ in a few bits, and unrelated ones."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(100)]
    for _ in range(groups):
        f = rng.getrandbits(64)
        for _ in range(members):
            fps.append(f)
            for _ in range(rng.randint(1, bits)):
                f ^= 1 << rng.randrange(64)
    return fps


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 4])
def test_links_connect_what_all_pairs_connect(spark, cell_rows):
    fps = clusters(1, 12, 15, 6)
    nodes = spark.createDataFrame([(signed(f),) for f in sorted(set(fps))], "fp long").repartition(5)
    roots = {n & U64: r & U64 for n, r in components(simhash.links(nodes, 4, cell_rows)).collect()}
    got = {f: roots.get(f, f) for f in set(fps)}
    want = brute_classes(fps)
    by_got, by_want = {}, {}
    for f in got:
        by_got.setdefault(got[f], set()).add(f)
        by_want.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_a_dense_cell_sends_a_forest_and_not_its_pairs(spark):
    base = 0x0123456789ABCDEF
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.cells(nodes, 4).repartition("cell").sortWithinPartitions("cell")
    sent = found.mapInArrow(simhash._scan(4, simhash.CELL_ROWS), "a long, b long, cell long").count()
    assert sent < 70 * len(fps)
    roots = components(simhash.links(nodes))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps) - 1


def test_components_of_a_long_chain_a_star_and_none(spark):
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7000, 7000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, texts):
    fps = {}
    for i, t in texts:
        fps.setdefault(brute_fingerprint(t), []).append(i)
    classes = brute_classes(fps)
    least = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None] + [i for i in [least.get(classes[f])] if i is not None]
        least[classes[f]] = min(known, default=None)
    want = sorted(str((i, f"{(f := brute_fingerprint(t)):016x}", least[classes[f]])) for i, t in texts)
    assert sorted(str(tuple(r)) for r in rows) == want


def test_odd_rows(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs)
    check(found.select("doc_id", simhash.hex_digits("fp"), "component_id").collect(), ODD_TEXTS)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_over_the_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    check(queries.op2_simhash(spark, SF).collect(), texts)
