"""Quality classifier: trees, held-out accuracy, and rows that teach nothing."""

from __future__ import annotations

import zlib

import numpy as np
from odd_texts import ODD_TEXTS

from sievework.llm import quality, queries

SF = "/root/testdata/sf0.1"


def walk(trees, x):
    """One row, one tree, one node at a time."""
    total = trees.base
    for root in trees.roots:
        k = root
        while trees.left[k] != k:
            k = trees.left[k] if x[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
        total += trees.value[k]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_score_like_a_walk_and_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x[:400], y[:400])
    scores = trees.scores(x)
    assert np.allclose(scores, [walk(trees, r) for r in x])
    assert ((scores[400:] > 0.5) == y[400:]).mean() > 0.9
    assert len(trees.feature) == len(trees.threshold) == len(trees.left) == len(trees.right) == len(trees.value)


def test_no_labels_one_class_and_constant_statistics():
    none = quality.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.scores(np.ones((2, 3))).tolist() == [0.5, 0.5]
    ones = quality.fit(np.ones((10, 3)), np.ones(10))
    assert (ones.scores(np.ones((2, 3))) > 0.9).all()
    same = quality.fit(np.ones((10, 3)), np.array([0.0, 1.0] * 5))
    assert np.allclose(same.scores(np.ones((1, 3))), 0.5)


def test_statistics_of_odd_texts():
    for _, t in ODD_TEXTS:
        found = quality.statistics(t or "")
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(2, 0, 0), (4, 1, 0), (4, 1, 1), (6, 0, None), (7, None, 0), (999, 1, 0), (None, 1, 0), (5, 3, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    found = quality.score(odd_docs, labels).collect()
    assert len(found) == len(ODD_TEXTS)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert quality.score(no_docs, labels).count() == 0
    assert {r.score for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_accuracy_and_no_leak_of_held_out_labels(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    found = {r.doc_id: r for r in queries.op10_quality(spark, SF).collect()}
    assert len(found) == docs.count()
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    wrong = sum(r.predicted != q for r, q in held)
    assert len(held) > 500 and wrong <= 0.01 * len(held)
    # Other labels on the held-out rows change nothing.
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality"
    )
    again = {r.doc_id: r.score for r in quality.score(docs, turned).collect()}
    assert all(again[i] == r.score for i, r in found.items())


def test_bound_on_fit_rows(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    assert quality.fit_on(docs, labels, fit_rows=300).scores(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_the_bound_holds_for_repeated_ids(spark, monkeypatch):
    seen = []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or plain(x, y))
    learned = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.range(300).selectExpr(f"{learned}L AS doc_id", "concat('some words ', id % 7) AS text")
    labels = spark.createDataFrame([(learned, 1), (learned, 0)], "doc_id long, quality int")
    quality.fit_on(docs, labels, fit_rows=8)
    assert seen == [8]
