"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from check_oracle import compare, duck_tables
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import lexical, queries

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in split(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        scored.sort()
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_the_maximal_matches(text):
    encoded = text.encode("utf-8", "surrogatepass")
    assert [t.decode("utf-8", "surrogatepass") for t in lexical.terms(encoded)] == split(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([f"t{k}" for k in range(40)]), min_size=1, max_size=400), st.integers(1, 900))
def test_bound_is_never_below_the_score(words, other):
    counts = Counter(w.encode() for w in words)
    corpus = lexical.Corpus(10, 10 * len(words) + other)
    items = [{f"t{k}".encode(): 3 + k for k in range(s, 60, 7)} for s in range(7)] + [{}]
    batch = lexical.Batch(items, corpus, 3)
    bounds = batch.bounds(lexical.sketch(counts), len(words))
    for q, bound in zip(batch.asked, bounds):
        assert bound >= batch.score(q, counts, corpus.m(len(words)))


def test_more_than_a_bucket_holds():
    counts = Counter({b"often": 5000, b"once": 1})
    corpus = lexical.Corpus(2, 9000)
    batch = lexical.Batch([{b"often": 7}], corpus, 1)
    assert batch.bounds(lexical.sketch(counts), 5001)[0] >= batch.score(0, counts, corpus.m(5001))


@pytest.mark.parametrize("block", [4096, 3])
def test_odd_documents(spark, odd_docs, block):
    items = [
        (1, "plain words of an ordinary text"),
        (2, None),
        (3, ""),
        (4, "The quick BROWN fox; the the"),
        (5, "ΣΑΣ İstanbul 日本語"),
        (5, "ΣΑΣ İstanbul 日本語"),
        (None, "without an id numbers"),
        (6, "nowhere"),
    ]
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id int, text string, n long, sketch string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = lexical.search(odd_docs, asked, 3, item_block=block)
    assert found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 3)


def test_empty_tables(spark, odd_docs, no_docs):
    asked = spark.createDataFrame([(1, "plain words")], "item_id long, text string")
    assert lexical.search(no_docs, asked).collect() == []
    assert lexical.search(odd_docs, asked.limit(0)).collect() == []


def test_query_is_exact_on_the_whole_table(spark):
    problem = compare(queries.op11_lexical(spark, SF), duck_tables(SF), queries.ORACLE["op11_lexical"])
    assert problem is None, problem
