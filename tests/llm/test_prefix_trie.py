"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from check_oracle import compare, duck_tables
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"
NAMES = "conv_id long, turn long, role string, text string, d long, c string, part int, edge int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **how):
    clash = [(*r, 1, "x", 2, 3) for r in rows]
    table = spark.createDataFrame(clash, NAMES).repartition(4)
    assert sorted(map(tuple, prefix_trie.prefix_trie(table, **how).collect()), key=str) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=300), st.integers(2, 70))
def test_closing_parentheses_delimit_subtrees(numbers, wide):
    parent = np.array([-1 if not i or n % 11 == 0 else i - 1 - n % min(i, wide) for i, n in enumerate(numbers)], np.int64)
    tree = prefix_trie.Parentheses(parent)
    close = tree.close()
    values = np.arange(len(parent)) + 1
    below, leaf = np.zeros(len(parent), int), np.ones(len(parent), int)
    size = np.ones(len(parent), int)
    for i in range(len(parent) - 1, -1, -1):
        own = np.flatnonzero(parent == i)
        below[i] = (below[own] + values[own]).sum()
        leaf[i] = leaf[own].sum() if len(own) else 1
        size[i] += size[own].sum()
    assert ((close - tree.open + 1) // 2).tolist() == size.tolist()
    assert tree.sums(close, values).tolist() == below.tolist()
    assert tree.leaf_pairs(close).tolist() == leaf.tolist()


def test_deep_and_wide_forests():
    deep = prefix_trie.Parentheses(np.arange(-1, 20_000))
    assert (deep.close() + deep.open).tolist() == [2 * 20_001 - 1] * 20_001
    nodes = pd.DataFrame({"conv": range(3000), "depth": [0] + [1] * 2999, "parent": 0, "top": [0] + [1] * 2999})
    nodes = nodes.assign(weight=1, own=1, hung_leaves=0, hung_saved=0)
    found = prefix_trie.subtrees(nodes)
    assert found.leaves[0] == 2999 and found.saved[0] == 2999 and found.tops.sum() == 1


@pytest.mark.parametrize("how", [{}, {"whole_members": 1, "shard_nodes": 4}])
def test_odd_conversations(spark, how):
    rows = [
        *[(c, t, "user" if t % 2 else None, f"turn {t}" if t < 5 else f"{c} {t}") for c in range(40) for t in range(c % 11)],
        *[(c, None, "user", "before all") for c in (3, 20, 21)],
        *[(7, 2, "a", "tie"), (7, 2, "b", "tie"), (7, 2, "b", "tie"), (7, 2, "", "btie")],
        *[(c, t, "user", "same") for c in range(-12, 0) for t in range(12)],
        *[(9_007_199_254_740_993 + c, 1, None, None) for c in range(12)],
        (61, 0, "user", None), (None, 1, "user", "nobody's"), (64, 1, "x", "é" * 50_000), (63, 1, "x", "é" * 50_000),
    ]
    check(spark, rows, **how)
    check(spark, [], **how)
    check(spark, [(2, 1, "only", "one")], **how)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that spreads over all ranges is numbered across them."""
    rows = [(5, t, "u", f"{t % 5}") for t in range(3000)] + [(6, t, "u", f"{t % 5}") for t in range(3000)] + [(8, 1, "u", "0")]
    check(spark, rows)


def test_query_is_exact_on_the_whole_table(spark):
    problem = compare(queries.op12_prefix_trie(spark, SF), duck_tables(SF), queries.ORACLE["op12_prefix_trie"])
    assert problem is None, problem
