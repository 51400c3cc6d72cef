"""Prefix trie of conversations in balanced parentheses.

Each conversation is rebuilt as a sequence of turns, each of its prefixes is named by its depth and a 128-bit
hash, and equal prefixes are one node. Nodes on an unbranched stretch of the trie share its lower end, so
only ends of stretches are encoded. Subtrees of few conversations go to shards whole; a shard writes its
forest as balanced parentheses, finds the closing ones over blocks of range minima of the excess, counts
leaf pairs by rank and takes savings from cumulative arrays. What lies above those subtrees, the spine
that shards share, is bounded in size; it is encoded alike once the shards' totals hang on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import part_count, utf8_bytes
from sievework.operators.skew import salted_join
from sievework.session import materialize

#: Conversations c .. c+4 share the opening of the first of them; at most 8 of its turns.
FAMILY, MOST_SHARED = 5, 8
#: A subtree of at most so many conversations is never cut. Above a 131,072th of all turns instead, so that
#: no more nodes than that can have more members: the spine.
WHOLE_MEMBERS, SPINE_NODES = 4096, 1 << 17
#: Encoded nodes of a shard.
SHARD_NODES = 50_000
#: Positions of a block of the excess sequence.
BLOCK = 64
#: Odd bases of the two halves of a prefix hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**e modulo 2**64; negative exponents give powers of the inverse."""
    sign = exponents < 0
    left = np.abs(exponents).astype(np.uint64)
    inverse = pow(base, -1, 1 << 64)
    step = np.where(sign, np.uint64(inverse), np.uint64(base))
    found = np.ones(len(left), np.uint64)
    while left.any():
        found = np.where(left & np.uint64(1), found * step, found)
        step, left = step * step, left >> np.uint64(1)
    return found


class Numbering:
    """Place of a turn in its conversation, from 1, and the sums of digest * base**place up to it."""

    @staticmethod
    def scan(first: np.ndarray, d1: np.ndarray, d2: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        place = np.arange(len(first)) - first + 1
        sums = []
        for base, d in zip(BASES, (d1, d2)):
            total = np.cumsum(d.view(np.uint64) * powers(base, place))
            sums.append(total - np.concatenate([[np.uint64(0)], total])[first])
        return [place, sums[0].view(np.int64), sums[1].view(np.int64)]

    @staticmethod
    def after(before: tuple, own: list[np.ndarray]) -> list[np.ndarray]:
        sums = []
        for base, start, s in zip(BASES, before[1:], own[1:]):
            shift = np.uint64(pow(base, int(before[0]), 1 << 64))
            sums.append((np.int64(start).view(np.uint64) + shift * s.view(np.uint64)).view(np.int64))
        return [own[0] + before[0], *sums]


class Stretches:
    """Going up a chain of nodes: depth of the last kept node (-1: none yet) and savings of the others since."""

    @staticmethod
    def scan(first: np.ndarray, depth: np.ndarray, kept: np.ndarray, saved: np.ndarray) -> list[np.ndarray]:
        row = np.arange(len(first))
        last = np.maximum.accumulate(np.where(kept == 1, row, -1))
        none = last < first
        total = np.concatenate([[0], np.cumsum(np.where(kept == 1, 0, saved))])
        return [np.where(none, -1, depth[np.maximum(last, 0)]), total[1:] - total[np.where(none, first, last + 1)], np.zeros(len(first), np.int64)]

    @staticmethod
    def after(before: tuple, own: list[np.ndarray]) -> list[np.ndarray]:
        none = own[0] == -1
        return [np.where(none, before[0], own[0]), np.where(none, own[1] + before[1], own[1]), own[2]]


def _local_scan(how, group: str, used: list[str]):
    """Scan values within a partition sorted by group, and those of its first and last group at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state, ends = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            g = batch.column(names.index(group)).to_numpy()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            first = np.repeat(new, np.diff(np.append(new, len(g))))
            own = how.scan(first, *[batch.column(names.index(c)).to_numpy() for c in used])
            if state is not None and state[0] == g[0]:
                head = int(new[1]) if len(new) > 1 else len(g)
                for column, value in zip(own, how.after(state[1], [v[:head] for v in own])):
                    column[:head] = value
            elif state is not None and not ends:
                ends.append((1, *state))
            if len(new) > 1 and not ends:
                ends.append((1, g[0], tuple(int(v[new[1] - 1]) for v in own)))
            state = (g[-1], tuple(int(v[-1]) for v in own))
            yield _marked(batch, part, np.zeros(len(g), np.int32), own)
        if state is not None:
            ends.append((2, *state))
            blank = {f.name: pa.nulls(len(ends), f.type) for f in batch.schema}
            blank[group] = pa.array([int(e[1]) for e in ends], pa.int64())
            empty = pa.RecordBatch.from_arrays(list(blank.values()), list(blank))
            yield _marked(empty, part, np.array([e[0] for e in ends], np.int32), list(np.array([e[2] for e in ends]).T))

    return run


def _marked(batch: pa.RecordBatch, part: int, edge: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    more = [pa.array(np.full(len(edge), part, np.int32)), pa.array(edge), *[pa.array(np.ascontiguousarray(v)) for v in values]]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "edge", "s0", "s1", "s2"])


def _carried(how, group: str, before: dict[int, tuple]):
    """The scan values with what the partitions before hold of a partition's first group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            part, g = batch.column(names.index("part")).to_numpy(), batch.column(names.index(group)).to_numpy()
            values = [batch.column(names.index(s)).to_numpy().copy() for s in ("s0", "s1", "s2")]
            for p in np.unique(part).tolist():
                if p in before:
                    at = np.flatnonzero((part == p) & (g == before[p][0]))
                    for column, value in zip(values, how.after(before[p][1], [v[at] for v in values])):
                        column[at] = value
            rest = [c for n, c in zip(names, batch.columns) if n not in ("part", "edge", "s0", "s1", "s2")]
            kept = [n for n in names if n not in ("part", "edge", "s0", "s1", "s2")]
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(v) for v in values]], [*kept, "s0", "s1", "s2"])

    return run


def ordered_scan(rows: DataFrame, how, group: str, order: list[Column], used: list[str], name: str) -> DataFrame:
    """``rows`` (no null group) with running values s0, s1, s2 of each group in the given order.

    Rows are dealt by range over the whole order, so one group may spread over many tasks; two rows per
    partition go to the driver, which works out what each partition's first group had before.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    longs = "s0 long, s1 long, s2 long"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(dealt.mapInArrow(_local_scan(how, group, used), f"{schema}, part int, edge int, {longs}"), name)
    before, carry, ends = {}, None, {}
    for r in made.where("edge > 0").select("part", "edge", F.col(group).alias("g"), "s0", "s1", "s2").collect():
        ends.setdefault(r["part"], {})[r["edge"]] = (r["g"], (r["s0"], r["s1"], r["s2"]))
    for part in sorted(ends):
        own = ends[part]
        g, value = own.get(1, own[2])
        if carry is not None and carry[0] == g:
            before[part] = carry
            value = tuple(int(v[0]) for v in how.after(carry[1], [np.array([v]) for v in value]))
        carry = own[2] if 1 in own else (g, value)
    return made.where("edge = 0").mapInArrow(_carried(how, group, before), f"{schema}, {longs}")


class Parentheses:
    """Balanced parentheses of a forest: positions of each node's opening one, and what lies between it and its
    closing one."""

    def __init__(self, parent: np.ndarray) -> None:
        """``parent`` holds each node's place in the arrays, -1 for a root; children come in the order given."""
        n = len(parent)
        order = np.argsort(parent, kind="stable")
        roots = int(np.searchsorted(parent[order], 0))
        first = np.searchsorted(parent[order], np.arange(n)).tolist()
        last = np.searchsorted(parent[order], np.arange(n), side="right").tolist()
        kids, opened, bits = order.tolist(), np.zeros(n, np.int64), np.zeros(2 * n, np.int8)
        place, stack = 0, kids[:roots][::-1]
        while stack:
            node = stack.pop()
            if node >= 0:
                opened[node] = place
                bits[place] = 1
                stack.append(-1)
                stack += kids[first[node] : last[node]][::-1]
            place += 1
        self.bits, self.open = bits, opened
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self._blocks()

    def _blocks(self) -> None:
        """Least excess of every block and, above, of every range of a complete binary tree over the blocks."""
        count = max(1, -(-len(self.bits) // BLOCK))
        size = 1 << (count - 1).bit_length()
        padded = np.full(size * BLOCK, np.iinfo(np.int64).max)
        padded[: len(self.excess)] = self.excess
        self.padded, self.size = padded, size
        self.least = np.concatenate([np.zeros(size, np.int64), padded.reshape(size, BLOCK).min(axis=1)])
        for node in range(size - 1, 0, -1):
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def _in_block(self, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place from ``start`` on in its own block where the excess is ``wanted``; -1 if there is none."""
        found, end = np.full(len(start), -1), (start // BLOCK + 1) * BLOCK
        for step in range(BLOCK):
            at = start + step
            left = (found < 0) & (at < end)
            if not left.any():
                break
            hit = left & (self.padded[np.minimum(at, len(self.padded) - 1)] == wanted)
            found[hit] = at[hit]
        return found

    def close(self) -> np.ndarray:
        """Position of each node's closing parenthesis: the first one after it where the excess is one less."""
        wanted = self.excess[self.open] - 1
        found = self._in_block(self.open, wanted)
        far = np.flatnonzero(found < 0)
        node, goal = self.size + self.open[far] // BLOCK, wanted[far]
        up = np.ones(len(far), bool)
        while up.any():  # to the nearest range to the right that falls to the goal
            turn = up & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.size - 1)] <= goal)
            node = np.where(turn, node + 1, np.where(up, node // 2, node))
            up &= ~turn
        while (down := node < self.size).any():
            left = 2 * node
            left = np.where(self.least[np.minimum(left, 2 * self.size - 1)] <= goal, left, left + 1)
            node = np.where(down, left, node)
        found[far] = self._in_block((node - self.size) * BLOCK, goal)
        return found

    def leaf_pairs(self, close: np.ndarray) -> np.ndarray:
        """How many pairs () lie from each node's opening to its closing parenthesis."""
        rank = np.concatenate([[0], np.cumsum((self.bits[:-1] == 1) & (self.bits[1:] == 0)), [0]])
        return rank[close] - rank[self.open]

    def sums(self, close: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of a value of the nodes below each node, itself left out."""
        spread = np.zeros(len(self.bits), np.int64)
        spread[self.open] = values
        total = np.cumsum(spread)
        return total[close] - total[self.open]


class Subtrees(NamedTuple):
    leaves: np.ndarray
    saved: np.ndarray  # below the node
    tops: np.ndarray


def subtrees(nodes: pd.DataFrame) -> Subtrees:
    """Leaves of and savings below every node of a forest; ``leaves`` and ``hung`` are what already hangs on it."""
    number = pd.Series(np.arange(len(nodes)), pd.MultiIndex.from_arrays([nodes["conv"], nodes["depth"]]))
    place = number.index.get_indexer(pd.MultiIndex.from_arrays([nodes["parent"], nodes["top"] - 1]))
    tree = Parentheses(place)
    close = tree.close()
    # A pair without children counts as a leaf unless something hangs on it.
    bare = np.bincount(place[place >= 0], minlength=len(nodes)) == 0
    hung = nodes["hung_leaves"].to_numpy()
    more = np.where(bare & (hung > 0), hung - 1, hung)
    leaves = tree.leaf_pairs(close) + tree.sums(close, more) + more
    below = tree.sums(close, (nodes["weight"] + nodes["hung_saved"]).to_numpy()) + nodes["hung_saved"].to_numpy()
    return Subtrees(leaves, below, place < 0)


_SOLVED = "conv long, depth long, n_leaves long, saved_tokens long, parent long, top long, is_top boolean, total long"


def _solve(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values(["depth", "conv"], ignore_index=True)
    found = subtrees(nodes)
    out = nodes[["conv", "depth", "parent", "top"]].copy()
    out.insert(2, "n_leaves", found.leaves)
    out.insert(3, "saved_tokens", found.saved + nodes["own"])
    out["is_top"] = found.tops
    out["total"] = found.saved + nodes["weight"]
    return out


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes of a conversation's own turns behind the shared opening."""
    for batch in batches:
        col = dict(zip(batch.schema.names, batch.columns))
        move = col["m"].to_numpy() - col["h"].to_numpy()
        out = [col["c"], pa.array(col["j"].to_numpy() + move)]
        for kind in "lq":
            for lane, base in enumerate(BASES, 1):
                value, own, opening = (col[f"{k}{lane}"].to_numpy().view(np.uint64) for k in (kind, "o", "b"))
                out.append(pa.array((opening + powers(base, move) * (value - own)).view(np.int64)))
        end = col["j"].to_numpy() == col["n"].to_numpy()
        yield pa.RecordBatch.from_arrays([*out, col["bytes"], pa.array(end)], ["c", "d", "k1", "k2", "p1", "p2", "bytes", "is_end"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, k1, k2, ends) of rows sorted by node and conversation: a digest fed row by row."""
    now, digest = None, None
    for batch in batches:
        found = []
        for d, k1, k2, c in zip(*[x.to_pylist() for x in batch.columns]):
            if (d, k1, k2) != now:
                if now is not None:
                    found.append((*now, digest.hexdigest()))
                now, digest = (d, k1, k2), hashlib.sha256(str(c).encode())
            else:
                digest.update(b",%d" % c)
        yield _ends(found)
    if now is not None:
        yield _ends([(*now, digest.hexdigest())])


def _ends(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*found)) if found else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["d", "k1", "k2", "ends_sha256"])


_NODE = ["d", "k1", "k2"]


def _turns(rows: DataFrame) -> DataFrame:
    """(c, j, l1, l2, q1, q2, bytes): each turn's place and the hashes of all turns up to it and before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, d1, d2, bytes_, j, *sums = batch.columns
            place = j.to_numpy()
            before = []
            for base, d, s in zip(BASES, (d1, d2), sums):
                own = d.to_numpy().view(np.uint64) * powers(base, place)
                before.append(pa.array((s.to_numpy().view(np.uint64) - own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([c, j, *sums, *before, bytes_], ["c", "j", "l1", "l2", "q1", "q2", "bytes"])

    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2"), F.col("row")]
    placed = ordered_scan(rows, Numbering, "c", order, ["d1", "d2", "bytes"], "turn-places")
    own = placed.select("c", "d1", "d2", "bytes", "s0", "s1", "s2")
    return own.mapInArrow(run, "c long, j long, l1 long, l2 long, q1 long, q2 long, bytes long")


def _shared(c: Column) -> Column:
    """How many opening turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)


def _members(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: their turns as nodes (c, d, k1, k2, p1, p2, bytes, is_end), and a row for each."""
    h = _shared(F.col("c"))
    opening = F.when((F.col("c") % FAMILY == 0) & (F.col("j") <= MOST_SHARED), F.struct("j", "l1", "l2", "q1", "q2", "bytes"))
    convs = turns.groupBy("c").agg(
        F.max("j").alias("n"),
        F.coalesce(F.max(F.when(F.col("j") == h, F.col("l1"))), F.lit(0)).alias("o1"),
        F.coalesce(F.max(F.when(F.col("j") == h, F.col("l2"))), F.lit(0)).alias("o2"),
        F.array_sort(F.collect_list(opening)).alias("opening"),  # 8 turns at most
    )
    convs = materialize(convs.withColumn("h", h), "conversations")
    base = convs.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("b"), F.col("opening").alias("first"))
    own = convs.drop("opening").withColumn("b", F.col("c") - F.col("c") % FAMILY)
    first = F.filter("first", lambda x: x["j"] <= F.col("h"))
    m = F.coalesce(F.greatest(F.size("first"), F.lit(0)), F.lit(0)).cast("long")
    heads = own.join(base, "b", "left").withColumn("first", first).withColumn("m", m)
    last = F.try_element_at("first", F.lit(-1))
    heads = heads.select(
        "c", "n", "h", "o1", "o2", "m", "first",
        F.coalesce(last["l1"], F.lit(0)).alias("b1"), F.coalesce(last["l2"], F.lit(0)).alias("b2"),
    )
    heads = materialize(heads, "conversation-heads")
    t = F.col("t")
    opened = heads.select("c", "n", "h", "m", F.explode("first").alias("t")).select(
        "c", t["j"].alias("d"), t["l1"].alias("k1"), t["l2"].alias("k2"), t["q1"].alias("p1"), t["q2"].alias("p2"),
        t["bytes"].alias("bytes"), ((t["j"] == F.col("m")) & (F.col("n") <= F.col("h"))).alias("is_end"),
    )
    behind = salted_join(turns.where(F.col("j") > h), heads.drop("first"), ["c"], F.col("j"))
    kinds = "c long, d long, k1 long, k2 long, p1 long, p2 long, bytes long, is_end boolean"
    return opened.unionAll(behind.mapInArrow(_shift, kinds)), heads


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    whole_members: int = WHOLE_MEMBERS,
    shard_nodes: int = SHARD_NODES,
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of
    the trie of rebuilt conversations, the root (depth 0) included.

    Turns are ordered by number, null first; turns of one number in the order of a digest of role and text, and a
    repeated row is a turn of its own. Null role and text count as empty, a very long text by its digest and
    bytes. Rows without a conversation id take no part. A conversation whose family has no first member and that
    has too few turns of its own is turnless and ends at the root. An empty table gives an empty result; other
    columns are not read.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # The length tells where the role ends.
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"),
        half(1).alias("d1"), half(17).alias("d2"), utf8_bytes(text).alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    turns = materialize(_turns(rows), "turns")
    members, heads = _members(turns)
    members = materialize(members, "trie-members")
    whole = heads.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).first()
    total = members.count()
    if not whole["n"]:
        names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
        return spark.createDataFrame([], f"{names}, ends_sha256 string")
    turnless = heads.where((F.col("m") == 0) & (F.col("n") <= F.col("h"))).select(*[F.lit(0).cast("long").alias(k) for k in _NODE], "c")
    root = heads.agg(
        F.lit(whole["n"]).cast("long").alias("n_convs"), F.min("c").alias("conv"), F.lit(0).cast("long").alias("bytes"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.count_if((F.col("m") == 0) & (F.col("n") <= F.col("h"))).alias("n_ends"),
    ).select(*[F.lit(0).cast("long").alias(k) for k in _NODE], "n_convs", "conv", "bytes", "p1", "p2", "n_ends")
    grouped = members.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv"), F.any_value("bytes").alias("bytes"),
        F.any_value("p1").alias("p1"), F.any_value("p2").alias("p2"), F.count_if("is_end").alias("n_ends"),
    )
    nodes = materialize(grouped.unionAll(root), "trie-nodes")

    # Parents and children.
    up = (F.col("d") - 1).alias("d")
    kids = nodes.where("d > 0").groupBy(up, F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    below = nodes.where("d > 0").select(up, F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv", "n_convs", "bytes", "n_ends", F.col("k1").alias("own1"), F.col("k2").alias("own2"))
    found = salted_join(below, nodes.select(*_NODE, F.col("conv").alias("parent")), _NODE, F.col("own1"))
    found = found.select((F.col("d") + 1).alias("d"), F.col("own1").alias("k1"), F.col("own2").alias("k2"), "conv", "parent", "n_convs", "bytes", "n_ends")
    top = nodes.where("d = 0").select(*_NODE, "conv", F.lit(None).cast("long").alias("parent"), "n_convs", "bytes", "n_ends")
    full = found.unionAll(top).join(kids, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    kept = (F.col("n_children") != 1) | (F.col("n_ends") > 0) | (F.col("d") == 0)
    full = full.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("kept", kept.cast("long"))
    order = [F.col("conv"), F.col("d").desc()]
    chained = ordered_scan(full.drop("bytes"), Stretches, "conv", order, ["d", "kept", "saved"], "trie-chains")
    chained = materialize(chained.drop("s2").withColumnsRenamed({"s0": "lower", "s1": "stretch"}), "trie-stretches")

    # Kept nodes with the stretch above them.
    cut = max(whole_members, part_count(total, SPINE_NODES))
    end = F.col("d") == F.col("lower")
    ends = chained.groupBy("conv", F.col("lower").alias("depth")).agg(
        F.min("d").alias("top"), F.min_by(F.coalesce("parent", "conv"), "d").alias("parent"), F.sum("saved").alias("weight"), F.max("n_convs").alias("n_convs"),
        F.max(F.when(end, F.col("saved"))).alias("own"),
    )
    ends = materialize(ends, "trie-ends")
    in_spine = (F.col("n_convs") > cut) | (F.col("depth") == 0)
    # At most SPINE_NODES nodes have more than ``cut`` members, since each takes that many of the turns.
    spine = F.broadcast(nodes.where(F.col("n_convs") > cut).select(*_NODE))
    # A conversation leaves the spine at one node, the top of the subtree it belongs to.
    unit = members.join(spine, _NODE, "left_anti").groupBy("c").agg(F.min(F.struct(*_NODE)).alias("u"))
    unit = unit.select(F.col("c").alias("conv"), F.xxhash64("u.d", "u.k1", "u.k2").alias("unit"))
    shards = part_count(ends.count(), shard_nodes)
    blank = {"hung_leaves": F.lit(0).cast("long"), "hung_saved": F.lit(0).cast("long")}
    inside = ends.where(~in_spine).join(unit, "conv").withColumns(blank)
    solved = inside.groupBy(F.pmod("unit", F.lit(shards)).alias("shard")).applyInPandas(_solve, _SOLVED)
    solved = materialize(solved, "trie-shards")
    hung = solved.where("is_top").groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth"))
    hung = hung.agg(F.sum("n_leaves").alias("hung_leaves"), F.sum("total").alias("hung_saved"))
    above = ends.where(in_spine).join(hung, ["conv", "depth"], "left").fillna(0, ["hung_leaves", "hung_saved"])
    # The spine is bounded, so one task can hold it.
    merged = above.groupBy(F.lit(0).alias("shard")).applyInPandas(_solve, _SOLVED)
    values = solved.unionAll(merged).select("conv", F.col("depth").alias("lower"), "n_leaves", "saved_tokens")

    named = members.where("is_end").select(*_NODE, "c").unionAll(turnless)
    named = named.repartition(*_NODE).sortWithinPartitions(*_NODE, "c").mapInArrow(_named, "d long, k1 long, k2 long, ends_sha256 string")
    placed = salted_join(chained, values, ["conv", "lower"], F.col("d")).join(named, _NODE, "left")
    return placed.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        # A node within a stretch has the savings of the stretch down to its lower end as well.
        (F.col("saved_tokens") + F.col("stretch")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
