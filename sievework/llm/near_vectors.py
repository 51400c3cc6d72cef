"""Near-duplicate vectors by tiled comparison of principal coordinates.

Unit vectors are turned onto the principal axes of their second moments, which changes no inner product but
puts most of it into the leading coordinates. A tile of two blocks multiplies those first; what the other
coordinates can still add is at most the product of the two suffix norms (Cauchy-Schwarz), so a pair stops as
soon as its bound is below the threshold. Blocks are cells of a cut tree over the leading coordinates, and
blocks whose boxes lie too far apart never meet. Pairs so near the threshold that single precision cannot
tell are computed again from the original vectors in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.components import components
from sievework.operators.skew import salted_join
from sievework.session import collect_few, materialize

#: Bytes of the vectors of a block; a task holds two blocks.
BLOCK_BYTES = 1 << 24
#: Numbers in the sample that the axes and cuts are fitted on, and the coordinates that cells are cut by.
FIT_NUMBERS = 1 << 22
CUT_AXES = 8
#: Rows and columns of the part of a tile that is multiplied at a time.
ROWS, COLUMNS = 1024, 4096
KEY_BYTES = 16


@dataclass
class Space:
    """Principal axes of the vectors of one length, and a complete binary tree of cuts across them."""

    axes: np.ndarray
    edges: list[int]  # coordinates after which a pair may stop
    dims: np.ndarray
    cuts: np.ndarray
    levels: int

    def cell(self, at: np.ndarray) -> np.ndarray:
        node, row = np.zeros(len(at), np.int64), np.arange(len(at))
        for _ in range(self.levels):
            node = 2 * node + 1 + (at[row, self.dims[node]] > self.cuts[node])
        return node - (2**self.levels - 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; magnitudes are first brought near 1 by powers of two."""
    wide = vectors.astype(np.float64)
    wide = np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1))[1][:, None])
    return wide / np.sqrt((wide**2).sum(axis=1))[:, None]


def fit(sample: np.ndarray, threshold: float, levels: int) -> Space:
    """Axes in falling order of second moment, and cuts at medians across the widest leading axis of each node."""
    width = sample.shape[1]
    own = unit(sample)
    energy, axes = np.linalg.eigh(own.T @ own)
    order = np.argsort(-energy, kind="stable")
    axes, energy = axes[:, order], np.cumsum(np.maximum(energy[order], 0))
    # The bound falls clearly below the threshold once the mean product of suffix norms does.
    left = 1 - energy / max(energy[-1], 1e-300)
    lead = int(np.flatnonzero(left <= max(threshold - 0.15, 0.02))[0]) + 1
    edges = [min(width, -(-lead // 8) * 8)]
    while edges[-1] < width:
        edges.append(min(width, edges[-1] * 2))
    at = own @ axes[:, :CUT_AXES]
    dims, cuts, members = np.zeros(2**levels, np.int64), np.zeros(2**levels), {0: np.arange(len(at))}
    for node in range(2**levels - 1):
        rows = members.pop(node)
        if len(rows):
            dims[node] = np.argmax(at[rows].std(axis=0))
            cuts[node] = np.median(at[rows, dims[node]])
        over = at[rows, dims[node]] > cuts[node]
        members[2 * node + 1], members[2 * node + 2] = rows[~over], rows[over]
    return Space(axes, edges, dims, cuts, levels)


class Points:
    """Vectors of a block: as they are, turned and in single precision, with norms of what follows each edge."""

    def __init__(self, vectors: np.ndarray, space: Space) -> None:
        self.vectors = vectors
        turned = unit(vectors) @ space.axes
        after = np.sqrt(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1])
        ends = [after[:, e] if e < after.shape[1] else np.zeros(len(after)) for e in space.edges]
        self.tails = np.array(ends, np.float32) * np.float32(1 + 1e-6)
        self.turned = turned.astype(np.float32)
        self.head = np.hstack([self.turned[:, : space.edges[0]], self.tails[0][:, None]])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row in double precision."""
    return np.einsum("ij,ij->i", unit(a), unit(b))


def close_pairs(
    a: Points, b: Points, rows: slice, columns: slice, edges: list[int], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of a part of the tile whose cosine reaches the threshold."""
    # Ten times the rounding that single precision can leave in a product of so many coordinates.
    slack = np.float32(10 * (edges[-1] + 8) * 2.0**-24)
    least = np.float32(threshold) - slack
    bound = a.head[rows] @ b.head[columns].T
    alive = bound >= least
    left = np.count_nonzero(alive)
    if left * 8 > alive.size:  # too many to follow one by one
        part = a.turned[rows] @ b.turned[columns].T
        i, j = np.nonzero(part >= least)
        part = part[i, j]
        i, j = i + rows.start, j + columns.start
    else:
        i, j = np.nonzero(alive)
        part = bound[i, j]
        i, j = i + rows.start, j + columns.start
        part -= a.tails[0][i] * b.tails[0][j]
        for k, (low, high) in enumerate(pairwise(edges), 1):
            part += np.einsum("ij,ij->i", a.turned[i, low:high], b.turned[j, low:high])
            on = part + a.tails[k][i] * b.tails[k][j] >= least
            i, j, part = i[on], j[on], part[on]
    linked = part >= np.float32(threshold) + slack
    for unsure in np.array_split(np.flatnonzero(~linked), 1 + len(part) // 100_000):
        linked[unsure] = cosines(a.vectors[i[unsure]], b.vectors[j[unsure]]) >= threshold
    return i[linked], j[linked]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the nodes a and b are linked; a root is the least node of its group."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def compare(a: Points, b: Points, same: bool, counts: tuple, edges: list[int], threshold: float):
    """Weighted number of links of each vector of both blocks, and links that connect what is linked."""
    n, m = len(a.turned), len(b.turned)
    of_a, of_b, root = np.zeros(n), np.zeros(m), np.arange(n + (0 if same else m))
    for r in range(0, n, ROWS):
        for c in range(r // COLUMNS * COLUMNS if same else 0, m, COLUMNS):
            i, j = close_pairs(a, b, slice(r, min(n, r + ROWS)), slice(c, min(m, c + COLUMNS)), edges, threshold)
            if same:
                i, j = i[i < j], j[i < j]
            of_a += np.bincount(i, counts[1][j], n)
            of_b += np.bincount(j, counts[0][i], m)
            root = unite(root, i, j if same else j + n)
    return (of_a + of_b, of_b[:0], root) if same else (of_a, of_b, root)


_ROWS = "vec_id long, key binary, width int, v binary"
_CELLS = "width int, cell int, key binary, least long, n long, v binary, at array<double>"
_PACKETS = "x long, y long, width int, block long, keys binary, counts binary, v binary"
_FOUND = "a binary, b binary, n long"


def _keyed(dtype: str):
    """Each row's id, its vector as bytes and their digest; no digest for vectors that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts, sizes = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
            values = lists.values.to_numpy(zero_copy_only=False).astype(dtype) + np.dtype(dtype).type(0)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            keys, raws = [None] * batch.num_rows, [None] * batch.num_rows
            for width in np.unique(sizes[there & (sizes > 0)]).tolist():
                rows = np.flatnonzero(there & (sizes == width))
                own = values[starts[rows][:, None] + np.arange(width)]
                good = np.isfinite(own).all(axis=1) & (own != 0).any(axis=1)
                for row, v in zip(rows[good].tolist(), own[good]):
                    raws[row] = v.tobytes()
                    keys[row] = hashlib.md5(raws[row], usedforsecurity=False).digest()
            widths = pa.array([None if k is None else s for k, s in zip(keys, sizes.tolist())], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), widths, pa.array(raws, pa.binary())],
                ["vec_id", "key", "width", "v"],
            )

    return run


def _placed(spaces: dict[int, Space], dtype: str):
    """Each vector's cell and leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths).tolist():
                rows = batch.filter(pa.array(widths == width))
                own = np.frombuffer(b"".join(rows.column(4).to_pylist()), dtype).reshape(-1, width)
                at = unit(own) @ spaces[width].axes[:, :CUT_AXES]
                offsets = np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(1),
                        pa.array(spaces[width].cell(at), pa.int32()),
                        rows.column(0),
                        rows.column(2),
                        rows.column(3),
                        rows.column(4),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.ravel())),
                    ],
                    ["width", "cell", "key", "least", "n", "v", "at"],
                )

    return run


@dataclass
class Blocks:
    """Blocks of the cells of one vector length: a cell with many vectors has several. Numbers are global."""

    first: dict[int, int]
    parts: dict[int, int]
    cells: np.ndarray  # of each block from ``start`` on
    start: int
    low: np.ndarray  # boxes by block
    high: np.ndarray

    def partners(self, block: int, threshold: float) -> np.ndarray:
        """Blocks that may hold a vector at the threshold or above: |u - v|^2 = 2 - 2 cos."""
        own = block - self.start
        gap = np.maximum(np.maximum(self.low - self.high[own], self.low[own] - self.high), 0)
        return self.start + np.flatnonzero((gap**2).sum(axis=1) <= 2 - 2 * threshold + 1e-9)


def _blocks(boxes: list, limit: dict[int, int]) -> dict[int, Blocks]:
    found, start = {}, 0
    for width in sorted({b["width"] for b in boxes}):
        own = sorted((b for b in boxes if b["width"] == width), key=lambda b: b["cell"])
        parts = [-(-b["n"] // limit[width]) for b in own]
        ends = np.cumsum(parts)
        first = {b["cell"]: start + int(e) - p for b, e, p in zip(own, ends, parts)}
        low, high = (np.repeat(np.array([b[side] for b in own]), parts, axis=0) for side in ("low", "high"))
        cells = np.repeat([b["cell"] for b in own], parts)
        found[width] = Blocks(first, {b["cell"]: p for b, p in zip(own, parts)}, cells, start, low, high)
        start += int(ends[-1])
    return found


def _packed(blocks: dict[int, Blocks], threshold: float, most: int = 1 << 22):
    """Vectors of a batch packed by block, once for every block that theirs has to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, raws = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            counts = batch.column(3).to_numpy()
            spread = np.array([int.from_bytes(k[:4], "little") for k in keys], np.int64)
            first = np.array([blocks[w].first[c] for w, c in zip(width.tolist(), cell.tolist())], np.int64)
            parts = np.array([blocks[w].parts[c] for w, c in zip(width.tolist(), cell.tolist())], np.int64)
            block = first + spread % parts
            order = np.argsort(block, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                own, w = int(block[rows[0]]), int(width[rows[0]])
                pack = [b"".join(keys[r] for r in rows), counts[rows].astype("<i8").tobytes(), b"".join(raws[r] for r in rows)]
                others = blocks[w].partners(own, threshold)
                step = max(1, most // sum(map(len, pack)))
                for at in range(0, len(others), step):
                    some = others[at : at + step]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.minimum(some, own)),
                            pa.array(np.maximum(some, own)),
                            pa.array([w] * len(some), pa.int32()),
                            pa.array([own] * len(some), pa.int64()),
                            *[pa.array([p] * len(some), pa.binary()) for p in pack],
                        ],
                        ["x", "y", "width", "block", "keys", "counts", "v"],
                    )

    return run


def _tile(spaces: dict[int, Space], dtype: str, threshold: float):
    def block(packets: pd.DataFrame, space: Space, width: int) -> tuple[list[bytes], np.ndarray, Points]:
        keys, counts, v = (b"".join(packets[name]) for name in ("keys", "counts", "v"))
        names = [keys[k : k + KEY_BYTES] for k in range(0, len(keys), KEY_BYTES)]
        return names, np.frombuffer(counts, "<i8"), Points(np.frombuffer(v, dtype).reshape(-1, width), space)

    def run(key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        width = int(packets["width"].iloc[0])
        space = spaces[width]
        left = block(packets[packets["block"] == x], space, width)
        right = left if x == y else block(packets[packets["block"] == y], space, width)
        if not left[0] or not right[0]:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        of_a, of_b, root = compare(left[2], right[2], x == y, (left[1], right[1]), space.edges, threshold)
        names = left[0] if x == y else left[0] + right[0]
        counted = np.concatenate([of_a, of_b])
        some, moved = np.flatnonzero(counted), np.flatnonzero(root != np.arange(len(root)))
        a = [names[k] for k in some] + [names[k] for k in moved]
        b = [None] * len(some) + [names[k] for k in root[moved]]
        n = np.concatenate([counted[some], np.zeros(len(moved))]).astype(np.int64)
        return pd.DataFrame({"a": a, "b": b, "n": n})

    return run


def _levels(rows: int, width: int, itemsize: int, block_bytes: int) -> int:
    """Depth of the cut tree: a cell fits a block, and already thousands of rows give work to several cores."""
    limit = max(1, block_bytes // (width * itemsize))
    return max(int(np.ceil(np.log2(max(1, rows / limit)))), min(3, int(np.log2(max(1, rows // 512)))))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    fit_numbers: int = FIT_NUMBERS,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: how many other rows have a cosine of at least
    ``threshold`` (above 0) with it, the smallest id reachable over such links, and whether that is its own.

    Exact: every pair is decided as double precision decides it. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing (no links, a component of their own), and only vectors of one
    length meet. Equal vectors are compared once, however many there are; each copy counts as a link of the
    others. A repeated row is a row of its own, and so is one of several vectors under one id. A null id takes
    part but names no component (it is null if all its ids are) and is never kept. An empty table gives an
    empty one; other columns are not read. Axes and cuts come from a sample of about ``fit_numbers``
    numbers; they decide how soon pairs stop, never which pairs link.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    numbers = F.col(vector_col) if dtype == "<f4" else F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), numbers.alias("v"))
    rows = materialize(source.mapInArrow(_keyed(dtype), _ROWS), "vector-rows")
    usable = rows.where(F.col("key").isNotNull())
    sizes = {r["width"]: r["n"] for r in collect_few(usable.groupBy("width").agg(F.count(F.lit(1)).alias("n")), "vector lengths")}
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    spaces, total = {}, sum(sizes.values())
    for width, n in sizes.items():
        share = min(1.0, fit_numbers / (width * n * len(sizes)))
        picked = usable.where(F.col("width") == width)
        if share < 1:
            picked = picked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = np.frombuffer(b"".join(r["v"] for r in picked.select("v").toLocalIterator()), dtype).reshape(-1, width)
        if not len(sample):  # a tiny share may pick nothing
            sample = np.frombuffer(usable.where(F.col("width") == width).select("v").first()["v"], dtype).reshape(1, -1)
        spaces[width] = fit(sample, threshold, _levels(n, width, np.dtype(dtype).itemsize, block_bytes))
    distinct = usable.groupBy("key", "width").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"))
    placed = materialize(distinct.select("key", "width", "least", "n", "v").mapInArrow(_placed(spaces, dtype), _CELLS), "vector-cells")
    axes = [F.get("at", F.lit(k)) for k in range(CUT_AXES)]
    box = placed.groupBy("width", "cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.coalesce(F.min(x), F.lit(0.0)) for x in axes]).alias("low"),
        F.array(*[F.coalesce(F.max(x), F.lit(0.0)) for x in axes]).alias("high"),
    )
    limit = {w: max(1, block_bytes // (w * np.dtype(dtype).itemsize)) for w in sizes}
    blocks = _blocks(collect_few(box, "cells"), limit)
    packets = placed.select("width", "cell", "key", "n", "v").mapInArrow(_packed(blocks, threshold), _PACKETS)
    tiles = packets.groupBy("x", "y").applyInPandas(_tile(spaces, dtype, threshold), _FOUND)
    found = materialize(tiles, "vector-links")
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    named = (
        placed.select("key", "least", "n")
        .join(links, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    named = materialize(named, "vector-names")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = salted_join(named, names, ["root"], F.col("key")).select("key", "n_links", "component_id")
    linked = salted_join(usable.select("vec_id", "key"), by_key, ["key"], F.col("vec_id"))
    alone = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "n_links", "component_id").unionAll(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
