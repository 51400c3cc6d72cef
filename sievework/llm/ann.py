"""Exact top-k by inner product as a block matrix join.

Queries and candidates are dealt into blocks; each task holds one query block and one candidate block.
Vectors are quantised to int8 with a scale each, the product of the two int8 tiles gives every inner
product with a known error bound (Cauchy-Schwarz on the quantisation errors), and only pairs that can still be
among a query's k best are computed again from the original vectors in double precision. Heaps keep the k
best per tile; Spark merges the tiles' lists.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import part_count

#: Rows of a block; a task holds one block of each side, so its memory is bounded.
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
#: Lists merged in one window: the tiles of so many candidate blocks.
MERGED_BLOCKS = 64


class Block:
    """Vectors of one length with ids, their int8 form, scales and error norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.exact = ids, vectors
        top = np.abs(vectors).max(axis=1)
        self.scale = np.where(top > 0, top / 127, 1)
        self.q = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        back = self.q * self.scale[:, None]
        # A little more than the exact norms, for the rounding of these very sums.
        self.error = np.sqrt(((vectors - back) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.norm = np.sqrt((vectors**2).sum(axis=1)) * (1 + 1e-9)
        self.back = np.sqrt((back**2).sum(axis=1)) * (1 + 1e-9)


def tile(queries: Block, vectors: Block) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of all pairs of two blocks and a bound on each one's error.

    float32 holds sums of int8 products exactly up to 2**24, so 1,040 components fit one product and longer
    vectors are added up in double.
    """
    width = queries.q.shape[1]
    product = np.zeros((len(queries.ids), len(vectors.ids)))
    for k in range(0, width, 1024):
        product += queries.q[:, k : k + 1024].astype(np.float32) @ vectors.q[:, k : k + 1024].T.astype(np.float32)
    near = product * queries.scale[:, None] * vectors.scale[None, :]
    bound = queries.error[:, None] * vectors.norm[None, :] + queries.back[:, None] * vectors.error[None, :]
    return near, bound + 1e-12 * (queries.norm[:, None] * vectors.norm[None, :])


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component to the last in double precision."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best_of_tile(queries: Block, vectors: Block, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, vector id, score) of the k nearest of the block to each query, itself left out."""
    order = np.argsort(vectors.ids, kind="stable")
    ids, exact = vectors.ids[order], vectors.exact[order]
    # Of equal vectors only the k + 1 with the smallest ids can be among the k nearest.
    _, place = np.unique(exact, axis=0, return_inverse=True)
    place = place.reshape(-1)
    by_place = np.argsort(place, kind="stable")
    sizes = np.bincount(place)
    rank = np.empty(len(place), np.int64)
    rank[by_place] = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = rank <= k
    own = Block(ids[kept], exact[kept])
    step = max(1, (1 << 21) // max(1, len(own.ids)))
    for start in range(0, len(queries.ids), step):
        some = Block(queries.ids[start : start + step], queries.exact[start : start + step])
        near, bound = tile(some, own)
        own_row = some.ids[:, None] == own.ids[None, :]
        low, high = near - bound, near + bound
        low[own_row] = high[own_row] = -np.inf
        at_least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(some.ids), -np.inf)
        rows, cols = np.nonzero((high >= at_least[:, None]) & ~own_row)
        scores = exact_products(some.exact[rows], own.exact[cols])
        heap: list[tuple[float, int]] = []
        ends = np.searchsorted(rows, np.arange(len(some.ids)), side="right").tolist()
        pairs = list(zip(scores.tolist(), (-own.ids[cols]).tolist(), strict=True))
        begin = 0
        for query, end in zip(some.ids.tolist(), ends, strict=True):
            heap = pairs[begin : min(end, begin + k)]
            heapq.heapify(heap)
            for pair in pairs[begin + k : end]:
                if pair > heap[0]:
                    heapq.heapreplace(heap, pair)
            for score, negative in heap:
                yield query, -negative, score
            begin = end


_TILE = "query_id long, block int, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product for each query, ties to the
    smaller id, rows with the query's own id left out. Exact, with fewer rows if there are fewer.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do null ids; only
    vectors of equal length meet. A repeated row takes part as often as it occurs, once as query. Empty
    tables give an empty one. Other columns are not read.
    """

    def usable(table: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
        some = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        # The largest magnitude is finite and not zero; NaN sorts above all, and an array function is null-safe.
        top = F.array_max(F.transform("v", F.abs))
        whole = ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0)
        return some.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(
            whole & ~F.isnan(top) & (top > 0) & (top < float("inf"))
        )

    own, asked = usable(vectors), usable(queries).dropDuplicates(["id"])
    counted = own.agg(F.count(F.lit(1))).first()[0], asked.agg(F.count(F.lit(1))).first()[0]
    columns, rows = part_count(counted[0], vector_block), part_count(counted[1], query_block)
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    # Each row goes to every block of the other side: the least any all-against-all product can move.
    left = asked.withColumn("row", number(rows)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = own.withColumn("col", number(columns)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        for width in sorted(set(a["v"].str.len()) & set(b["v"].str.len())):
            x, y = a[a["v"].str.len() == width], b[b["v"].str.len() == width]
            found += best_of_tile(
                Block(x["id"].to_numpy(), np.stack(x["v"].to_numpy())),
                Block(y["id"].to_numpy(), np.stack(y["v"].to_numpy())),
                k,
            )
        out = pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        out.insert(1, "block", key[1])
        return out.astype({"query_id": "int64", "block": "int32", "vec_id": "int64", "score": "float64"})

    keys = ["row", "col"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _TILE)
    order = [F.col("score").desc(), F.col("vec_id")]
    some = Window.partitionBy("query_id", F.floor(F.col("block") / MERGED_BLOCKS)).orderBy(*order)
    if columns > MERGED_BLOCKS:
        tiles = tiles.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        tiles.withColumn("rank", rank.cast(T.IntegerType()))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
