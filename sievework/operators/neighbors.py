"""Exact k nearest neighbours (Euclidean) as Spark joins over bounded cells.

No pair of rows beyond the k nearest ever leaves a task, and no task holds an unbounded group:

1. Rows at the same place are reduced to the few with the smallest keys. No query can use more of
   them, so this loses nothing, and a place shared by a third of all rows costs nothing extra.
2. Space is cut into cells of about ``cell_rows`` places. Cut lines come from a bounded sample;
   they only decide where a place is looked up, never whether it counts.
3. Each distinct query place is compared with its own cell, which gives a distance limit.
4. It is then compared with every other cell whose bounding box lies within that limit (found from
   the root of the cut tree down), and the best k of all answers are kept. A cell beyond the limit
   cannot hold a nearer row.

Cells with many rows or queries are cut further into slices, so a wrongly guessed cell size only
means more tasks. Order is (squared distance, key), so ties are decided by the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from sievework.functions.portable import SEED
from sievework.operators.skew import salted_join
from sievework.session import collect_few, materialize

CELL_ROWS = 4096
SAMPLE_ROWS = 4_000_000
SAMPLE_PER_CELL = 32
MAX_CELLS = 131_072
_BLOCK_CELLS = 2_000_000  # distances held at once in a task


@dataclass(frozen=True)
class _Tree:
    """A group's cut tree in arrays: below ``at`` go left, else right; a leaf has ``cell`` >= 0.

    Children come after their node. ``n``, ``lo`` and ``hi`` are the rows and the box of all cells
    below a node, once :meth:`filled` has told them.
    """

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    n: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    def filled(self, cells: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> _Tree:
        """The same tree with the sizes and boxes of its cells, added up from the leaves."""
        place = {int(c): i for i, c in enumerate(cells)}
        width = lo.shape[1]
        count = np.zeros(len(self.cell), dtype=np.int64)
        low = np.full((len(self.cell), width), np.inf)
        high = np.full((len(self.cell), width), -np.inf)
        for i in reversed(range(len(self.cell))):
            if self.cell[i] >= 0:
                j = place.get(int(self.cell[i]))
                if j is not None:
                    count[i], low[i], high[i] = n[j], lo[j], hi[j]
            else:
                kids = [self.left[i], self.right[i]]
                count[i] = count[kids].sum()
                low[i], high[i] = low[kids].min(axis=0), high[kids].max(axis=0)
        return _Tree(self.dim, self.at, self.left, self.right, self.cell, count, low, high)


def _grow(points: np.ndarray, cells: int, first_cell: int) -> _Tree:
    """Halve the widest side at its median until the wanted number of cells is reached."""
    nodes: list[tuple[int, float, int, int, int]] = []
    counter = [first_cell]

    def grow(pts: np.ndarray, wanted: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, -1))
        spread = pts.max(axis=0) - pts.min(axis=0) if len(pts) else np.zeros(points.shape[1])
        dim = int(spread.argmax())
        if wanted <= 1 or len(pts) < 2 or spread[dim] == 0:
            nodes[me] = (-1, 0.0, -1, -1, counter[0])
            counter[0] += 1
            return me
        at = float(np.median(pts[:, dim]))
        low = pts[:, dim] < at
        if not low.any():  # the median is the minimum: cut just above it
            at = float(pts[pts[:, dim] > at, dim].min())
            low = pts[:, dim] < at
        left = grow(pts[low], wanted // 2)
        right = grow(pts[~low], wanted - wanted // 2)
        nodes[me] = (dim, at, left, right, -1)
        return me

    grow(points, cells)
    return _Tree(*(np.array(column) for column in zip(*nodes)))


def _locate(tree: _Tree, points: np.ndarray) -> np.ndarray:
    """Cell of each point."""
    out = np.empty(len(points), dtype=np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        i, idx = todo.pop()
        if tree.cell[i] >= 0:
            out[idx] = tree.cell[i]
        elif len(idx):
            low = points[idx, tree.dim[i]] < tree.at[i]
            todo += [(tree.left[i], idx[low]), (tree.right[i], idx[~low])]
    return out


def _box_distance(tree: _Tree, i: int, points: np.ndarray, farthest: bool = False) -> np.ndarray:
    """Squared distance of each point to the nearest (or farthest) spot of a node's box."""
    below, above = tree.lo[i] - points, points - tree.hi[i]
    gap = np.maximum(np.abs(below), np.abs(above)) if farthest else np.maximum(np.maximum(below, above), 0.0)
    return (gap * gap).sum(axis=1)


def _limits(tree: _Tree, points: np.ndarray, k: int) -> np.ndarray:
    """A distance within which k rows lie: the far side of the smallest box on a point's way with k rows."""
    bound = np.full(len(points), np.inf)
    todo = [(0, np.arange(len(points)))]
    while todo:
        i, idx = todo.pop()
        if not len(idx) or tree.n[i] < k:
            continue
        bound[idx] = np.minimum(bound[idx], _box_distance(tree, i, points[idx], farthest=True))
        if tree.cell[i] < 0:
            low = points[idx, tree.dim[i]] < tree.at[i]
            todo += [(tree.left[i], idx[low]), (tree.right[i], idx[~low])]
    return bound


def _cells_within(tree: _Tree, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(point, cell) of all cells whose box is within a point's limit, and how many boxes were compared.

    From the root down only the children of boxes within the limit are looked at.
    """
    rows, cells, compared = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    # A hair of slack: box and row distances are rounded separately.
    slack = limit * (1 + 1e-9)
    todo = [(0, np.arange(len(points)))]
    while todo:
        i, idx = todo.pop()
        if not len(idx) or tree.n[i] == 0:
            continue
        compared += len(idx)
        idx = idx[_box_distance(tree, i, points[idx]) <= slack[idx]]
        if tree.cell[i] >= 0:
            rows.append(idx)
            cells.append(np.full(len(idx), tree.cell[i], dtype=np.int32))
        else:
            todo += [(tree.left[i], idx), (tree.right[i], idx)]
    return np.concatenate(rows), np.concatenate(cells), compared


def _nearest_in(q: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, squared distance) of the k nearest; ``b`` is in key order."""
    rows, cols, dist = [], [], []
    step = max(1, _BLOCK_CELLS // max(1, len(b)))
    k = min(k, len(b))
    for start in range(0, len(q), step):
        block = q[start : start + step]
        d2 = np.zeros((len(block), len(b)))
        for j in range(q.shape[1]):
            gap = block[:, j : j + 1] - b[None, :, j]
            d2 += gap * gap
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(d2 <= limit)
        d = d2[r, c]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        rows.append(r[keep] + start)
        cols.append(c[keep])
        dist.append(d[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _group_id(df: DataFrame, group: Sequence[str]) -> Column:
    """Groups as one value, so one code path serves none, one or several group columns.

    A JSON array quotes its cells and writes NULL as such, so different groups never look alike.
    """
    cells = F.array(*[F.col(g).cast("string") for g in group])
    return F.to_json(cells) if group else F.lit("")


def _present(feature: str) -> Column:
    """The feature as a double; NULL and NaN have no place and raise."""
    x = F.col(feature).cast("double")
    wrong = F.raise_error(F.lit(f"feature {feature} is missing in a row"))
    return F.when(x.isNull() | F.isnan(x), wrong).otherwise(x)


def neighbor_lists(
    base: DataFrame,
    queries: DataFrame,
    features: Sequence[str],
    key: str,
    k: int,
    group: Sequence[str] = (),
    carry: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(group, features, neighbors) for every distinct query place.

    ``neighbors`` lists the k nearest base rows of the same group, a row at the place itself
    included, as structs (d2, key, carried columns), nearest first. A missing feature raises.
    """
    features, group, carry = list(features), list(group), list(carry)
    xs = [f"_x{i}" for i in range(len(features))]
    renamed = [_present(f).alias(x) for f, x in zip(features, xs)]

    # 1. At most k rows per place. The rank limit is applied before the shuffle as well.
    same_place = Window.partitionBy("_g", *xs).orderBy("_key")
    cs = [f"_c{i}" for i in range(len(carry))]
    carried = [F.col(name).alias(c) for name, c in zip(carry, cs)]
    places = (
        base.select(_group_id(base, group).alias("_g"), *renamed, F.col(key).alias("_key"), *carried)
        .withColumn("_r", F.row_number().over(same_place))
        .where(F.col("_r") <= k)
    )
    places = materialize(places, "neighbor-places")
    wanted = queries.select(_group_id(queries, group).alias("_g"), *renamed).distinct()

    # 2. Cells, from a bounded sample of places.
    counted = places.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["_g"]: r["n"] for r in collect_few(counted, "groups")}
    total = sum(sizes.values())
    spots = places.where("_r = 1").select("_g", *xs)
    per_cell = max(cell_rows, -(-total // MAX_CELLS))
    big = {g for g, n in sizes.items() if n > per_cell}
    sample = pd.DataFrame(columns=["_g", *xs])
    if big:
        big_spots = spots.where(F.col("_g").isin(sorted(big)))
        enough = min(SAMPLE_ROWS, SAMPLE_PER_CELL * sum(-(-sizes[g] // per_cell) for g in big))
        if total > enough:
            big_spots = big_spots.sample(fraction=enough / total, seed=SEED)
        sample = big_spots.toPandas()
    trees: dict[str, _Tree] = {}
    next_cell = 0
    by_group = {g: part[xs].to_numpy(dtype=float) for g, part in sample.groupby("_g")}
    for g in sorted(sizes):
        points = by_group.get(g, np.zeros((0, len(xs))))
        points = points[np.lexsort(points.T)] if len(points) else points
        trees[g] = _grow(points, max(1, -(-sizes[g] // per_cell)), next_cell)
        next_cell += int((trees[g].cell >= 0).sum())

    key_type = base.schema[key].dataType
    place_fields = [T.StructField("_g", T.StringType())] + [T.StructField(x, T.DoubleType()) for x in xs]
    answer_type = T.StructType(
        place_fields
        + [
            T.StructField("d2", T.DoubleType()),
            T.StructField("_key", key_type),
        ]
        + [places.schema[c] for c in cs]
    )

    def to_cells(df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())])

        def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                cell = np.full(len(pdf), -1, dtype=np.int32)
                points = pdf[xs].to_numpy(dtype=float)
                for g, idx in pdf.groupby("_g").indices.items():
                    if g in trees:
                        cell[idx] = _locate(trees[g], points[idx])
                yield pdf.assign(_cell=cell)

        return df.mapInPandas(locate, schema)

    single = next_cell == len(sizes)
    if single:  # one cell per group: its number is a lookup, and no other cell needs asking
        cells = [(g, int(trees[g].cell[0])) for g in sizes]

        def numbered(df: DataFrame) -> DataFrame:
            # One row per group, and no more groups than collect_few has let through.
            cell_of = df.sparkSession.createDataFrame(cells, "_g string, _cell int")
            return df.join(F.broadcast(cell_of), "_g")

        in_cells, ask = numbered(places), numbered(wanted)
    else:
        in_cells = materialize(to_cells(places), "neighbor-cells")
        ask = materialize(to_cells(wanted).where("_cell >= 0"), "neighbor-queries")
    in_cells = in_cells.select("_cell", *xs, "_key", *cs)

    bounds = in_cells.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(x).alias(f"lo{x}") for x in xs],
        *[F.max(x).alias(f"hi{x}") for x in xs],
    )

    def probe(asked: DataFrame) -> DataFrame:
        """k nearest within the named cell, for each (place, cell)."""
        # Slices per cell keep both sides of a task bounded. The size table has one row per cell.
        base_n = in_cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("nb"))
        ask_n = asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("nq"))
        slices = F.broadcast(
            base_n.join(ask_n, "_cell").select(
                "_cell",
                F.ceil(F.col("nb") / F.lit(2 * cell_rows)).cast("int").alias("sb"),
                F.ceil(F.col("nq") / F.lit(4 * cell_rows)).cast("int").alias("sq"),
            )
        )
        right = (
            in_cells.join(slices, "_cell")
            .withColumn("_sb", F.pmod(F.xxhash64("_key"), F.col("sb").cast("long")).cast("int"))
            .withColumn("_sq", F.explode(F.sequence(F.lit(0), F.col("sq") - 1)))
            .drop("sb", "sq")
        )
        left = (
            asked.join(slices, "_cell")
            .withColumn("_sq", F.pmod(F.xxhash64(*xs), F.col("sq").cast("long")).cast("int"))
            .withColumn("_sb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
            .drop("sb", "sq")
        )

        def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return pd.DataFrame(columns=answer_type.fieldNames())
            b = b.sort_values("_key", kind="stable")
            r, c, d = _nearest_in(q[xs].to_numpy(dtype=float), b[xs].to_numpy(dtype=float), k)
            out = q.iloc[r][["_g", *xs]].reset_index(drop=True)
            picked = b.iloc[c]
            return out.assign(d2=d, **{n: picked[n].to_numpy() for n in ["_key", *cs]})

        keys = ["_cell", "_sb", "_sq"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, answer_type)

    answers = probe(ask)
    if not single:
        answers = materialize(answers, "neighbor-own-cell")
        boxes = bounds.toPandas().sort_values("_cell").reset_index(drop=True)
        group_of = {int(c): g for g, tree in trees.items() for c in tree.cell if c >= 0}
        known = {
            g: trees[g].filled(
                part["_cell"].to_numpy(),
                part["n"].to_numpy(),
                part[[f"lo{x}" for x in xs]].to_numpy(dtype=float),
                part[[f"hi{x}" for x in xs]].to_numpy(dtype=float),
            )
            for g, part in boxes.groupby(boxes["_cell"].map(group_of))
        }
        # 3. Distance of the k-th answer so far; none yet when the own cell is too small.
        so_far = F.array_sort(F.collect_list("d2"))
        limits = (
            answers.groupBy("_g", *xs)
            .agg(so_far.alias("d"))
            .select("_g", *xs, F.when(F.size("d") >= k, F.col("d")[k - 1]).alias("limit"))
        )
        asked = ask.join(limits, ["_g", *xs], "left")
        other_type = T.StructType([*place_fields, T.StructField("_cell", T.IntegerType())])

        def other_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                points = pdf[xs].to_numpy(dtype=float)
                limit = pdf["limit"].to_numpy(dtype=float, na_value=np.nan)
                own = pdf["_cell"].to_numpy()
                for g, idx in pdf.groupby("_g").indices.items():
                    bound = limit[idx]
                    open_ = np.isnan(bound)
                    bound[open_] = _limits(known[g], points[idx[open_]], k)
                    r, cells, _ = _cells_within(known[g], points[idx], bound)
                    keep = cells != own[idx][r]
                    r, cells = r[keep], cells[keep]
                    if len(r):
                        yield pdf.iloc[idx[r]][["_g", *xs]].assign(_cell=cells)

        # 4. Ask the other cells that are near enough.
        more = materialize(asked.mapInPandas(other_cells, other_type), "neighbor-more")
        answers = answers.unionByName(probe(more))

    ordered = F.array_sort(F.collect_list(F.struct("d2", "_key", *cs)))
    best = answers.groupBy("_g", *xs).agg(F.slice(ordered, 1, k).alias("_best"))
    neighbors = F.transform(
        "_best",
        lambda s: F.struct(
            s["d2"].alias("d2"),
            s["_key"].alias("key"),
            *[s[c].alias(name) for c, name in zip(cs, carry)],
        ),
    )
    return best.select("_g", *xs, neighbors.alias("neighbors"))


def attach_neighbors(
    rows: DataFrame, lists: DataFrame, features: Sequence[str], key: str, group: Sequence[str] = ()
) -> DataFrame:
    """Add the list of its place to every row; a place shared by very many rows is salted."""
    xs = [f"_x{i}" for i in range(len(features))]
    placed = rows.withColumn("_g", _group_id(rows, list(group))).withColumns(
        {x: F.col(f).cast("double") for f, x in zip(features, xs)}
    )
    return salted_join(placed, lists, ["_g", *xs], F.col(key)).drop("_g", *xs)


def knn_within_group(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    k: int,
    group: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Each row with its k nearest other rows of its group, nearest first.

    One more than k is looked up per place: dropping the row itself then leaves k.
    """
    lists = neighbor_lists(df, df, features, key, k + 1, group, list(features), cell_rows)
    rows = attach_neighbors(df, lists, features, key, group)
    others = F.filter("neighbors", lambda s: s["key"] != F.col(key))
    return rows.withColumn("neighbors", F.slice(others, 1, k))


def knn_leaving_out(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    k: int,
    group: Sequence[str],
    fold: str,
    folds: int,
    left_out: str = "left_out",
    listed: int | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Each row once per fold other than its own (``left_out``), with its k nearest other rows outside that fold.

    All folds share one search for ``listed`` neighbours (2k + 5 by default), from which each fold's rows are struck.
    A list that keeps fewer than k, although the group has more rows than it shows, is searched for again
    among the rows of its own fold's training part; only groups with such lists are copied for that.
    """
    features, group = list(features), list(group)
    many = 2 * k + 5 if listed is None else max(listed, k + 1)
    lists = neighbor_lists(df, df, features, key, many, group, [*features, fold], cell_rows)
    rows = attach_neighbors(df, lists, features, key, group)
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    each = rows.withColumn("_listed", F.size("neighbors")).withColumn(left_out, F.explode(others))
    kept = F.filter("neighbors", lambda s: (s["key"] != F.col(key)) & (s[fold] != F.col(left_out)))
    struck = materialize(each.withColumn("neighbors", F.slice(kept, 1, k)), "neighbors-left-out")
    is_short = (F.size("neighbors") < k) & (F.col("_listed") == many)
    columns = [left_out, *df.columns, "neighbors"]
    whole = struck.where(~is_short).select(*columns)
    short = struck.where(is_short).select(left_out, *df.columns)
    if short.isEmpty():
        return whole
    needed = short.select(left_out, *group).distinct()
    base = df.withColumn(left_out, F.explode(others)).join(needed, [left_out, *group])
    within = [left_out, *group]
    again = neighbor_lists(base, short, features, key, k + 1, within, [*features, fold], cell_rows)
    found = attach_neighbors(short, again, features, key, within)
    own = F.filter("neighbors", lambda s: s["key"] != F.col(key))
    return whole.unionByName(found.withColumn("neighbors", F.slice(own, 1, k)).select(*columns))


def knn_pairs(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    k: int,
    group: Sequence[str] = (),
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(group, key, rank, neighbor key, squared distance), one row per neighbour."""
    found = knn_within_group(df, features, key, k, group, cell_rows)
    return found.select(*group, key, F.posexplode("neighbors").alias("rank", "s")).select(
        *group,
        key,
        (F.col("rank") + 1).alias("rank"),
        F.col("s.key").alias("neighbor"),
        F.col("s.d2").alias("d2"),
    )
