"""SimHash near-duplicates by a grid join over segment bit counts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Changing one bit changes
one count by one, so the Manhattan distance of two embeddings is at most the number of differing bits.
Embeddings within distance r differ in at most r segments, hence in at most r of ``r + 4`` blocks of
segments: they fall into one grid cell in at least one of the projections onto 4 blocks. Pairs of a cell
are tested by the Manhattan bound and then bit by bit. A cell sends on a spanning forest of its links, never
all its pairs, and very full cells are cut into blocks that meet pairwise in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import id_and_text, slices
from sievework.llm.components import components
from sievework.session import materialize

SEED = 42
#: Members of a cell that are compared in one task; fuller cells go to block pairs.
CELL_ROWS = 2048
#: Blocks of a projection's grid that must agree.
KEPT_BLOCKS = 4
_LOW = np.uint64(0x5555555555555555)


def fingerprint(text: str, shingle: int = 4) -> int:
    """Signed 64-bit SimHash; 0 for a text without words.

    Words are what lies between ASCII white space, A-Z in lower case; a bit is set if it is set in more than
    half of the XXH64 hashes of all word shingles, repeats included.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    h = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        hashes = [h(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(found) - shingle] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        hashes = [h(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed long) for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits."""
    low, upper = F.lit(int(_LOW)), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(upper).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(low), 1))


def masks(radius: int) -> list[int]:
    """One projection per choice of ``KEPT_BLOCKS`` of ``radius + KEPT_BLOCKS`` blocks of whole segments."""
    blocks = radius + KEPT_BLOCKS
    edges = [2 * (32 * k // blocks) for k in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [reduce(int.__or__, some) for some in combinations(whole, KEPT_BLOCKS)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def cells(nodes: DataFrame, radius: int) -> DataFrame:
    """(cell, fp): every fingerprint once per projection of the grid."""
    grid = F.array(
        *[
            F.xxhash64(F.lit(k), embedding(F.col("fp")).bitwiseAND(F.lit(m).cast("long")))
            for k, m in enumerate(masks(radius))
        ]
    )
    return nodes.select(F.explode(grid).alias("cell"), "fp")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs link: Manhattan distance of the embeddings first, then the differing bits themselves."""
    # |x - y| of two-bit counts 0..2, summed: the counts differ in the bits of x ^ y except that 1 and 2
    # differ by 1 and in two bits.
    x, y = a - ((a >> np.uint64(1)) & _LOW), b - ((b >> np.uint64(1)) & _LOW)
    d = x ^ y
    both = d & (d >> np.uint64(1)) & _LOW
    low = np.bitwise_count(d & _LOW) + 2 * np.bitwise_count((d >> np.uint64(1)) & _LOW) - 2 * np.bitwise_count(both)
    found = low <= radius
    found[found] = np.bitwise_count(a[found] ^ b[found]) <= radius
    return found


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes under the links a-b."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def _forest(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within the radius in each cell; rows are sorted by cell."""
    n = len(cell)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(starts, n))
    last = np.repeat(starts + size, size)
    at = np.arange(n)
    a_links, b_links, held, step = [at[:0]], [at[:0]], 0, 1
    while (at := at[at + step < last[at]]).size:
        near = at[_near(fp[at], fp[at + step], radius)]
        if near.size:
            a_links.append(near)
            b_links.append(near + step)
            held += near.size
            if held > 4 * n + 100_000:  # keep a forest only
                root = _roots(n, np.concatenate(a_links), np.concatenate(b_links))
                moved = np.flatnonzero(root != np.arange(n))
                a_links, b_links, held = [root[moved]], [moved], moved.size
        step += 1
    root = _roots(n, np.concatenate(a_links), np.concatenate(b_links))
    moved = np.flatnonzero(root != np.arange(n))
    return fp[root[moved]], fp[moved]


_FOUND = "a long, b long, cell long"


def _found(a: np.ndarray, b: np.ndarray, cell: np.ndarray | None = None) -> pa.RecordBatch:
    third = pa.nulls(len(a), pa.int64()) if cell is None else pa.array(cell.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), third], ["a", "b", "cell"]
    )


def _scan(radius: int, cell_rows: int):
    """Over rows (cell, fp) sorted by cell: links of each cell; members of over-full cells pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = fp = np.zeros(0, np.uint64)
        full = None  # the over-full cell whose rows are passing
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([cell, batch.column(0).to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            begin = int(np.searchsorted(_signed(cell), _signed(cell[-1:])[0]))  # the last cell may go on
            if begin:
                yield from work(cell[:begin], fp[:begin], full)
                full, cell, fp = None, cell[begin:], fp[begin:]
            if full == cell[0] or len(cell) > cell_rows:
                full = cell[0]
                yield _found(fp, fp, cell)
                cell, fp = cell[:0], fp[:0]
        if len(cell):
            yield from work(cell, fp, full)

    def work(cell: np.ndarray, fp: np.ndarray, full) -> Iterator[pa.RecordBatch]:
        _, place, size = np.unique(_signed(cell), return_inverse=True, return_counts=True)
        over = size[place] > cell_rows
        if full is not None:
            over |= cell == full
        if over.any():
            yield _found(fp[over], fp[over], cell[over])
        alone = (size[place] == 1) | over
        yield _found(*_forest(cell[~alone], fp[~alone], radius))

    return run


def _signed(cell: np.ndarray) -> np.ndarray:
    """Cells as Spark sorts them."""
    return cell.view(np.int64)


def _full_cells(members: DataFrame, radius: int, cell_rows: int) -> DataFrame:
    """Links inside over-full cells: their rows are dealt into blocks, and each pair of blocks is a task's cell."""
    counts = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") * 2 / cell_rows).cast("int")
    dealt = members.join(counts, "cell").withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", "cell"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("cell", "fp", "own", other)
    key = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    # A block holds half of cell_rows on average, so a pair of blocks fits memory with ample room.
    return pairs.select(key.alias("cell"), "fp")


def links(nodes: DataFrame, radius: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (distinct, column fp) reachable by steps of at
    most ``radius`` differing bits."""
    dealt = cells(nodes, radius).repartition("cell").sortWithinPartitions("cell")
    found = materialize(dealt.mapInArrow(_scan(radius, cell_rows), _FOUND), "simhash-links")
    members = found.where("cell IS NOT NULL").select("cell", F.col("a").alias("fp"))
    again = _full_cells(members, radius, cell_rows).repartition("cell").sortWithinPartitions("cell")
    whole = again.mapInArrow(_scan(radius, 1 << 30), _FOUND)
    return found.where("cell IS NULL").select("a", "b").unionAll(whole.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fp and component_id for every row: the smallest id reachable over links of at most ``radius``
    differing bits.

    Texts without words, null among them, have fingerprint 0 and link like any other; null ids take part
    but never name a component (it is null if all its ids are); repeated rows each get a row, an empty
    table gives an empty one; other columns are not read. Equal fingerprints are one node before
    anything is compared, so copies cost one row each, however many there are.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
