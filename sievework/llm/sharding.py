"""Shards by best-fit decreasing bin packing.

Groups of equal texts are indivisible. Taken by falling size, each goes into the fullest shard that still
has room, found in a balanced tree of remaining capacities. Groups of one size are alike, so the
packing runs over the histogram of sizes (a short table whatever the corpus) and says how many groups of
a size go to which shard; Spark then numbers the groups of each size and looks their shard up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import part_count, utf8_bytes
from sievework.session import materialize

#: Sizes have this many leading bits; below 2**14 they are exact, above they are rounded up by less than
#: 1/8192. So there are at most 2**14 + 2**13 * 49 different sizes, which bounds the histogram.
SIZE_BITS = 14

#: Rows that are numbered in one window.
NUMBERED_ROWS = 4096


class RemainingTree:
    """Remaining capacity of bins in order: a treap, balanced by priorities mixed from the bin number."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        node = [(remaining, number), (number + 1) * 0x9E3779B97F4A7C15 % (1 << 61), None, None]
        self.root = self._join(self._join(low, node), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with room for ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first, rest = self._split(high, (min_key := self._least(high))[:1] + (min_key[1] + 1,))
        self.root = self._join(low, rest)
        return first[0]

    @staticmethod
    def _least(node: list) -> tuple[int, int]:
        while node[2] is not None:
            node = node[2]
        return node[0]


Runs = dict[int, list[tuple[int, int]]]


def pack(histogram: dict[int, int], capacity: int, most_bins: int | None = None) -> tuple[Runs, list[int]] | None:
    """Best-fit decreasing over ``size -> groups``.

    Returns for each size the (bin, groups) in the order they are filled, and the load of each bin; None if
    more than ``most_bins`` are needed. A group larger than the capacity gets a bin of its own.
    """
    tree, loads, runs = RemainingTree(), [], {}
    for size in sorted(histogram, reverse=True):
        left, own = histogram[size], []
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if most_bins is not None and len(loads) == most_bins:
                    return None
                found = (max(capacity, size), len(loads))
                loads.append(0)
            remaining, number = found
            # Once in the tightest bin, the next groups of this size fit it best until it is full.
            n = min(left, remaining // size)
            own.append((number, n))
            loads[number] += n * size
            left -= n
            tree.add(remaining - n * size, number)
        runs[size] = own
    return runs, loads


def pack_evenly(histogram: dict[int, int], shards: int) -> Runs:
    """Packing into exactly ``shards`` bins of the least capacity that best-fit decreasing can do with.

    A group larger than an even share gets a shard of its own, and the others share the remaining shards
    evenly. The capacity is searched from the even share upwards in steps from 1/65536 of it.
    """
    rest, alone = dict(histogram), []
    total = sum(size * n for size, n in rest.items())
    while len(alone) < shards - 1 and rest and (top := max(rest)) * (shards - len(alone)) > total:
        alone.append(top)
        total -= top
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
    bins = shards - len(alone)
    share = max(-(-total // bins), max(rest, default=1))
    slack = 0
    while (found := pack(rest, share + slack, bins)) is None:
        slack = max(1, share >> 16, slack * 2)
    runs, loads = found
    runs = {size: [(number + len(alone), n) for number, n in own] for size, own in runs.items()}
    for number, size in enumerate(alone):
        runs.setdefault(size, []).insert(0, (number, 1))
    return runs


def rounded_size(size: Column) -> Column:
    """``size`` rounded up to ``SIZE_BITS`` leading bits."""
    spare = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), spare)
    return F.call_function("div", size + unit - 1, unit) * unit


@dataclass(frozen=True)
class Numbering:
    """A gapless number from 0 per key, in parts so that no window grows with the data."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def add(self, rows: DataFrame, name: str, parts: int) -> DataFrame:
        """``rows`` with the number; rows equal in all of ``order`` are numbered in any order."""
        cut = rows.withColumn("_part", F.pmod(F.xxhash64(*self.order), F.lit(parts)).cast("int"))
        counts = cut.groupBy(*self.keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*self.keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        within = Window.partitionBy(*self.keys, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in self.order])
        return (
            cut.withColumn("_at", F.row_number().over(within))
            .join(offsets, [*self.keys, "_part"])
            .withColumn(name, F.col("_before") + F.col("_at") - 1)
            .drop("_part", "_at", "_before")
        )


def shard(
    docs: DataFrame,
    shards: int | None = None,
    capacity: int | None = None,
    overhead: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row.

    Give ``capacity`` (bytes a shard may hold; as few shards as best-fit decreasing needs) or ``shards`` (that
    many shards of nearly equal bytes). A row's size is its text's UTF-8 bytes plus ``overhead``. Equal
    texts, null among them, form one group and stay together; a group larger than a shard has one to
    itself. Null texts count no bytes and have CRC 0; null ids and repeated rows are rows like others;
    shards may stay empty if there are few groups, an empty table gives an empty one, other columns are not
    read. Only ids, sizes and hashes are shuffled, never texts.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (utf8_bytes(text) + overhead).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("_group"),
        ),
        "shard-rows",
    )
    groups = materialize(
        rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.first("size").alias("_size"))
        .select("_group", "_rows", rounded_size(F.col("_rows") * F.col("_size")).alias("_class")),
        "shard-groups",
    )
    found = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).collect()
    histogram = {r["_class"]: r["n"] for r in found}
    runs = pack(histogram, capacity)[0] if shards is None else pack_evenly(histogram, shards)
    plan = []
    for size, own in runs.items():
        at, ends = 0, []
        for _, n in own:
            at += n
            ends.append(at)
        plan.append((size, ends, [number for number, _ in own]))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "_class long, _ends array<long>, _bins array<int>")
    n_groups, n_rows = sum(histogram.values()), sum(r["rows"] for r in found)
    ranked = Numbering(("_class",), ("_group",)).add(groups, "_rank", part_count(n_groups, NUMBERED_ROWS))
    # One row per size, bounded by SIZE_BITS.
    placed = ranked.join(F.broadcast(plan), "_class").select(
        "_group",
        F.element_at("_bins", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))) + 1).alias("shard"),
    )
    whole = rows.join(placed, "_group")
    n_bins = max((number for own in runs.values() for number, _ in own), default=0) + 1
    numbered = Numbering(("shard",), ("doc_id", "_group")).add(
        whole, "slot", part_count(n_rows, NUMBERED_ROWS * n_bins)
    )
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")
