"""Ranked lexical search over hashed max-sketches.

The index holds, for each document, how often its terms occur, folded into two hashed rows of coordinatewise
maxima. A term's part of a score grows with its occurrences, so the lesser of its two maxima bounds it from
above. A batch of items is looked up in every sketch at once; documents are then scored exactly from their
texts in falling order of the bound until it drops below an item's k-th best score.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import slices
from sievework.session import materialize

#: Items that are searched for in one pass over the index.
ITEM_BLOCK = 4096
#: Buckets of a row of a sketch for each distinct term, before rounding up to a power of two.
LOAD = 2
#: A bucket's largest value; it stands for any greater number of occurrences.
FULL = 255
SPREAD = 0x9E3779B1
#: Null ids come after all others.
LAST = 1 << 63

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, with A-Z in lower case."""
    return text.translate(_FOLD).split()


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of terms in the two rows of 2**bits buckets; the second row's come after the first's."""
    second = (hashes * SPREAD & 0xFFFFFFFF) >> (32 - bits)
    return hashes & (1 << bits) - 1, second + (1 << bits)


def sketch(counts: Counter) -> bytes:
    """Two rows of maxima of the occurrences of a document's terms."""
    bits = min(32, max(4, (LOAD * len(counts) - 1).bit_length()))
    hashes = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts))
    often = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), FULL).astype(np.uint8)
    rows = np.zeros(2 << bits, np.uint8)
    for place in _places(hashes, bits):
        np.maximum.at(rows, place, often)
    return rows.tobytes()


def part(often, length: int):
    """A term's share of a score before its weight, from its occurrences and the document's m."""
    return (1_000_000_000 * often) // (1000 * often + 8 * length)


@dataclass
class Corpus:
    """Documents with a term, and all their terms."""

    n_docs: int
    n_terms: int

    def weight(self, held: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * held + 1)))

    def m(self, length: int) -> int:
        return 25 + 75 * length * self.n_docs // self.n_terms


@dataclass
class Batch:
    """The items of one pass, with weighted terms; places of their hashes are kept for each sketch width."""

    items: list[dict[bytes, int]]
    corpus: Corpus
    k: int
    _looked_up: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.asked = [i for i, own in enumerate(self.items) if own]
        vocabulary = sorted({t for own in self.items for t in own})
        number = {t: i for i, t in enumerate(vocabulary)}
        self.hashes = np.array([zlib.crc32(t) for t in vocabulary], np.int64)
        self.at = np.array([number[t] for i in self.asked for t in self.items[i]], np.int64)
        self.weights = np.array([w for i in self.asked for w in self.items[i].values()], np.int64)
        sizes = [len(self.items[i]) for i in self.asked]
        self.starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64)

    def bounds(self, rows: bytes, length: int) -> np.ndarray:
        """An upper bound of the document's score for every asked item."""
        seen = np.frombuffer(rows, np.uint8)
        bits = (len(seen) // 2).bit_length() - 1
        if bits not in self._looked_up:
            self._looked_up[bits] = _places(self.hashes, bits)
        first, second = self._looked_up[bits]
        often = np.arange(FULL + 1)
        often[FULL] = max(FULL, length)
        most = part(often, self.corpus.m(length))[np.minimum(seen[first], seen[second])]
        return np.add.reduceat(most[self.at] * self.weights, self.starts)

    def score(self, item: int, counts: Counter, m: int) -> int:
        return sum(w * part(counts[t], m) for t, w in self.items[item].items() if t in counts)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of these documents for each item: (item, doc_id, score)."""
        best: list[list[tuple[int, int]]] = [[] for _ in self.asked]
        least = np.ones(len(self.asked), np.int64)  # what a document must reach
        for batch in slices(batches):
            if not batch.num_rows or not self.asked:
                continue
            ids, lengths, sketches, texts = (c.to_pylist() for c in batch.columns)
            bounds = np.array([self.bounds(s, n) for s, n in zip(sketches, lengths)])
            counted: dict[int, Counter] = {}
            for q in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                own = bounds[:, q]
                for row in np.argsort(-own, kind="stable").tolist():
                    if own[row] < least[q]:
                        break
                    if row not in counted:
                        counted[row] = Counter(terms(texts[row]))
                    score = self.score(self.asked[q], counted[row], self.corpus.m(lengths[row]))
                    if score < least[q]:
                        continue
                    entry = (score, -(LAST if ids[row] is None else ids[row]))
                    if len(best[q]) < self.k:
                        heapq.heappush(best[q], entry)
                    else:
                        heapq.heappushpop(best[q], entry)
                    if len(best[q]) == self.k:
                        least[q] = best[q][0][0]
        found = [(self.asked[q], -i, s) for q, own in enumerate(best) for s, i in own]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int32()),
                pa.array([None if f[1] == LAST else f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )


_INDEX = "doc_id long, n long, sketch binary, text binary, term binary, held long"


def _index(vocabulary: set[bytes]):
    """Rows (doc_id, n, sketch, text) of documents with a term, then (term, held): a task's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            made = []
            for i, text in zip(ids, texts):
                found = terms(text or b"")
                if found:
                    counts = Counter(found)
                    held.update(vocabulary & counts.keys())
                    made.append((i, len(found), sketch(counts), text, None, None))
            yield _rows(made)
        yield _rows([(None, None, None, None, t, n) for t, n in held.items()])

    return run


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    columns = list(zip(*made)) if made else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _held(vocabulary: set[bytes]):
    """(term, held) of the texts of an index, for terms that were not counted when it was made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.update(vocabulary.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "held"]
        )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k documents of highest score above 0 for each item, equal
    scores by ascending id, null ids last; fewer if there are fewer.

    Exact. A null or empty text has no term; such a document counts nowhere and an item without terms finds
    nothing. A repeated document is a document of its own, and so is a repeated item. Empty tables
    give an empty result; other columns are not read. Items are taken in blocks of ``item_block``, each of
    which reads the index once; document frequencies are kept only for the terms of a block.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    index, corpus, results = None, None, []
    for block in batched(asked.toLocalIterator(), item_block):
        wanted = [Counter(terms(r["text"] or b"")) for r in block]
        vocabulary = {t for own in wanted for t in own}
        if index is None:
            made = materialize(source.mapInArrow(_index(vocabulary), _INDEX), "sketches")
            index = made.where(F.col("n").isNotNull()).select("doc_id", "n", "sketch", "text")
            total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            corpus = Corpus(*total)
            frequency = made.where(F.col("term").isNotNull())
        else:
            frequency = index.select("text").mapInArrow(_held(vocabulary), "term binary, held long")
        # One row per term of the block at most.
        held = {bytes(r["term"]): r["n"] for r in frequency.groupBy("term").agg(F.sum("held").alias("n")).collect()}
        weighted = [
            {t: w for t, n in own.items() if t in held and (w := n * corpus.weight(held[t])) > 0} for own in wanted
        ]
        found = index.mapInArrow(Batch(weighted, corpus, k).search, "item int, doc_id long, score long")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out
