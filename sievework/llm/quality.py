"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts on the executors. Trees are fitted with numpy on a bounded sample
of labelled rows (``FIT_ROWS``, the rows with the least hash of their id), then flattened into five
arrays, and every document walks all trees at once by array look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import slices, texts

#: Labelled rows the trees are fitted on at most. It bounds the driver's table (rows x statistics).
FIT_ROWS = 20_000

FEATURES = (
    "log_bytes",
    "log_words",
    "mean_word_bytes",
    "distinct_words",
    "distinct_pairs",
    "top_word",
    "same_as_before",
    "upper",
    "digits",
    "blanks",
    "ends_of_sentences",
    "commas",
    "other_marks",
    "beyond_ascii",
    "marked_words",
    "line_bytes",
    "distinct_lines",
    "letter_entropy",
)

_CLASS = np.full(256, 7, np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence end, 5 comma, 6 other mark, 7 rest
for _letters, _k in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2)):
    _CLASS[list(_letters)] = _k
_CLASS[[i for i in range(33, 127) if _CLASS[i] == 7]] = 6
_CLASS[[9, 10, 13, 32]] = 3
_CLASS[[ord(c) for c in ".!?"]] = 4
_CLASS[[ord(c) for c in ",;:'\"-()"]] = 5


def statistics(text: str) -> list[float]:
    """The values of ``FEATURES`` for one text; all zero for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if raw.size == 0:
        return [0.0] * len(FEATURES)
    letters = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=letters, minlength=8) / raw.size
    p = letters[letters > 0] / raw.size
    words = text.split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-2:-1] and not w[-2].isalnum())
    return [
        float(np.log1p(raw.size)),
        float(np.log1p(len(words))),
        raw.size / n,
        len(counts) / n,
        len(pairs) / max(1, len(words) - 1),
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        float(kinds[1]),
        float(kinds[2]),
        float(kinds[3]),
        float(kinds[4]),
        float(kinds[5]),
        float(kinds[6]),
        float(kinds[7]),
        marked / n,
        raw.size / len(lines),
        len(set(lines)) / len(lines),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node k tests ``x[feature[k]] <= threshold[k]`` and goes to left or right;
    a leaf points to itself and carries its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    step: float = 0.15,
    bins: int = 64,
    least_rows: int = 5,
    penalty: float = 1.0,
) -> Trees:
    """Boost logistic loss. Without rows every score is 0.5, with one class only it is near that class."""
    n, width = x.shape
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), int)
    columns = [binned[:, f].astype(np.int64) for f in range(width)]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(at: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(at)
        return k

    margin = np.full(n, base)
    for _ in range(trees if 0 < ones < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(leaf(0.0))
        place = np.full(n, roots[-1])  # node of each row
        level = [roots[-1]]
        for _ in range(depth):
            slot = np.full(len(feature), -1)
            slot[level] = np.arange(len(level))
            s = slot[place]
            active = np.flatnonzero(s >= 0)
            s, ga, ha = s[active], g[active], h[active]
            best = [(0.0, -1, -1)] * len(level)
            for f in range(width):
                m = len(edges[f]) + 1
                if m == 1:
                    continue
                key = s * m + columns[f][active]
                size = len(level) * m
                sums = [np.bincount(key, w, size).reshape(-1, m).cumsum(1) for w in (ga, ha, np.ones(len(key)))]
                gl, hl, nl = (a[:, :-1] for a in sums)
                gt, ht, nt = (a[:, -1:] for a in sums)
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(nl < least_rows) | (nt - nl < least_rows)] = -1
                cut = gain.argmax(1)
                for k, c in enumerate(cut):
                    if gain[k, c] > best[k][0] + 1e-9:
                        best[k] = (float(gain[k, c]), f, int(c))
            below = []
            for node, (gain, f, c) in zip(list(level), best, strict=True):
                if f < 0:
                    continue
                feature[node], threshold[node] = f, edges[f][c]
                left[node], right[node] = leaf(0.0), leaf(0.0)
                rows = np.flatnonzero(place == node)
                place[rows] = np.where(columns[f][rows] <= c, left[node], right[node])
                below += [left[node], right[node]]
            level = below
            if not level:
                break
        sums = np.bincount(place, g, len(feature)), np.bincount(place, h, len(feature))
        for node in np.unique(place):
            value[node] = float(-step * sums[0][node] / (sums[1][node] + penalty))
        margin += np.asarray(value)[place]
    if not roots:
        roots.append(leaf(0.0))
    return Trees(
        np.asarray(feature), np.asarray(threshold), np.asarray(left), np.asarray(right), np.asarray(value),
        np.asarray(roots), depth, base if n else 0.0,
    )


def held_out(doc_id: str | Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    some = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(some.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from the labelled documents outside the held-out part; at most ``fit_rows`` of them.

    At most ``fit_rows`` labels are looked up; where ids occur in many documents, again only so many rows of
    statistics, first by hash of the id, are learned from.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(fit_rows)
    )
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    # The chosen labels are at most fit_rows pairs of numbers, so their size is bounded.
    labelled = read.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("quality")),
                    pa.array(stats, pa.list_(pa.float64())),
                ],
                ["doc_id", "quality", "stats"],
            )

    measured = labelled.mapInArrow(run, "doc_id long, quality int, stats array<double>")
    found = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "stats").limit(fit_rows).toPandas()
    found = found.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(found["stats"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["quality"].to_numpy(float))


def with_scores(
    docs: DataFrame, trees: Trees, score_col: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """All rows of ``docs``, their columns (or those in ``keep``) and the score of the whole text.

    Null and empty texts are scored on statistics that are all zero. ``score_col`` must be a new name.
    No shuffle."""
    keep = docs.columns if keep is None else keep
    if score_col in keep:
        raise ValueError(f"column {score_col!r} exists already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts(batch, text_col)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(trees.scores(x))],
                [*keep, score_col],
            )

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, accept: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Ids, language, source and labels are no inputs of a score. Labels that are null or neither 0 nor 1
    and labels without a document teach nothing; repeated labels count as often as they occur. A null id
    is not held out. Without usable labels every score is 0.5. Empty tables give an empty one.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = with_scores(read, fit_on(docs, labels, fit_rows), "score", keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= accept).cast("int").alias("predicted"),
    )
