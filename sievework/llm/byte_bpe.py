"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A leaf of the tree holds the rank of the pair that starts at that byte (with the byte's position, so
that the least of equal ranks is the leftmost); a merge changes at most three leaves, each in
logarithmic time, so one word of a million bytes is no problem.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievework.llm.common import WHITE, helper, id_and_text, slices, texts
from sievework.llm.word_pieces import Bounded

#: Chunks and pieces kept per Python worker.
KEPT = 400_000
_NONE = 1 << 62
_PLACE = (1 << 32) - 1

#: What a text falls into without looking at letters: a word with the blank before it, or white space.
#: Split patterns of this family never match across such a border.
_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank per line, the bytes in base64."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    n = len(piece)
    if n == 0:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    get = ranks.get
    size = 1 << max(0, (n - 2).bit_length())  # leaves: pairs starting at 0 .. n - 2
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end, before = list(range(1, n + 1)), list(range(-1, n))

    while (root := tree[1]) != _NONE:
        i = root & _PLACE
        j = end[i]
        e = end[i] = end[j]
        before[e] = i
        if j < n - 1:
            tree[size + j] = _NONE
        rank = get(piece[i : end[e]]) if e < n else None
        tree[size + i] = _NONE if rank is None else rank << 32 | i
        h = before[i]
        if h < 0:
            h = i
        else:
            rank = get(piece[h:e])
            tree[size + h] = _NONE if rank is None else rank << 32 | h
        # The nodes above the three leaves, level by level; they soon are the same.
        x, y, z = (size + h) >> 1, (size + i) >> 1, (size + min(j, n - 2)) >> 1
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            tree[x] = a if a < b else b
            if y != x:
                a, b = tree[2 * y], tree[2 * y + 1]
                tree[y] = a if a < b else b
            if z != y:
                a, b = tree[2 * z], tree[2 * z + 1]
                tree[z] = a if a < b else b
            x, y, z = x >> 1, y >> 1, z >> 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class ByteBPE:
    """Encodes and decodes with one rank file and split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.pieces = Bounded(lambda p: self._packed(merge(p.encode(), self.ranks)), KEPT)
        self.chunks = Bounded(lambda c: b"".join(map(self.pieces.__getitem__, self.pattern.findall(c))), KEPT)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes() if len(ids) > 8 else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for; an id outside the vocabulary raises."""
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (binary) for every row.

    ``decoded`` is what the ids give back, read from the ids alone. Whole texts are encoded. Null and
    empty texts have no ids, a null id stays null, repeated rows each get a row, an empty table gives
    an empty one; other columns are not read. No shuffle; a lost task is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = helper(ByteBPE, ranks, pattern)
        for batch in slices(batches):
            ids = [own.encode(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([own.decode(x) for x in ids], pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    read = id_and_text(docs, id_col, text_col)
    return read.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
