"""Token counts by heap-and-linked-list pair merging.

The lowest-rank adjacent pair of a piece is popped from a heap and merged in a linked list, again and
again; the count is the initial symbols minus the merges. No token id is ever looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import helper, id_and_text, slices, texts, utf8_bytes
from sievework.llm.word_pieces import Bounded, WordPieces, words

END_OF_WORD = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves,
    the others follow from U+0100 on, in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = (symbols[i], symbols[i + 1])
        rank = ranks.get(pair)
        if rank is not None:
            heap.append((rank, i, pair))
    heapify(heap)
    left = n
    while heap:
        _, i, (a, b) = heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            pair = (symbols[i], symbols[k])
            rank = ranks.get(pair)
            if rank is not None:
                heappush(heap, (rank, i, pair))
        h = before[i]
        if h >= 0:
            pair = (symbols[h], symbols[i])
            rank = ranks.get(pair)
            if rank is not None:
                heappush(heap, (rank, h, pair))
    return left


class TokenCounter:
    """Tokens of a text under a word-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        self.words = WordPieces(path)
        merges = self.words.spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        self.letters = dict(enumerate(byte_letters()))
        self.by_piece = Bounded(self._piece, 800_000)
        self.by_word = Bounded(self._word)

    def _piece(self, piece: str) -> int:
        symbols = list(piece.encode().decode("latin-1").translate(self.letters))
        symbols[-1] += END_OF_WORD
        return merged_length(symbols, self.ranks)

    def _word(self, word: str) -> int:
        return sum(1 if special else self.by_piece[p] for p, special in self.words.pieces(word))

    def count(self, text: str) -> int:
        return sum(map(self.by_word.__getitem__, words(text)))


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, in no order.

    Whole texts count, whatever their length. Null and empty texts have 0 bytes and 0 tokens, a null id
    stays null, repeated rows each get a row, an empty table gives an empty one; other columns are not
    read. Special token strings inside a text count as one token each. There is no shuffle: the work
    per task is bounded by its input split, and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = helper(TokenCounter, vocabulary).count
        for batch in slices(batches):
            n = [count(t) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    read = id_and_text(docs, id_col, text_col).withColumn("n_bytes", utf8_bytes("text"))
    counted = read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
