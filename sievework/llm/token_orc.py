"""Token ids in ORC files.

The files hold ``doc_id``, ``n_tokens``, ``first`` (ids before the document within its file) and
``ids`` in ascending doc_id order: ORC's integer run-length encoding packs the ids, stripes are read in
parallel, and row indexes and Bloom filters on ``doc_id`` let a look-up skip whole stripes and row
groups. Documents are dealt out by id ranges before they are tokenised, so only texts are shuffled, the
ids of a range go straight to its file, and a lost task writes its own file again.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import SLICE_ROWS, helper, id_and_text, slices, texts
from sievework.llm.word_pieces import WordPieces

SCHEMA = "doc_id long, n_tokens long, first long, ids array<int>"


#: Pieces kept per Python worker; a full table is emptied.
KEPT = 800_000
#: Pieces that the library encodes in one call; long calls take longer for each piece.
_CALL = 256
#: Bytes of text that are encoded at a time, unless one text alone has more.
SLICE_BYTES = 2 << 20


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``SLICE_BYTES`` of text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(cuts):
            yield from slices([batch.slice(start, end - start)], 16 * SLICE_ROWS)


class LibraryIds:
    """Ids as the tokenizers library gives them, asked once for each new piece."""

    def __init__(self, path: str) -> None:
        self.words = WordPieces(path)
        self.special = {p: i.to_bytes(4, "little") for p, i in self.words.special.items()}
        self.of_piece = dict(self.special)

    def _new(self, pieces: list[str]) -> Iterator[bytes]:
        """Pieces are told apart by blanks, which no piece holds, and by the library's word numbers."""
        for start in range(0, len(pieces), _CALL):
            some = pieces[start : start + _CALL]
            found = self.words.tokenizer.encode(" ".join(some), add_special_tokens=False)
            number = np.asarray(found.word_ids, np.int64)
            if len(np.unique(number)) != len(some):  # a piece that the library splits further
                for p in some:
                    ids = self.words.tokenizer.encode(p, add_special_tokens=False).ids
                    yield np.asarray(ids, "<u4").tobytes()
                continue
            ids = np.asarray(found.ids, "<u4").tobytes()
            cuts = (np.searchsorted(number, np.arange(len(some) + 1)) * 4).tolist()
            yield from (ids[a:b] for a, b in itertools.pairwise(cuts))

    def _packed(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces that differ from each other."""
        found = list(map(self.of_piece.get, pieces))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(self.of_piece) + len(new) > KEPT:
            self.of_piece = dict(self.special)
        names = [pieces[k] for k in new]
        for k, p, ids in zip(new, names, self._new(names), strict=True):
            found[k] = self.of_piece[p] = ids
        return found

    def _latin(self, many: list[bytes]) -> list[bytes]:
        """The ids of texts in lower-case Latin-1, whose pieces are found and told apart all at once."""
        letters = np.frombuffer(b"\n".join([*many, b"\n"]), np.uint8)
        first, size, data = self.words.latin_pieces(letters)
        # The pieces as one Arrow array, each different one looked up once.
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(names).to_numpy())]).tolist()
        joined = b"".join(names.to_numpy(zero_copy_only=False)).decode("latin-1")
        packed = self._packed([joined[a:b] for a, b in itertools.pairwise(ends)])
        # Every piece's ids in the order of the texts.
        n = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        of_piece, begins = n[which], (np.cumsum(n) - n)[which]
        ends = np.cumsum(of_piece)
        ids = np.frombuffer(b"".join(packed), "<u4")
        ids = ids[np.repeat(begins - (ends - of_piece), of_piece) + np.arange(of_piece.sum())].tobytes()
        lengths = np.fromiter(map(len, many), np.int64, len(many)) + 1
        cuts = np.searchsorted(first, np.concatenate([[0], np.cumsum(lengths)]))
        cuts = (np.concatenate([[0], ends])[cuts] * 4).tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def encode(self, many: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        latin = [self.words.latin(t) if self.words.has_runs else None for t in many]
        of_latin = iter(self._latin([t for t in latin if t is not None]))
        split = [self.words.text_pieces(t) for t, low in zip(many, latin, strict=True) if low is None]
        names = list(set().union(*split))
        get = dict(zip(names, self._packed(names), strict=True)).__getitem__
        of_other = (b"".join(map(get, ps)) for ps in split)
        return [next(of_other if low is None else of_latin) for low in latin]


def write_orc(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
) -> None:
    """Encode every whole text, append ``end_id`` and write the files below ``path``.

    Null and empty texts become the end id alone; rows without id come first; rows with equal ids follow
    each other in text order and each keep their own entry; an empty table writes a file without rows.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = helper(LibraryIds, vocabulary), end_id.to_bytes(4, "little")
        before = 0
        for batch in text_slices(batches):
            packed = own.encode(texts(batch, "text"))
            n = np.fromiter((len(p) // 4 + 1 for p in packed), np.int64, len(packed))
            ids = np.frombuffer(tail.join([*packed, b""]), "<i4")  # the end id after every document
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(before + offsets[:-1].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                ],
                ["doc_id", "n_tokens", "first", "ids"],
            )
            before += int(n.sum())

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_bytes))
        # ``first`` counts within a task, so a task has one file whatever the session allows a file to hold.
        .option("maxRecordsPerFile", 0)
        .option("compression", "snappy")  # the integer encoding has packed the ids already
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The entries of the files, or only those of some documents.

    The filter reaches the ORC reader, which drops stripes and row groups by their least and greatest id
    and by the Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids))


def file_name() -> Column:
    return F.col("_metadata.file_name")


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """The entries with ``start``: ids of all documents before, over all files.

    A file's total is one row, so the running total over files is a small table; within a file ``first``
    is already the answer.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    files = rows.groupBy(file_name().alias("file")).agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    # One row per file: a single short window, and a broadcast of as many rows as there are files.
    order = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    placed = rows.withColumn("file", file_name()).join(F.broadcast(offsets), "file")
    return placed.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")


def ids_crc32(entries: DataFrame) -> DataFrame:
    """``entries`` with ``ids_crc32`` instead of the ids: the unsigned CRC-32 of the ids' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(3)
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
            ends = np.cumsum(batch.column(2).to_numpy()) * 4
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return entries.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
