"""Benchmark passages in documents, re-parameterised ones included.

Words become canonical: numbers, capitalised words and units turn into typed slots, the others into lower
case. Windows of canonical words are hashed and joined with the windows of the benchmark items, and along
each alignment of a document with an item the slot values must map one to one, so a question with other
numbers or names is caught and a chance sequence of slots is not. The same is done without slots, all
words in lower case, so that a copy in other capitals is caught as well.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import helper, slices, texts
from sievework.llm.word_pieces import Bounded
from sievework.session import materialize

#: Words of a window; shorter items are one window of their own length.
WINDOW = 8
#: Words of an item that a document must hold on consistent alignments; all words of shorter items.
LEAST_WORDS = 13
#: Of the words of a window so many may be slots, in halves.
MOST_SLOTS = WINDOW // 2
#: Bits of the filter that windows of documents pass before they are joined: 2**24, 2 MB whatever the benchmark.
FILTER_BITS = 24

#: Units of measure that count as slots (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms hz kb mb gb tb "
    "usd eur gbp percent dollars euros cents meters metres miles hours minutes seconds days weeks months years"
).split()

_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
_WORD = regex.compile(_NUMBER + r"|[\p{L}\p{M}]+")
#: The same over Latin-1, which the faster module can do.
_LATIN = re.compile(f"{_NUMBER}|[{''.join(c for c in map(chr, range(256)) if c.isalpha())}]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = struct.Struct("<QQ").pack
_SLOT = {"num": b"<num>", "name": b"<name>", "unit": b"<unit>"}


def slot_of(word: str) -> str | None:
    """The type of slot that a word is, None for a plain one."""
    if word[0].isascii() and word[0].isdigit():
        return "num"
    if word.lower() in _UNITS:
        return "unit"
    return "name" if word[0].isupper() and not (len(word) > 1 and word.isupper()) else None


_UNITS = frozenset(UNITS)


def split(text: str) -> list[str]:
    """Numbers and words of a text, without marks."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN.findall(text)


class Canon:
    """Hashes of words, found out once per word."""

    def __init__(self) -> None:
        #: 16 bytes: hash of the canonical word, whose lowest bit tells a slot, and of the lower-case word.
        self.hashes = Bounded(self._word, 500_000)

    @staticmethod
    def _word(word: str) -> bytes:
        kind = slot_of(word)
        plain = xxhash.xxh64_intdigest(word.lower()) & ~1
        canonical = plain if kind is None else xxhash.xxh64_intdigest(_SLOT[kind]) | 1
        return _PAIR(canonical, plain)


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` word hashes."""
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = (total * _STEP) ^ h[k : k + n]
        total ^= total >> np.uint64(29)
    return total


def _windows(
    many: list[str], widths: list[int]
) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, with slots, text number, position, hash, has it a slot): windows with enough plain words, and all in
    lower case."""
    get = helper(Canon).hashes.__getitem__
    packed = [b"".join(map(get, split(t))) for t in many]
    both = np.frombuffer(b"".join(packed), "<u8").reshape(-1, 2)
    h, plain = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    slot = (h & np.uint64(1)).astype(np.int64)
    n = np.fromiter((len(p) // 16 for p in packed), np.int64, len(packed))
    text = np.repeat(np.arange(len(many)), n)
    start = np.repeat(np.cumsum(n) - n, n)
    before = np.concatenate([[0], np.cumsum(slot)])
    for width in widths:
        if len(h) < width:
            continue
        last = len(h) - width + 1
        whole = text[:last] == text[width - 1 :]
        slots = before[width : width + last] - before[:last]
        at = np.flatnonzero(whole & (slots * 2 <= width))
        yield width, True, text[at], at - start[at], _window_hashes(h, width)[at], slots[at] > 0
        at = np.flatnonzero(whole)
        yield width, False, text[at], at - start[at], ~_window_hashes(plain, width)[at], np.zeros(len(at), bool)


def _first(
    text_no: np.ndarray, at: np.ndarray, h: np.ndarray, slot: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows with slots, and of equal ones without only the first, so that these meet an item once.

    Slots make the difference along an alignment: a variant of a passage may be consistent where others are not.
    """
    order = np.lexsort((at, h, text_no))
    t, w = text_no[order], h[order]
    new = slot[order]
    new[:1] = True
    new[1:] |= (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    kept = np.sort(order[new])
    return text_no[kept], at[kept], h[kept]


def _covered(text_no: np.ndarray, at: np.ndarray, width: int) -> dict[int, int]:
    """Words of each text that lie in at least one of its windows."""
    places = np.unique(np.stack([np.repeat(text_no, width), (at[:, None] + np.arange(width)).ravel()]), axis=1)
    found, n = np.unique(places[0], return_counts=True)
    return dict(zip(found.tolist(), n.tolist(), strict=True))


def _slot_values(text: str) -> list[str | None]:
    """``type:value`` for each canonical word that is a slot."""
    found = []
    for w in split(text):
        kind = slot_of(w)
        found.append(f"{kind}:{w.lower()}" if kind else None)
    return found


def _rows(
    key: pa.Array, text_no: np.ndarray, at: np.ndarray, h: np.ndarray, width: int, slotted: bool, values: list | dict
) -> pa.RecordBatch:
    places = zip(text_no.tolist(), at.tolist(), strict=True)
    slots = [[v for v in values[t][p : p + width] if v] if slotted else [] for t, p in places]
    return pa.RecordBatch.from_arrays(
        [
            key.take(pa.array(text_no)),
            pa.array(at, pa.int64()),
            pa.array(h.view(np.int64)),
            pa.array([slotted] * len(at), pa.bool_()),
            pa.array(slots, pa.list_(pa.string())),
        ],
        ["key", "at", "hash", "slotted", "slots"],
    )


_ROW = "key long, at long, hash long, slotted boolean, slots array<string>"


def item_windows(
    benchmark: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """item_id, at, hash, slotted, slots, n_words, need, need_slotted of every window of every item; of equal ones
    without slots the first.

    ``need`` is how many words a document must hold: all if the item is short or repeats itself.
    ``need_slotted`` is how many if only windows with slots told apart count: at most those that they cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            many = texts(batch, "text")
            values = [_slot_values(t) for t in many]
            short = {len(v) for v in values if 0 < len(v) < WINDOW}
            found, need, told = [], {}, {}
            for width, slotted, text_no, at, h, slot in _windows(many, [*sorted(short), WINDOW]):
                lengths = np.array([len(values[t]) for t in text_no], np.int64)
                mine = lengths == width if width < WINDOW else lengths >= WINDOW
                text_no, at, h = _first(text_no[mine], at[mine], h[mine], slot[mine])
                lengths = np.array([len(values[t]) for t in text_no], np.int64)
                if slotted:
                    told |= _covered(text_no, at, width)
                else:
                    need.update({t: min(len(values[t]), least_words, n) for t, n in _covered(text_no, at, width).items()})
                rows = _rows(batch.column(0), text_no, at, h, width, slotted, values)
                found.append((rows.append_column("n_words", pa.array(lengths)), text_no))
            for rows, text_no in found:
                least = [need[t] for t in text_no.tolist()]
                slotted = [min(need[t], told.get(t, need[t])) for t in text_no.tolist()]
                rows = rows.append_column("need", pa.array(least, pa.int64()))
                yield rows.append_column("need_slotted", pa.array(slotted, pa.int64()))

    read = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, _ROW + ", n_words long, need long, need_slotted long").withColumnRenamed("key", "item_id")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least_words: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, words, item_words, slots, changed_slots: one row per document and item it holds.

    A document holds an item if windows that cover ``least_words`` of its words (all of a shorter item) align
    with it (of equal windows of a text the first counts, so ``words`` of an item that repeats itself are
    those of its different windows) and the slot values along each alignment map one to one; ``changed_slots`` counts the values that
    differ. Whole texts are searched. Null and empty texts and items hold nothing; windows that are mostly
    slots cannot be told from chance and count only word by word, so where the others cover fewer words of an
    item than needed, all that these cover will do; repeated rows with one id are one
    document, a null id is reported as null; empty tables give an empty one; other columns are not read.

    Only windows that pass a filter of fixed size leave a task, and they are joined by hash with the
    benchmark's windows.
    """
    spark = docs.sparkSession
    items = materialize(item_windows(benchmark, least_words), "benchmark-windows")
    widths = sorted(
        r[0] for r in items.select(F.least(F.col("n_words"), F.lit(WINDOW))).distinct().collect()
    )  # at most WINDOW values
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    # At most 2**FILTER_BITS different values, however large the benchmark is.
    taken = items.select(place.alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[taken] = True
    passing = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = np.frombuffer(passing.value, np.uint8)
        for batch in slices(batches):
            many = texts(batch, "text")
            values: dict[int, list] = {}
            for width, slotted, text_no, at, h, slot in _windows(many, widths):
                p = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((passed[p >> 3] >> (p & 7).astype(np.uint8)) & 1)
                if hit.size:
                    no, first, same = _first(text_no[hit], at[hit], h[hit], slot[hit])
                    for t in np.unique(no).tolist() if slotted else ():
                        values.setdefault(t, _slot_values(many[t]))
                    yield _rows(batch.column(0), no, first, same, width, slotted, values)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = read.mapInArrow(run, _ROW).withColumnsRenamed({"key": "doc_id", "at": "doc_at", "slots": "doc_slots"})
    pairs = F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc"))
    joined = hits.join(items, ["hash", "slotted"]).where(F.size("slots") == F.size("doc_slots"))
    # One row per alignment; an item's length bounds what a group can hold.
    shift = (F.col("doc_at") - F.col("at")).alias("shift")
    item = ["doc_id", "item_id", "n_words", "need", "need_slotted"]
    aligned = joined.groupBy(*item, "slotted", shift).agg(
        F.collect_set("at").alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.col("pairs.item")))) & (
        F.size("pairs") == F.size(F.array_distinct(F.col("pairs.doc")))
    )
    width = F.least(F.col("n_words"), F.lit(WINDOW))
    changed = F.size(F.filter("pairs", lambda p: p["item"] != p["doc"]))

    def covered(windows: Column) -> Column:
        """How many of the item's words lie in at least one of the windows."""
        words = F.transform(F.array_distinct(F.flatten(windows)), lambda at: F.sequence(at, at + F.first(width) - 1))
        return F.size(F.array_distinct(F.flatten(words))).cast("long")

    held = (
        aligned.where(one_to_one)
        .groupBy(*item)
        .agg(
            covered(F.collect_set("windows")).alias("words"),
            covered(F.collect_set(F.when(F.col("slotted"), F.col("windows")))).alias("told"),
            F.max(F.size("pairs")).cast("long").alias("slots"),
            F.max(changed).cast("long").alias("changed_slots"),
        )
    )
    return held.where("words >= need OR told >= need_slotted").select(
        "doc_id", "item_id", "words", F.col("n_words").alias("item_words"), "slots", "changed_slots"
    )
