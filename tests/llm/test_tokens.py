"""Token counts, byte-level BPE and ORC output against the libraries, and ORC metadata."""

from __future__ import annotations

import base64
import glob
import hashlib
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_texts import ODD_TEXTS
from tokenizers import Tokenizer

from sievework.llm import byte_bpe, queries, token_count, token_orc, word_pieces
from sievework.session import scratch_path

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(queries.WORD_BPE)
RANKS = {
    base64.b64decode(a): int(b) for a, b in (line.split() for line in open(queries.BYTE_RANKS, "rb") if line.strip())
}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = token_count.TokenCounter(queries.WORD_BPE)
LIBRARY_IDS = token_orc.LibraryIds(queries.WORD_BPE)
CODER = byte_bpe.ByteBPE(queries.BYTE_RANKS, public_tokenizers.PATTERN)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_libraries(text):
    assert COUNTER.count(text) == len(library_ids(text))
    assert LIBRARY_IDS.encode([text]) == [packed(library_ids(text))]
    assert CODER.encode(text) == packed(TIKTOKEN.encode_ordinary(text))
    assert CODER.decode(CODER.encode(text)) == text.encode()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("'stmdrevlLESaé\xc9\xb5\xdf 1½.!-<|\n\x1c\x85\xa0\u0301\u212a\u0130", max_size=24), max_size=6))
def test_texts_at_once_like_the_library(many):
    """Contractions, odd blanks and letters whose lower case is in another alphabet, next to other texts."""
    assert LIBRARY_IDS.encode(many) == [packed(library_ids(t)) for t in many]


def test_ids_with_a_table_that_is_emptied(monkeypatch):
    monkeypatch.setattr(token_orc, "KEPT", 5)
    own = token_orc.LibraryIds(queries.WORD_BPE)
    many = ["it's one two three four five six", "<|endoftext|> seven", "日本 eight", "it's one <|endoftext|>"]
    for _ in range(2):
        assert own.encode(many) == [packed(library_ids(t)) for t in many]


def test_ids_are_looked_up_once_for_each_different_piece():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own = token_orc.LibraryIds(queries.WORD_BPE)
    own.of_piece = Counted(own.of_piece)
    own.encode(["many words, "] * 1_000)
    assert own.of_piece.asked <= 10


def test_slices_hold_few_bytes_and_all_rows():
    long = token_orc.SLICE_BYTES // 3
    rows = ["x" * long, None, "", "y" * long, "z" * (4 * long), "a", "b" * long, *["c"] * 9_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})
    cut = [b.column(1).to_pylist() for b in token_orc.text_slices([batch, batch.slice(0, 0)])]
    assert sum(cut, []) == rows
    assert all(sum(len(t or "") for t in c) <= 2 * token_orc.SLICE_BYTES and len(c) <= 4096 for c in cut)


@given(st.text("ab", min_size=1, max_size=40))
def test_merges_of_a_small_vocabulary_like_trying_all_pairs(word):
    order = ["aa", "ab", "aab", "ba", "abab", "bb"]
    splits = {"aa": ("a", "a"), "ab": ("a", "b"), "aab": ("aa", "b"), "ba": ("b", "a"), "abab": ("ab", "ab"), "bb": ("b", "b")}
    ranks = {splits[m]: r for r, m in enumerate(order)}
    symbols = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not found:
            break
        i = min(found)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
    assert token_count.merged_length(list(word), ranks) == len(symbols)


def test_bounded_table_forgets_and_stays_right():
    table = word_pieces.Bounded(len, 3)
    assert [table["x" * n] for n in (1, 2, 3, 4, 2, 1)] == [1, 2, 3, 4, 2, 1]
    assert len(table) <= 3


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    got = token_count.count_tokens(odd_docs, queries.WORD_BPE, limit=2048).collect()
    want = [
        (i, len((t or "").encode()), n := len(library_ids(t)), n > 2048) for i, t in ODD_TEXTS
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_count.count_tokens(no_docs, queries.WORD_BPE).count() == 0


def test_byte_bpe_of_odd_rows(odd_docs, no_docs):
    got = byte_bpe.encode(odd_docs, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, TIKTOKEN.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD_TEXTS]
    assert sorted(str((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids)), bytes(r.decoded))) for r in got) == sorted(
        map(str, want)
    )
    assert byte_bpe.encode(no_docs, queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_orc_of_odd_rows(spark, odd_docs, no_docs):
    path = scratch_path(spark, "test-orc")
    token_orc.write_orc(odd_docs, path, queries.WORD_BPE)
    rows = token_orc.with_start(spark, path).orderBy("start").collect()
    ordered = sorted(ODD_TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (i, t) in zip(rows, ordered, strict=True):
        ids = [*library_ids(t), 1]
        assert (row.doc_id, row.start, row.n_tokens, list(row.ids)) == (i, start, len(ids), ids)
        start += len(ids)
    empty = scratch_path(spark, "test-orc")
    token_orc.write_orc(no_docs, empty, queries.WORD_BPE)
    assert token_orc.ids_crc32(token_orc.with_start(spark, empty)).count() == 0


def test_starts_where_the_session_limits_the_rows_of_a_file(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7)) for i in range(40)], "doc_id long, text string").repartition(3)
    path = scratch_path(spark, "many-files")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        token_orc.write_orc(docs, path, queries.WORD_BPE)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = sorted(token_orc.with_start(spark, path).select("doc_id", "start", "n_tokens").collect())
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]


def test_orc_files_have_stripes_and_prune_by_id(spark):
    path = scratch_path(spark, "test-orc")
    docs = queries.table(spark, SF, "documents")
    token_orc.write_orc(docs, path, queries.WORD_BPE, stripe_bytes=64 << 10)
    files = glob.glob(f"{path}/part-*.orc")
    assert sum(pyarrow.orc.ORCFile(f).nstripes for f in files) >= 1
    some = token_orc.read_orc(spark, path, [3, 17])
    assert sorted(r.doc_id for r in some.select("doc_id").collect()) == [3, 17]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_queries_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(library_ids(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
    coded = queries.op4_byte_bpe(spark, SF).collect()
    assert len(coded) == len(docs)
    for r in coded:
        ids = packed(TIKTOKEN.encode_ordinary(docs[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    rows = {r.doc_id: r for r in queries.op9_token_orc(spark, SF).collect()}
    start = 0
    for i in sorted(docs):
        ids = [*library_ids(docs[i]), 1]
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)


def test_decoding_an_unknown_id_raises():
    with pytest.raises(IndexError):
        CODER.decode(packed([10**6]))
