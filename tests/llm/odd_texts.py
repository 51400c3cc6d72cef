"""Inputs that every operator on documents must stand."""

from __future__ import annotations

#: Texts that every operator on documents must stand: null, empty, blank, odd white space, other scripts,
#: one very long word, a very long text, and rows that occur twice.
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "plain words of an ordinary text, with 42 numbers and it's done."),
    (4, "plain words of an ordinary text, with 42 numbers and it's done."),
    (5, "ΣΑΣ İstanbul 日本語 😀 é é ½ a\x1cb\x85c\xa0d e"),
    (6, "x" * 50_000),
    (7, "the quick brown fox jumps over the lazy dog. " * 3_000),
    (8, "<|endoftext|> a<|startoftext|>b <|endof"),
    (None, "a text without an id"),
    (-9, "plain words of an ordinary text, with 42 numbers and it's done."),
]
