"""Words of a text as a word-level BPE vocabulary file sees them.

The file's normaliser collapses white space and its split pattern never crosses white space, so the
pieces of a text are the pieces of its white-space separated words. Words repeat, so whatever is
found out about a word is kept in a bounded table per Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer

from sievework.llm.common import WHITE

#: Words kept per worker; a full table is emptied, so memory stays bounded whatever the corpus.
KEPT_WORDS = 800_000

#: Below this code point case folding and letter classes are the same in every Unicode version.
_PLAIN_BELOW = "ɐ"

#: The split pattern whose pieces ``latin_pieces`` finds for many texts at once.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_WORD = re.compile(f"[^{WHITE}]+")


def words(text: str) -> list[str]:
    """White-space separated words, by Unicode's white space (Python's own has four more)."""
    for c in _ODD:
        if c in text:
            return _WORD.findall(text)
    return text.split()


class Bounded(dict):
    """Values by key, computed when missing, emptied when full."""

    def __init__(self, value: Callable, most: int = KEPT_WORDS) -> None:
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.value(key)
        return found


class WordPieces:
    """Splits words into normalised pieces and special tokens, as the vocabulary file prescribes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"] if t["special"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        splits = self.spec["pre_tokenizer"]["pretokenizers"]
        split = next(s["pattern"]["Regex"] for s in splits if s["type"] == "Split")
        self._pattern = regex.compile(split)
        self.has_runs = split == _RUNS
        self._kind = np.full(256, _OTHER, np.uint8)
        # The same pattern over Latin-1, where the classes are short enough for the faster module.
        for name, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK)):
            found = [chr(c) for c in range(256) if regex.match(f"[{name}]", chr(c))]
            self._kind[list(map(ord, found))] = kind
            split = split.replace(name, re.escape("".join(found)))
        self._latin = re.compile(split)

    def latin(self, text: str) -> bytes | None:
        """The lower-case text in Latin-1; None if it has other letters or special tokens."""
        if self._special is not None and "<" in text and self._special.search(text):
            return None
        try:  # lower case of Latin-1 is Latin-1, but other letters have lower cases in it too
            text.encode("latin-1")
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def latin_pieces(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case Latin-1 that ends in two blanks: where its pieces start, their sizes, and all their letters.

        A piece starts where the kind of letter changes and at every number. An apostrophe that starts a
        piece takes the ending of a contraction with it; what follows is a piece again.
        """
        kind = self._kind[letters]
        starts = kind == _NUMBER
        starts[:1] = True
        starts[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(starts & (letters == ord("'")))
        a, b = letters[at + 1], letters[at + 2]
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        ending = short + 2 * long
        at, ending = at[ending > 0], ending[ending > 0]
        starts[at + 1] = False
        starts[at + 1 + ending] = True
        first = np.flatnonzero(starts)
        size = np.diff(first, append=len(letters))
        some = kind[first] != _BLANK
        return first[some], size[some], letters[kind != _BLANK]

    def text_pieces(self, text: str) -> list[str]:
        """Pieces of a whole text, special tokens as their own text."""
        low = self.latin(text)
        if low is not None:  # Latin-1 is its own normal form, and no white space is part of a piece
            return self._latin.findall(low.decode("latin-1"))
        return [p for w in words(text) for p, _ in self.pieces(w)]

    def pieces(self, word: str) -> list[tuple[str, bool]]:
        """(piece, is it a special token) in order."""
        if self._special is None or "<" not in word or not self._special.search(word):
            return [(p, False) for p in self.plain(word)]
        found, at = [], 0
        for m in self._special.finditer(word):
            found += [(p, False) for p in self.plain(word[at : m.start()])]
            found.append((m[0], True))
            at = m.end()
        return found + [(p, False) for p in self.plain(word[at:])]

    def plain(self, word: str) -> list[str]:
        """Pieces of a word without special tokens."""
        if not word:
            return []
        low = word.lower()
        # Below the bound a text is its own normal form, and lower case goes letter by letter.
        if not word.isascii() and (max(word) >= _PLAIN_BELOW or max(low) >= _PLAIN_BELOW):
            low = self.tokenizer.normalizer.normalize_str(word)
            return [low[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]
        if low.isalpha():
            return [low]
        return self._pattern.findall(low)
