"""Splitting text into the pieces that the lower-casing word vocabulary encodes one by one.

The tokenizer normalises (NFC, white space to one blank, lower case), cuts the
text by a pattern and encodes each piece alone, so a piece's ids never depend
on its neighbours and white space separates texts exactly. Both users of this
module therefore work on words and remember what they found for each.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
_SPECIAL = re.compile("|".join(map(re.escape, SPECIAL)))
# Latin-1 without controls and white space: NFC leaves such text as it is.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+")
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def plain_pieces(word: str) -> list[str] | None:
    """Pieces of a word of plain Latin-1 characters, None for any other word."""
    if "\xad" in word or not _PLAIN.fullmatch(word):
        return None
    return _PIECE.findall(word.lower())


def special_parts(word: str) -> list[str]:
    """The word cut at the vocabulary's special strings, these included."""
    parts, at = [], 0
    for m in _SPECIAL.finditer(word):
        parts += [word[at : m.start()], m[0]]
        at = m.end()
    return [p for p in [*parts, word[at:]] if p]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind (1 letters, 2 numbers, 3 others, 0 for all that needs ``plain_pieces`` or the library) and lower case: of bytes, and of the second of two."""
    kind, low = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind2, low2 = np.zeros(128, np.uint8), np.arange(128, dtype=np.uint8) & 63 | 128
    for c in map(chr, range(0x21, 0x100)):
        if c not in "'\xad" and _PLAIN.fullmatch(c):
            x = c.lower()
            what = 1 if re.fullmatch(f"[{_LETTER}]", x) else 2 if re.fullmatch(f"[{_NUMBER}]", x) else 3
            if c.isascii():
                kind[ord(c)], low[ord(c)] = what, ord(x)
            else:
                kind2[ord(c) - 0x80], low2[ord(c) - 0x80] = what, x.encode()[1]
    return kind, low, kind2, low2


_KIND, _LOW, _KIND2, _LOW2 = _tables()


def cut_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, set[bytes]]:
    """The pieces of all words in a row, where each word's begin (and the end of the last's), and the words left whole.

    Words of plain Latin-1 without apostrophes are cut here, as ``plain_pieces``
    cuts them. Any other word is left as it is, for the caller to cut.
    """
    at = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind, low = _KIND[data], _LOW[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    after = data[np.minimum(lead + 1, len(data) - 1)]
    lead, after = lead[after >> 6 == 2], after[after >> 6 == 2]
    both = (data[lead] & 1) << 6 | after & 63
    kind[lead] = kind[lead + 1] = _KIND2[both]
    low[lead + 1] = _LOW2[both]
    first = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2) & (data[1:] >> 6 != 2))[: len(data)]
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    whole = np.unique(np.searchsorted(at, np.append(np.flatnonzero(kind == 0), special), side="right") - 1)
    if len(whole):
        inside = np.zeros(len(words), bool)
        inside[whole] = True
        inside = np.repeat(inside, np.diff(at))
        first &= ~inside
        low = np.where(inside, data, low)
    first[at[:-1][at[:-1] < len(data)]] = True
    starts = np.append(np.flatnonzero(first), len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low)])
    return pieces, np.append(0, np.cumsum(first))[at], set(words.take(pa.array(whole)).cast(pa.binary()).to_pylist())


class WordMemory(dict):
    """Remembers ``find(word)`` for words in two generations of ``most`` each, so memory is bounded and results are the same."""

    def __init__(self, find: Callable, most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.find(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def rare_collections() -> None:
    """The memories have no cycles, but Python would walk all of them again and again to look for some."""
    gc.set_threshold(200_000, 50, 1000)
