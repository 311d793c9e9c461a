"""Byte-level BPE ids by the tokenizers library, with a cache per worker of the pieces between spaces.

The pre-tokenizer of a byte-level vocabulary never joins what a single space between two other
characters divides, so a text's ids are those of its pieces, one after the other. Each distinct
piece goes through the library once while it stays in the cache.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import kept, only

#: ASCII signs, without the apostrophe that may begin a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_INNER = re.compile(r"(?<=\S) (?=\S)")


class _Uneven(Exception):
    """The piece touches other white space: its space is no border."""


def _byte_chars() -> dict[str, str]:
    """Byte (as Latin-1) to the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """piece behind a space -> its ids as little-endian bytes; `limit` bounds the cache."""

    def __init__(self, path: str, limit: int = 2_000_000):
        from tokenizers import Tokenizer

        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.table = str.maketrans(_byte_chars())
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tails: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.newline = self.whole("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str, lead: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(lead + mapped)]).tobytes()

    def _piece(self, piece: str, lead: str, known) -> bytes:
        """A piece without white space, behind a space (lead Ġ) or not; known: the cache of such words."""
        word = piece.rstrip(_SIGNS)
        if not (word.isalpha() and (word.isascii() or max(word) <= "ɏ")) or self.special_in(piece):
            return self.whole(" " + piece if lead else piece)
        if word == piece:
            return self._letters(word, lead)
        got, tail = known.get(word), piece[len(word) :]
        if tail not in self.tails:
            if len(self.tails) > 50_000:
                self.tails.clear()
            self.tails[tail] = self.whole(tail)
        if got is None:
            got = self._letters(word, lead)
            if len(word) <= 64:
                known[word] = got  # other signs may follow it elsewhere
        return got + self.tails[tail]

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        if "\n" in piece and not self.special_in(piece):
            first, *rest = piece.split("\n")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in (first, *rest)):
                return self[first] + b"".join(self.newline + self._bare(p) for p in rest)
            return self.whole(" " + piece)
        if len(self) >= self.limit:
            self.clear()
        got = self._piece(piece, "Ġ", self)
        if len(piece) <= 64:
            self[piece] = got
        return got

    def special_in(self, piece: str) -> bool:
        for s in self.special:
            if s in piece:
                return True
        return False

    def _bare(self, piece: str) -> bytes:
        got = self.bare.get(piece)
        if got is None:
            if len(self.bare) >= 100_000:
                self.bare.clear()
            got = self._piece(piece, "", self.bare)
            if len(piece) <= 64:
                self.bare[piece] = got
        return got

    def _line(self, line: str) -> bytes:
        """A text's line, or a text of one, that neither begins nor ends with white space."""
        first, *rest = line.split(" ")
        got = self.bare.get(first)
        if got is None:
            if not first or first[-1].isspace():
                raise _Uneven
            got = self._bare(first)
        return got + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            if "\n\n" not in text and not self.special_in(text):
                lines = text.split("\n")
                for x in lines:
                    if not x or x[0].isspace() or x[-1].isspace():
                        break
                else:
                    return self.newline.join(map(self._line, lines))
            pieces = text.split(" ")
            if pieces[0] and pieces[0][-1].isspace():
                raise _Uneven
            return self.whole(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))
        except _Uneven:
            pieces = _INNER.split(text)
            return self.whole(pieces[0]) + b"".join(self[p] if not (p[0].isspace() or p[-1].isspace()) else self.whole(" " + p) for p in pieces[1:])


_ENCODERS: dict[str, Encoder] = kept({})


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    only(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
