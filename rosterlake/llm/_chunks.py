"""Cutting texts where a tokenizer cannot merge across, so that equal chunks are encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A single space between two characters that no definition of white space covers.
CUT = re.compile(r" (?<=\S )(?=\S)")
CACHE = 300_000
STOPS = frozenset(".,;:!?")


def chunks(text: str) -> list[str]:
    """Pieces that join to text; each but the first starts with the space before a word."""
    first, *rest = CUT.split(text)
    return [first, *[" " + r for r in rest]]


class _Odd(Exception):
    """A space that is no safe place to cut."""


class ChunkEncoder(dict):
    """Encodes whole texts chunk by chunk; known chunks by the text behind their space.

    encode gets a chunk with its space and gives its ids as bytes. With lead, a space is put before
    every text that is not empty. Two generations of at most most chunks are kept, so that frequent
    ones stay known.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: bool = False, most: int = CACHE):
        super().__init__()
        self.encode, self.lead, self.most, self.old = encode, lead, most, {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        got = self.old.get(word)
        got = self[word] = self.encode(" " + word) if got is None else got
        return got

    def _any(self, word: str) -> bytes:
        """Also of a chunk that holds or ends in other white space; such are not kept."""
        try:
            return self[word]
        except _Odd:
            return self.encode(" " + word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        try:
            if self.lead:
                return b"".join(map(self.__getitem__, text.split(" ")))
            first, *rest = text.split(" ")
            if not first or first[-1].isspace():
                raise _Odd
            return self.encode(first) + b"".join(map(self.__getitem__, rest))
        except _Odd:
            first, *rest = CUT.split(" " + text if self.lead else text)
            return self.encode(first) + b"".join(map(self._any, rest))


def latin(word: str) -> bool:
    """Only letters, and none beyond the Latin blocks."""
    return word.isascii() and word.isalpha() or (word.isalpha() and max(word) < "ɐ")
