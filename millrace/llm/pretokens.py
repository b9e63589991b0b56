"""Cutting texts into pieces that a byte-level tokenizer treats independently.

A space with a non-space on both sides always starts a new match of the public
byte-level pattern, and no match crosses it. Texts are therefore cut there first
(cheap), and each distinct chunk is tokenized once per worker and remembered in a
table of bounded size; the bound changes speed only, never ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import regex

#: Distinct chunks remembered per worker; beyond it the older half is forgotten.
CACHE_CHUNKS = 200_000
#: Longer chunks (characters) are tokenized without being remembered.
CACHE_CHUNK_LEN = 64

_ODD_SPACE = regex.compile(r"^ | $| \s|\s ")
_PLAIN_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut before every space that stands between two non-spaces; joined, they give the text."""
    if not text:
        return []
    if _ODD_SPACE.search(text):
        parts, at = [], 0
        for m in _PLAIN_SPACE.finditer(text):
            parts.append(text[at:m.start()])
            at = m.start()
        parts.append(text[at:])
        return parts
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


class ChunkCache(dict):
    """chunk -> ids, filled on demand; two generations bound its size."""

    def __init__(self, encode: Callable[[str], Sequence[int]], most: int = CACHE_CHUNKS):
        super().__init__()
        self._encode, self._most, self._old = encode, most, {}

    def __missing__(self, chunk: str) -> Sequence[int]:
        ids = self._old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        if len(chunk) <= CACHE_CHUNK_LEN:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()  # the same object stays in use by its callers
            self[chunk] = ids
        return ids
