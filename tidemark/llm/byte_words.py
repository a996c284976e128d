"""Words in the alphabet of byte-level vocabularies."""

from __future__ import annotations


def _alphabet() -> list[str]:
    """A visible character per byte: itself where it has one, else the next free one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in seen else next(free)) for b in range(256)]


ALPHABET = _alphabet()
SPACE = ALPHABET[32]


def spelled(word: str) -> str:
    """A word without white space as byte-level models see it."""
    return word if word.isascii() else "".join([ALPHABET[b] for b in word.encode()])
