"""Characters that every Unicode version and library treats alike, and the printable forms of bytes."""

from __future__ import annotations

import itertools
import re
import unicodedata


def plain_characters() -> str:
    """Characters whose NFC form is themselves in any context and whose classes no Unicode version changes."""
    points = [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2027), 0x20AC]
    return "".join(c for c in map(chr, points) if c not in "­İŉ" and unicodedata.normalize("NFC", c) == c)


def class_of(kind: str, characters: str) -> str:
    return "".join(re.escape(c) for c in characters if unicodedata.category(c)[0] == kind)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if Latin-1 prints it, else the next one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = itertools.count(256)
    return [chr(b) if b in set(printed) else chr(next(spare)) for b in range(256)]
