"""The items of JSON arrays, read as a stream.

A document is decoded piece by piece and its items are handed on one by one, so a file of any size takes no more
memory than its largest item. Whatever is not an item of an array (a value of the enclosing object, say) is one value.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

PIECE = 1 << 18
#: Characters of one item at most; more is an error.
MOST_CHARS = 16 << 20
_SPACE = " \t\n\r"


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


class Part(NamedTuple):
    """An item of an array (``index`` from 0), or a value that is an empty array or none (``index`` None)."""

    key: str | None
    turn: int
    index: int | None
    text: str
    value: object


class _Text:
    """A buffer over a byte stream that forgets what has been taken."""

    def __init__(self, stream: BinaryIO, most_chars: int, errors: str = "replace") -> None:
        self.stream, self.most_chars = stream, most_chars
        self.decode = json.JSONDecoder(parse_constant=_no_constant).raw_decode  # one of the module could not be shipped
        self.decoder = codecs.getincrementaldecoder("utf-8-sig")(errors=errors)
        self.held, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads on, by as much as is still held, so that a long item is tried a few times only."""
        if self.ended:
            return False
        left = self.held[self.at :]
        if len(left) > self.most_chars:
            raise ValueError(f"not valid JSON, or an item of more than {self.most_chars} characters")
        raw = self.stream.read(max(PIECE, len(left)))
        self.ended = not raw
        self.held, self.at = left + self.decoder.decode(raw, final=self.ended), 0
        return True

    def peek(self) -> str:
        """The next character that is no space; empty at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.held) or not self.more():
                return self.held[self.at : self.at + 1]

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"not valid JSON: {found or 'the end'!r} in place of one of {wanted!r}")
        self.at += 1
        return found

    def value(self) -> tuple[str, object]:
        """The next value, as text and decoded. A number at the rim of the buffer may go on."""
        self.peek()
        while True:
            try:
                value, end = self.decode(self.held, self.at)
                if self.ended or self.held[end : end + 1] not in ("", ".", "e", "E"):
                    text, self.at = self.held[self.at : end], end
                    return text, value
            except ValueError:
                if self.ended:
                    raise ValueError("not valid JSON") from None
            self.more()


def _array(text: _Text, key: str | None, turn: int) -> Iterator[Part]:
    text.take("[")
    index = 0
    if text.peek() == "]":
        text.take("]")
        yield Part(key, turn, None, "[]", [])
        return
    while True:
        yield Part(key, turn, index, *text.value())
        index += 1
        if text.take(",]") == "]":
            return


def _parts_of(text: _Text, key: str | None, turn: int) -> Iterator[Part]:
    if text.peek() == "[":
        yield from _array(text, key, turn)
    else:
        yield Part(key, turn, None, *text.value())


def parts(stream: BinaryIO, most_chars: int = MOST_CHARS, errors: str = "replace") -> Iterator[Part]:
    """Items of a document that is an array, else the items and values below an object's keys, else the one value.

    ``turn`` counts the object's members. A text of spaces has no parts, any other document one at least. Whatever is no JSON document is a ValueError,
    raised when the stream gets there; so is a byte after the document and an item of over ``most_chars`` characters.
    """
    text = _Text(stream, most_chars, errors)
    first = text.peek()
    if not first:
        return
    if first != "{":
        yield from _parts_of(text, None, 0)
    else:
        text.take("{")
        turn = 0
        if text.peek() == "}":
            text.take("}")
            yield Part(None, 0, None, "{}", {})
        else:
            while True:
                if text.peek() != '"':
                    raise ValueError("not valid JSON: a key must be a string")
                _, key = text.value()
                text.take(":")
                yield from _parts_of(text, key, turn)
                turn += 1
                if text.take(",}") == "}":
                    break
    if text.peek():
        raise ValueError("not valid JSON: text after the document")


def payload_turn(stream: BinaryIO, keys: tuple[str, ...]) -> int | None:
    """Which member of the outer object has the payload: the first of ``keys`` that is not empty; None if there is none.

    Of repeated keys the last counts, as for JSON readers in general.
    """
    filled: dict[str, tuple[int, bool]] = {}
    for part in parts(stream):
        if part.key in keys:
            filled[part.key] = (part.turn, part.index is not None or bool(part.value))
    return next((filled[key][0] for key in keys if filled.get(key, (0, False))[1]), None)


def items(open_stream, keys: tuple[str, ...]) -> Iterator[tuple[int, str]]:
    """(place, text) of the items of the document's payload; ``open_stream`` opens it, twice for an object.

    The payload is the array itself, or the first of ``keys`` with a value that is not empty, if that is an array.
    """
    with open_stream() as stream:
        wrapped = _Text(stream, MOST_CHARS).peek() == "{"
    turn = 0
    if wrapped:
        with open_stream() as stream:
            turn = payload_turn(stream, keys)
    with open_stream() as stream:
        for part in parts(stream):
            if part.turn == turn and part.index is not None:
                yield part.index, part.text
