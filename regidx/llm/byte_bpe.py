"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import itertools
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.llm.arrow_rows import append_columns
from regidx.llm.plain_text import byte_characters, class_of, plain_characters

#: Pre-tokens of each task's cache before it starts anew.
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece i is the i-th token in byte characters, scored -rank; identity normalisation."""
    characters = byte_characters()
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(characters[b] for b in token).encode()
        pieces.append(_field(1, _field(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2)))
    trainer = _field(2, _flag(3, 2) + _flag(4, len(pieces)) + _flag(40, len(pieces) - 1)
                     + b"".join(_varint(n << 3) + _varint(2**64 - 1) for n in (41, 42, 43)))
    normalizer = _field(3, _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return b"".join(pieces) + trainer + normalizer


class ByteBpe:
    """Encodes each match of the pattern by itself and decodes ids back to bytes."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.order = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.rank_of = np.array(sorted(ranks.values()), np.int32)
        self.bytes_of = dict(zip(self.rank_of.tolist(), self.order, strict=True))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.characters = dict(enumerate(byte_characters()))
        white = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut_any = regex.compile(white).findall
        plain = plain_characters()
        self.odd = re.compile(f"[^{re.escape(plain)}]").search
        self.cut_plain = _plain_cutter(pattern, plain)
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache, as bytes of int32."""
        new = [piece for piece in pieces if piece not in self.known]
        if new and len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = list(pieces)
        mapped = [piece.encode().decode("latin-1").translate(self.characters) for piece in new]
        for piece, ids in zip(new, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            self.known[piece] = self.rank_of[ids].tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cuts = [(self.cut_any if self.odd(t) else self.cut_plain)(t) if t else [] for t in texts]
        self.learn(set().union(*cuts))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, cut)), np.int32) for cut in cuts]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _plain_cutter(pattern: str, plain: str):
    """The pattern for the standard library: its classes spelled out, for texts of plain characters."""
    letters, numbers = class_of("L", plain), class_of("N", plain)
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]")
    return re.compile(inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall


def encode_documents(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text"
) -> DataFrame:
    """``docs`` with ids (array<int>) and decoded (binary, from the ids).

    Null and empty texts have no ids and no bytes. Every row keeps its other columns,
    repeated rows are encoded each; columns named like the new ones are replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def make():
        coder = ByteBpe(path, pattern)

        def columns(texts):
            found = coder.encode(texts)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            return [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                pa.array((coder.decode(ids.tolist()) for ids in found), pa.binary()),
            ]

        return columns

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return append_columns(docs, text, fields, make, rows=256)


def digest(coded: DataFrame, doc_id: str = "doc_id", *more: str) -> DataFrame:
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select(
        doc_id,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
