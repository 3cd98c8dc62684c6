"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regidx.llm.arrow_rows import append_columns
from regidx.llm.common import replaced
from regidx.llm.plain_text import byte_characters, class_of, plain_characters

#: Tier one: so many frequent pre-tokens of so many documents at most; a cache, no result depends on it.
SAMPLE_DOCUMENTS, FREQUENT = 2_000, 20_000
#: Tier two: pre-tokens of each task's cache before it starts anew.
CACHE = 400_000


class TokenCounter:
    """Counts as ``tokenizers`` gives them for a lower-casing word-level BPE file.

    Texts of plain characters are cut here and counted word by word through the cache;
    all others (and those that may hold a special token's string) go to the library whole.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        plain = plain_characters()
        letters, numbers = class_of("L", plain.lower() + plain), class_of("N", plain)
        self.odd = re.compile(f"[^{re.escape(plain)}]|<\\|").search
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        self.characters = dict(enumerate(byte_characters()))
        self.frequent = frequent or {}
        self.lengths = dict(self.frequent)
        self.cache = cache

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> int:
        return len(self.library.model.tokenize(word.encode().decode("latin-1").translate(self.characters)))

    def words(self, text: str | None) -> list[str] | None:
        if not text:
            return []
        return None if self.odd(text) else self.cut(text.lower())

    def count(self, texts: list[str | None]) -> list[int]:
        cuts = [self.words(text) for text in texts]
        words = set().union(*(cut for cut in cuts if cut))
        new = [word for word in words if word not in self.lengths]
        if new and len(self.lengths) + len(new) > self.cache:
            self.lengths = dict(self.frequent)
            new = [word for word in words if word not in self.lengths]
        self.lengths.update((word, self.word(word)) for word in new)
        length = self.lengths.__getitem__
        return [self.whole(t) if cut is None else sum(map(length, cut)) for t, cut in zip(texts, cuts, strict=True)]


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample, for broadcast."""

    def tally(batches):
        counter = TokenCounter(path)
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(counter.words(value) or ())
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()),
             pa.array([counter.word(w) for w, _ in top], pa.int32())],
            names=["word", "n", "tokens"],
        )

    sample = docs.select(F.col(text).cast("string")).limit(SAMPLE_DOCUMENTS)
    found = sample.mapInArrow(tally, "word string, n long, tokens int").groupBy("word").agg(
        F.sum("n").alias("n"), F.max("tokens").alias("tokens")
    )
    return {r.word: r.tokens for r in found.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}


def count_tokens(
    docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 2048
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Special tokens' strings inside a text
    count as the library's default counts them; none are added. Every row keeps its other
    columns, repeated rows are counted each; columns named like the new ones are replaced.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = replaced(docs, "n_bytes", "over_limit")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text))

    def make():
        counter = TokenCounter(path, shared.value)
        return lambda texts: [pa.array(counter.count(texts), pa.int64())]

    counted = append_columns(docs, text, [T.StructField("n_tokens", T.LongType())], make)
    return counted.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
            "over_limit": F.col("n_tokens") > limit,
        }
    )
