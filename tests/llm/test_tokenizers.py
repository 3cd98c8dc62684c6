import random

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from regidx.llm.byte_bpe import ByteBpe, encode_documents, read_ranks
from regidx.llm.plain_text import plain_characters
from regidx.llm.token_counts import TokenCounter, count_tokens

ODD = [*map(chr, range(0x180)), *map(chr, range(0x2000, 0x2060)), "　", "中", "😀", "́", "Ω", "٣", "İ", "ẞ", "'s", "'ll", "'RE",
       "  ", "\n\n", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "ﬁ", "K", "Å", "\x1c", "\x85", "\xa0", "\r\n"]
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts(n):
    rng = random.Random(7)
    plain = plain_characters() + "     ''''smtd\n\n"
    mixed = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(n)]
    return mixed + ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(n)] + ["a" * 100_000, " " * 5000 + "b"]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_counter_equals_library():
    library = Tokenizer.from_file(WORDS)
    given = texts(2000)
    assert TokenCounter(WORDS, {"a": 1}, cache=500).count(given) == [
        len(library.encode(t, add_special_tokens=False).ids) for t in given
    ]


def test_bpe_equals_library_and_decodes():
    coder, library, given = ByteBpe(RANKS, public_tokenizers.PATTERN, cache=500), reference(), texts(2000)
    for start in range(0, len(given), 100):
        part = given[start : start + 100]
        for text, ids in zip(part, coder.encode(part), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
            assert coder.decode(ids.tolist()) == text.encode()


def test_frames(docs_of):
    given = [None, "", "Hello hello WORLD's", "é" * 9, "<|endoftext|> x", "x " * 30_000, "x " * 30_000, "中文"]
    df = docs_of(given).withColumnRenamed("lang", "IDS").withColumnRenamed("source", "n_tokens")
    library, words = reference(), Tokenizer.from_file(WORDS)
    for r in encode_documents(df).collect():
        assert r.ids == library.encode_ordinary(given[r.doc_id] or "")
        assert bytes(r.decoded) == (given[r.doc_id] or "").encode()
    for r in count_tokens(df, limit=100).collect():
        n = len(words.encode(given[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((given[r.doc_id] or "").encode()), n > 100)
    assert encode_documents(df.limit(0)).count() == 0 and count_tokens(df.limit(0)).count() == 0
