"""Free-text cleaning as native column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regidx.fixed import MISSING_WORDS, NOT_INFORMED, NULL_TOKENS

_MARK = "\u0001"
# Latin-1 characters that compatibility normalisation rewrites, found by rule.
_FOLDS = {
    chr(code): unicodedata.normalize("NFKC", chr(code))
    for code in range(0x80, 0x100)
    if unicodedata.normalize("NFKC", chr(code)) != chr(code)
}
_ONE_TO_ONE = {k: v for k, v in _FOLDS.items() if len(v) == 1}
_EXPANDING = {k: v for k, v in _FOLDS.items() if len(v) > 1}


def _any_of(tokens: tuple[str, ...]) -> str:
    return "|".join(re.escape(token) for token in tokens)


def fold_latin1(text: Column) -> Column:
    """Compatibility-normalise text limited to Latin-1; pure ASCII rows skip the work."""
    folded = F.translate(text, "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values()))
    for char, plain in _EXPANDING.items():
        folded = F.replace(folded, F.lit(char), F.lit(plain))
    return F.when(text.rlike("[" + "".join(_FOLDS) + "]"), folded).otherwise(text)


@F.pandas_udf(StringType())
def fold_unicode(text: pd.Series) -> pd.Series:
    """Compatibility-normalise any Unicode text, one Arrow batch at a time."""
    return text.map(
        lambda value: value
        if value is None or value.isascii()
        else unicodedata.normalize("NFKC", value)
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``S.A`` keeps both capitals)."""
    marked = F.regexp_replace(text, r"(?<=[^\p{L}\s])(?=\p{L})", _MARK + " ")
    return F.replace(F.initcap(marked), F.lit(_MARK + " "), F.lit(""))


def title_if_upper(text: Column) -> Column:
    """Title-case only text that has capitals and no small letters."""
    all_upper = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    return F.when(all_upper, title_case(text)).otherwise(text)


def clean_text(
    text: Column,
    default: str = NOT_INFORMED,
    title: bool = False,
    any_unicode: bool = False,
) -> Column:
    """Normalise, drop control characters, squeeze spaces, trim, fold null tokens.

    Each step reads the previous one once, so nesting does not blow up the
    expression tree. ``any_unicode`` is for sources that are not Latin-1.
    """
    present = F.regexp_replace(text, rf"(?i)\A\s*(?:{_any_of(MISSING_WORDS)})\s*\z", "")
    folded = fold_unicode(present) if any_unicode else fold_latin1(present)
    printable = F.regexp_replace(folded, r"\p{C}", "")
    spaced = F.regexp_replace(printable, "[\\s\\p{Z}�\"'`^~]+", " ")
    trimmed = F.btrim(spaced, F.lit(" .,;-"))
    known = F.regexp_replace(trimmed, rf"(?iu)\A(?:{_any_of(NULL_TOKENS)})\z", "")
    cased = title_if_upper(known) if title else known
    if default == "":
        return F.coalesce(cased, F.lit(""))
    return F.regexp_replace(F.coalesce(cased, F.lit("")), r"\A\z", default)


def city_name(text: Column, any_unicode: bool = False) -> Column:
    """City without an appended state, title-cased, at most 60 characters."""
    first = F.trim(F.split_part(clean_text(text, "", any_unicode=any_unicode), F.lit(","), F.lit(1)))
    return F.substring(title_case(first), 1, 60)


def first_filled(*candidates: Column) -> Column:
    """First value that is neither null nor empty; null when there is none."""
    return F.coalesce(*[F.when(value != "", value) for value in candidates])


def filled_or(text: Column, default: str) -> Column:
    return F.coalesce(text, F.lit(default))


def embedding_input(text: Column) -> Column:
    """NUL to space, trimmed; null or blank becomes one space."""
    plain = F.btrim(F.translate(text, "\u0000", " "), F.lit(" \t\n\r\x0b\x0c"))
    return F.coalesce(F.when(plain != "", plain), F.lit(" "))
