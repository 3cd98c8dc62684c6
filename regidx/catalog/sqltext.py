"""SQL fragments the check queries share (DuckDB dialect)."""

from __future__ import annotations

import unicodedata

from regidx.fixed import CHECK_WEIGHTS, NULL_TOKENS

_FOLDS = {
    chr(c): unicodedata.normalize("NFKC", chr(c))
    for c in range(0x80, 0x100)
    if unicodedata.normalize("NFKC", chr(c)) != chr(c)
}


def text_list(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def case_map(column: str, names: dict[str, str], otherwise: str = "NULL") -> str:
    branches = " ".join(f"WHEN {column} = '{key}' THEN '{value}'" for key, value in names.items())
    return f"CASE {branches} ELSE {otherwise} END"


def cleaned(x: str) -> str:
    """Cleaned text; empty where a default applies."""
    out = f"regexp_replace(coalesce({x}, ''), '^\\s*(nan|nat|none)\\s*$', '', 'i')"
    for char, plain in _FOLDS.items():
        out = f"replace({out}, '{char}', '{plain}')"
    out = f"regexp_replace({out}, '\\p{{C}}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[\\s\\p{{Z}}\\x{{FFFD}}\"''`^~]+', ' ', 'g'), ' .,;-')"
    return out


def or_default(x: str, default: str) -> str:
    """``x`` is already cleaned (a plain column)."""
    return f"CASE WHEN lower({x}) IN ({text_list(NULL_TOKENS)}) THEN '{default}' ELSE {x} END"


def titled(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), "
        "lambda t: upper(substr(t, 1, 1)) || lower(substr(t, 2))), '')"
    )


def titled_if_upper(x: str) -> str:
    return f"CASE WHEN {x} = upper({x}) AND {x} <> lower({x}) THEN {titled(x)} ELSE {x} END"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _digit(number: str, weights) -> str:
    listed = "[" + ", ".join(str(w) for w in weights) + "]"
    total = (
        f"list_sum(list_transform(range(1, {len(weights) + 1}), "
        f"lambda i: CAST(substr({number}, i, 1) AS INTEGER) * ({listed})[i]))"
    )
    return f"CASE WHEN {total} % 11 < 2 THEN '0' ELSE CAST(CAST(11 - {total} % 11 AS INTEGER) AS VARCHAR) END"


def check_digits(twelve: str) -> str:
    """Both check digits of a twelve-digit column."""
    first = _digit(twelve, CHECK_WEIGHTS)
    second = _digit(f"({twelve} || {first})", (6, *CHECK_WEIGHTS))
    return f"({first} || {second})"


def head_office_key(root: str) -> str:
    """Key of the head office for an eight-digit root column."""
    twelve = f"({root} || '0001')"
    return f"({twelve} || {check_digits(twelve)})"


def masked(key: str) -> str:
    return f"regexp_replace({key}, '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5')"


def amount(v: str) -> str:
    text = f"printf('%.2f', {v})"
    whole = f"replace(format('{{:,}}', abs(CAST(split_part({text}, '.', 1) AS BIGINT))), ',', '.')"
    return f"(CASE WHEN starts_with({text}, '-') THEN '-' ELSE '' END || {whole} || ',' || split_part({text}, '.', 2))"


def grams(x: str) -> str:
    """Ordered trigrams of a text."""
    return (
        f"flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: "
        "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    )


def word_similarity_ctes(pairs: str, out: str) -> str:
    """CTEs that score relation ``pairs(pid, q, t)`` into ``out(pid, ws)``.

    A stretch starts at a run of matches; a trigram counts once per stretch, where
    its previous occurrence lies before the start.
    """
    return f"""
    {out}_g AS (SELECT pid, list_distinct({grams('q')}) AS qa, {grams('t')} AS tg FROM {pairs}),
    {out}_p AS (SELECT pid, unnest(tg) AS g, generate_subscripts(tg, 1) AS p, qa FROM {out}_g),
    {out}_h AS (SELECT pid, p, list_contains(qa, g) AS hit, len(qa) AS m,
                       coalesce(lag(p) OVER (PARTITION BY pid, g ORDER BY p), 0) AS prev FROM {out}_p),
    {out}_l AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY pid ORDER BY p), false) AS before FROM {out}_h),
    {out}_s AS (SELECT pid, p AS s FROM {out}_l WHERE hit AND NOT before),
    {out}_r AS (SELECT s.pid, h.hit, h.m,
                       sum(h.hit::INT) OVER w AS common, sum((NOT h.hit)::INT) OVER w AS alien
                FROM {out}_s s JOIN {out}_h h ON h.pid = s.pid AND h.p >= s.s AND h.prev < s.s
                WINDOW w AS (PARTITION BY s.pid, s.s ORDER BY h.p)),
    {out}_b AS (SELECT pid, max(common / (m + alien)) AS ws FROM {out}_r WHERE hit GROUP BY pid),
    {out} AS (SELECT p.pid, coalesce(b.ws, 0.0) AS ws FROM {pairs} p LEFT JOIN {out}_b b USING (pid))"""
