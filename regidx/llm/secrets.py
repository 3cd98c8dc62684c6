"""Secret scans: fixed patterns, and a sliding window of Shannon entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regidx.llm.common import let, replaced

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so the least length in the pattern finds what a filter on the length would keep.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRule:
    """Strings of one character class: at least this many bits per character in some window."""

    shape: str
    alphabet: str
    bits: float


WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: The first shape that fits decides; a string that fits none (letters alone, digits alone) is no candidate.
RULES = (
    EntropyRule(r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$|^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "abcdefABCDEF", 3.0),
    EntropyRule(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", DIGITS + LOWER + LOWER.upper() + "+/_=-", 3.6),
)
#: Strings that are random-looking but no secrets: placeholders, counting runs, dates, UUIDs, paths of words.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|redacted|lorem|xxxx|0123456789|123456789|abcdefgh|qwerty",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    # Possessive, so that a run of any length is matched without recursion.
    r"^(?:[A-Za-z]++[0-9]{0,4}+[-/_=+])++[A-Za-z]*+[0-9]{0,4}+$",
)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<at, value>>, ``at`` in code points from 0.

    The pieces between matches give the places: Spark has no function for all of them.
    """
    none = F.array().cast("array<struct<at:int,value:string>>")

    def placed(gaps: Column, hits: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(hits)),
            F.struct(F.lit(0).alias("end"), none.alias("out")),
            lambda acc, i: let(
                acc["end"] + F.length(F.get(gaps, i - 1)),
                lambda at: F.struct(
                    (at + F.length(F.get(hits, i - 1))).alias("end"),
                    F.array_append(acc["out"], F.struct(at.alias("at"), F.get(hits, i - 1).alias("value"))).alias("out"),
                ),
            ),
        )["out"]

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    places = let(hits, lambda h: let(F.split(text, pattern, -1), lambda gaps: placed(gaps, h)))
    return F.when(F.rlike(text, F.lit(pattern)), places).otherwise(none)


def spans_of(hits: Column, kind: str) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["at"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (h["at"] + F.length(h["value"])).alias("end"),
        ),
    )


def hot_range(value: Column, rule: EntropyRule, window: int = WINDOW) -> Column:
    """struct<lo, hi>: from the first to the end of the last window with enough entropy (hi 0: none).

    The window's counts per character and the sum of c*log2(c) are carried along; a step adds the
    entering character's share and takes the leaving one's.
    """
    share = F.array(*[F.lit(0.0 if c < 2 else c * log2(c)) for c in range(window + 2)])
    # Entropy >= bits, said of the carried sum; the margin covers rounding of the sum.
    most = window * (log2(window) - rule.bits) + 1e-9
    zero = F.struct(
        F.array_repeat(F.lit(0), len(rule.alphabet) + 1).alias("counts"),
        F.lit(0.0).alias("s"), F.lit(-1).alias("lo"), F.lit(0).alias("hi"),
    )

    def step(places: Column):
        def go(acc: Column, i: Column) -> Column:
            enter = F.get(places, i - 1)
            leave = F.when(i > window, F.get(places, i - 1 - window)).otherwise(F.lit(0))
            k_in, k_out = F.get(acc["counts"], enter), F.get(acc["counts"], leave)
            moved = (
                acc["s"]
                + F.get(share, k_in + 1) - F.get(share, k_in)
                + F.when(leave > 0, F.get(share, F.greatest(k_out - 1, F.lit(0))) - F.get(share, k_out)).otherwise(F.lit(0.0))
            )
            s = F.when(enter == leave, acc["s"]).otherwise(moved)
            counts = F.transform(
                acc["counts"],
                lambda v, j: v + F.when((j == enter) & (j > 0), 1).otherwise(0) - F.when((j == leave) & (j > 0), 1).otherwise(0),
            )
            return let(
                F.struct(s.alias("s"), ((i >= window) & (s <= most)).alias("hot")),
                lambda now: F.struct(
                    counts.alias("counts"),
                    now["s"].alias("s"),
                    F.when(now["hot"] & (acc["lo"] < 0), i - window).otherwise(acc["lo"]).alias("lo"),
                    F.when(now["hot"], i).otherwise(acc["hi"]).alias("hi"),
                ),
            )

        return go

    places = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(rule.alphabet)))
    return let(
        places,
        lambda p: let(
            F.aggregate(F.sequence(F.lit(1), F.size(p)), zero, step(p)),
            lambda end: F.struct(end["lo"].alias("lo"), end["hi"].alias("hi")),
        ),
    )


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    wanted = F.filter(
        found(text, CANDIDATE),
        lambda h: F.rlike(h["value"], F.lit("[0-9]"))
        & F.rlike(h["value"], F.lit("[A-Za-z]"))
        & ~F.rlike(h["value"], F.lit("|".join(f"(?:{p})" for p in ALLOWED))),
    )

    def judged(h: Column) -> Column:
        ranges = F.lit(None).cast("struct<lo:int,hi:int>")
        for rule in reversed(RULES):
            ranges = F.when(F.rlike(h["value"], F.lit(rule.shape)), hot_range(h["value"], rule, window)).otherwise(ranges)
        return let(
            ranges,
            lambda r: F.struct(
                (h["at"] + r["lo"]).alias("start"), F.lit(3).alias("rank"), (h["at"] + r["hi"]).alias("end"), r["hi"].alias("hi")
            ),
        )

    hot = F.filter(F.transform(wanted, judged), lambda s: s["hi"] > 0)
    spans = F.transform(hot, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), spans).otherwise(none)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with assign, access, hex and entropy: arrays of struct<start, rank, end>, in code points.

    An entropy span is dropped where it overlaps a span of the fixed patterns; those always stay.
    Null and empty texts have no spans. Every row keeps its other columns, repeated rows are scanned each;
    columns named like the new ones are replaced. No row moves: one pass of column functions.
    """
    docs = replaced(docs, *KINDS)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assigned = F.filter(
        found(body, ASSIGN),
        lambda h: F.length(F.regexp_extract(h["value"], ASSIGN, 1)) >= LEAST_VALUE,
    )
    base = docs.withColumns(
        {
            "assign": spans_of(assigned, "assign"),
            "access": spans_of(found(body, ACCESS), "access"),
            "hex": spans_of(found(body, HEX), "hex"),
            "entropy": entropy_spans(body),
        }
    )
    fixed = F.concat("assign", "access", "hex")
    clear = F.filter(
        "entropy", lambda s: ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return base.withColumn("entropy", clear)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return scanned.select(
        F.col(doc_id),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )
